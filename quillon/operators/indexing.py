"""Index versions, caches keyed by content, and golden-set checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def config_hash(config: dict) -> str:
    """Digest of a configuration as key-sorted JSON; a constant of the driver."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def index_label(ref: str, digest: str) -> str:
    return f"{ref}@{digest[:8]}"


def verify_index(documents: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """One row of counts and ok: something there, every vector present and of the right length."""
    counted = chunks.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("null_vectors"), F.count_if(F.size("embedding") != dim).alias("wrong_dim")
    )
    both = counted.join(F.broadcast(documents.agg(F.count("*").alias("documents"))), F.lit(True))
    ok = (F.col("chunks") > 0) & (F.col("documents") > 0) & (F.col("null_vectors") == 0) & (F.col("wrong_dim") == 0)
    return both.withColumn("ok", ok)


def orphan_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose document is not in their version."""
    return chunks.join(documents.select("index_version_id", "document_id"), ["index_version_id", "document_id"], "left_anti")


def version_problems(versions: DataFrame) -> DataFrame:
    """(rule, n): more than one active version, an active one that is not ready, two ready ones of one hash."""
    active = versions.agg((F.greatest(F.count_if("is_active") - 1, F.lit(0))).alias("n")).withColumn("rule", F.lit("several_active"))
    unready = versions.agg(F.count_if(F.col("is_active") & (F.col("status") != "ready")).alias("n")).withColumn("rule", F.lit("active_not_ready"))
    twice = versions.where("status = 'ready'").groupBy("config_hash").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("ready_twice"))
    return active.unionByName(unready).unionByName(twice).where("n > 0").select("rule", "n")


def list_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("index_version_id"))


def activate(versions: DataFrame, version_id: int) -> DataFrame:
    """Exactly the given version active, if it is ready; else nothing changes."""
    ready = F.max((F.col("index_version_id") == version_id) & (F.col("status") == "ready")).over(Window.partitionBy())
    return versions.withColumn("is_active", F.when(ready, F.col("index_version_id") == version_id).otherwise(F.col("is_active")))


def prunable(versions: DataFrame, keep: int) -> DataFrame:
    """Versions to drop: not active and not among the newest ``keep`` of the others."""
    idle = versions.where("not is_active")
    return idle.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("index_version_id")))).where(F.col("_rn") > keep).drop("_rn")


def compatible(version: dict, model: str, dim: int) -> None:
    """Refuse vectors of another model or length before a plan is built."""
    if (version["embedding_model"], version["embedding_dim"]) != (model, dim):
        raise ValueError(f"the index has {version['embedding_model']} with {version['embedding_dim']} dimensions, not {model} with {dim}")


def listed_versions(spark: SparkSession, versions_path: str) -> DataFrame | None:
    """The version rows, the list of what is visible; None before the first."""
    try:
        return spark.read.parquet(versions_path)
    except AnalysisException:
        return None


def publish_index(documents: DataFrame, chunks: DataFrame, versions_path: str, index_path: str, version: dict, dim: int) -> dict:
    """Write documents and chunks of a version, verify what was written, and append the version row last.

    The row alone makes a version visible. An id that is listed is refused; what a failed run left under an id that is not, is replaced.
    """
    spark, number = chunks.sparkSession, version["index_version_id"]
    listed = listed_versions(spark, versions_path)
    if listed is not None and not listed.where(F.col("index_version_id") == number).isEmpty():
        raise ValueError(f"index version {number} is published already")
    for name, df in (("documents", documents), ("chunks", chunks)):
        writer = df.withColumn("index_version_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("index_version_id").parquet(f"{index_path}/{name}")
    mine = F.col("index_version_id") == number
    found = verify_index(*(spark.read.parquet(f"{index_path}/{name}").where(mine) for name in ("documents", "chunks")), dim).first()
    row = version | {"status": "ready" if found["ok"] else "failed", "is_active": False}
    spark.createDataFrame([row]).write.mode("append").parquet(versions_path)
    return row


# --- caches ---


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (key) with value, null for a miss."""
    return wanted.join(cache, "key", "left")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The first value of a key wins, whether in the cache or in ``new`` (by ``seq``)."""
    first = new.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
    return cache.unionByName(first.join(cache, "key", "left_anti"))


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys, "key", "left_anti")


def embedding_key(model: Column, task: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.array(model, task, text)), 256)


def hash_embedding(text: Column, task: str, dim: int) -> Column:
    """A deterministic unit vector of a text, from digests of numbered blocks of eight numbers."""
    def block(k: Column) -> Column:
        hexes = F.sha2(F.concat_ws("\x1f", F.lit(task), text, k.cast("string")), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexes, i * 8 + 1, 8), 16, 10).cast("double") / float(1 << 31) - 1.0)

    raw = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)), block)), 1, dim)
    return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))), 1)


def embed_cached(texts: DataFrame, cache: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(vectors, new): every text's vector; distinct texts that the cache lacks are embedded once, by ``embed`` on batches
    of (key, text) to (key, value)."""
    misses = texts.select("key", "text").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    new = misses.mapInPandas(embed, "key string, value array<float>")
    return texts.join(cache.unionByName(new), "key"), new


def page_vectors(rows: DataFrame, cache: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """source_path, vectors (ordinal, value) in order, of stored chunk rows in buckets of source_path: ``embed_cached`` without a shuffle of the texts.

    A distinct text is embedded where its first chunk lies. A text that ``embed`` gives no vector has a null.
    """
    places = rows.select("source_path", "ordinal", F.col("content_hash").alias("key"))
    first = places.groupBy("key").agg(F.min(F.struct("source_path", "ordinal")).alias("at")).join(cache, "key", "left_anti")
    wanted = first.groupBy("at.source_path").agg(F.collect_set("at.ordinal").alias("wanted"))
    text = F.concat_ws("\n\n", "breadcrumb_text", "content")
    texts = rows.join(wanted, "source_path").where(F.array_contains("wanted", F.col("ordinal"))).select(F.col("content_hash").alias("key"), text.alias("text"))
    new = texts.mapInPandas(embed, "key string, value array<float>")
    found = places.join(cache.unionByName(new), "key", "left")
    return found.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("vectors"))


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: distinct keys that a run would send."""
    return texts.join(cache, "key", "left_anti").agg(F.count_distinct("key").alias("uncached"))


def build_index(
    pages: DataFrame, base_url: str, cache: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    versions: DataFrame, versions_path: str, index_path: str, config: dict, dim: int,
) -> dict:
    """Pages to a verified index version; a ready version of the same configuration is used again.

    Chunks, embeddings of texts that the cache lacks, both tables, the check, the version row last. The chunks are shuffled once, into buckets of their
    pages; what is joined to them comes by page, and only keys, places and vectors are shuffled for it.
    """
    from quillon.operators import corpus
    from quillon.sources.store import stored

    digest = config_hash(config)
    ready = versions.where((F.col("status") == "ready") & (F.col("config_hash") == digest)).orderBy(F.desc("index_version_id")).first()
    if ready:
        return ready.asDict()
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(corpus.chunks(pages, base_url).repartition(buckets, "source_path"), "chunk-rows", "source_path", buckets=buckets, codec="zstd")
    chunks = corpus.numbered(rows).join(page_vectors(rows, cache, embed), "source_path")
    chunks = chunks.withColumn("embedding", F.get("vectors", F.col("ordinal"))["value"]).drop("vectors").withColumnRenamed("source_path", "document_id")
    documents = pages.select(F.col("source_path").alias("document_id"))
    newest = versions.agg(F.coalesce(F.max("index_version_id"), F.lit(0)).alias("v")).first()["v"]
    return publish_index(documents, chunks, versions_path, index_path, {"index_version_id": newest + 1, "config_hash": digest}, dim)


# --- golden set ---

TYPES = ["single_section", "multi_section", "code", "unanswerable"]


def golden_problems(items: DataFrame) -> DataFrame:
    """(id, rule) of golden rows that break a rule."""
    s = F.coalesce("relevant_sections", F.array().cast("array<struct<section:string,grade:int>>"))
    names = F.transform(s, lambda x: x["section"])
    n2 = F.size(F.filter(s, lambda x: x["grade"] == 2))
    pages = F.transform(names, lambda x: F.split_part(x, F.lit("#"), F.lit(1)))
    nested = F.exists(names, lambda x: ~x.contains("#") & (F.size(F.filter(pages, lambda p: p == x)) > 1))
    least = F.when(F.col("type") == "multi_section", 2).otherwise(1)
    rules = [
        F.when(~F.col("id").rlike(r"^q\d{3}$"), "id"), F.when(~F.col("type").isin(TYPES), "type"),
        F.when(F.col("answerable") == (F.col("type") == "unanswerable"), "answerable"), F.when(F.size(names) != F.size(F.array_distinct(names)), "repeated_label"),
        F.when(F.exists(s, lambda x: ~x["grade"].isin(1, 2)), "grade"), F.when(F.col("answerable") & (n2 < least), "too_few_answers"),
        F.when(~F.col("answerable") & (F.size(s) > 0), "labels_on_unanswerable"), F.when(nested, "nested_labels"), F.when(F.exists(names, lambda x: x.rlike("#$|#.*#")), "section"),
    ]
    own = items.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    twice = items.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("rule"))
    return own.unionByName(twice)


def golden_subset(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subset, unknown ids); any unknown id refuses a run."""
    return items.join(ids, "id", "left_semi"), ids.join(items, "id", "left_anti")


def unresolved_labels(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels (question_id, section) that no chunk of the index carries."""
    pages = chunks.select(F.split_part("section_id", F.lit("#"), F.lit(1)).alias("name"))
    full = chunks.select(F.explode("anchor_path").alias("a"), F.split_part("section_id", F.lit("#"), F.lit(1)).alias("p")).select(F.concat_ws("#", "p", "a").alias("name"))
    known = pages.unionByName(full).distinct()
    return qrels.join(known, qrels["section"] == known["name"], "left_anti")


def split_answerable(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answerable, counts): unanswerable questions are counted, never scored."""
    counts = items.agg(F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("skipped"))
    return items.where("answerable"), counts


def ask_batch_summary(results: DataFrame, total: int) -> DataFrame:
    """One row: results by status, the share valid at first try, totals, complete if every question has a result."""
    n = F.count("*")
    return results.agg(
        n.alias("n"), F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.try_divide(F.count_if("schema_first_try"), n).alias("first_try_share"), F.sum("tokens").alias("tokens"), (n == total).alias("is_complete"),
    )


def eval_run_rows(means: DataFrame, suite: str) -> DataFrame:
    """One row per configuration with its metrics as a map."""
    metrics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    return means.groupBy("config").agg(F.lit(suite).alias("suite"), metrics.alias("metrics"), F.max("n").alias("n"))
