"""Canonical exact digests of documents, with Spark functions only.

A text is canonicalised (NFKC, full case folding, runs of white space to one space, trimmed) and named by two
64-bit xxhash values. Rows of equal names are compared byte by byte: every name's least and greatest canonical text,
aggregated before the shuffle, must be equal, or the name gets a SHA-256 of the canonical text behind it. Likeness is that of an
exact digest: 1 for equal canonical texts, else 0.

Null texts count as empty. Repeated rows stay; rows with one doc_id follow each other by text, those with an id that fills more than one
range (see ``with_next``) by the hash of their text first. Null doc_ids come last in descending order. An empty table gives no rows; a single row is its own next document. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_partitions

# Static methods of a library that ships with Spark, for the NFKC form and for case folding.
NORMALIZER = ("com.ibm.icu.text.Normalizer", "compose")
FOLDER = ("com.ibm.icu.lang.UCharacter", "foldCase")


def canonical(text: Column) -> Column:
    """The canonical form of a text that is not null."""
    folded = text
    for method in (NORMALIZER, FOLDER):
        folded = F.java_method(*map(F.lit, method), folded, F.lit(True))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\s\p{Z}\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits in hex."""
    halves = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0")) for seed in (1, 2)]
    return F.concat(*halves)


def colliding_names(docs: DataFrame) -> DataFrame:
    """Names whose rows do not all have the same canonical bytes."""
    rows = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("name", wide_hash(F.col("canon")))
    return rows.groupBy("name").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("name")


def range_borders(docs: DataFrame, n_ranges: int) -> tuple[list[int], dict[int | None, int]]:
    """Borders that cut doc_id into ranges of about equal numbers of rows, and the ids that fill several ranges, with how many."""
    shares = [k / n_ranges for k in range(1, n_ranges)]
    found = docs.agg(
        F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * n_ranges))).alias("q"), F.count("*").alias("n"), F.count("doc_id").alias("known")
    ).first()
    times = Counter(found["q"] or [])
    # Beyond 2**53 neighbouring ids share a double, on which ranges are found; ids there are never split.
    heavy: dict[int | None, int] = {v: k for v, k in times.items() if k > 1 and abs(v) < 1 << 53}
    if (parts := n_ranges * (found["n"] - found["known"]) // max(found["n"], 1)) > 1:
        heavy[None] = parts
    return sorted({*times, *(v + 1 for v in heavy if v is not None)}), heavy


def with_ranges(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Add ``_range`` and the order within it, ``_down`` and ``_hash``; a next document is in the same range or the next lower one."""
    borders, heavy = range_borders(docs, n_ranges)
    cuts = sorted({float(b) for b in borders}) or [0.0]
    bucketizer = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_bucket")
    rows = bucketizer.transform(docs.withColumn("_id", F.coalesce("doc_id", F.lit(0)).cast("double")))
    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_bucket")).cast("long")
    hashed, inner = F.lit(0).cast("long"), F.lit(0).cast("long")
    for value, parts in heavy.items():
        of = F.col("doc_id").eqNullSafe(F.lit(value))
        hashed = F.when(of, F.xxhash64("text")).otherwise(hashed)
        place = F.shiftright(F.xxhash64("text"), 40) + (1 << 23)  # 24 bits that grow with the hash
        inner = F.when(of, parts - 1 - F.shiftright(place * parts, 24)).otherwise(inner)
    step = max(heavy.values(), default=1)
    return rows.select("*", (number * step + inner).alias("_range"), F.bitwise_not("doc_id").alias("_down"), hashed.alias("_hash")).drop("_id", "_bucket")


def with_next(docs: DataFrame) -> DataFrame:
    """Add the text of the next document in descending doc_id, the first one's after the last.

    Rows are dealt out by ranges of doc_id that hold about as many rows each (by approximate quantiles, so gaps between ids do not
    matter; an id that fills several ranges is split by the hash of its texts) and read their neighbour in a window; the last row of a
    range takes the head of the next range that has rows from a table of one row per range.
    """
    rows = with_ranges(docs, 16 * shuffle_partitions(docs.sparkSession))
    heads = rows.groupBy("_range").agg(F.min(F.struct("_down", "_hash")).alias("_head"))
    down = Window.orderBy(F.desc("_range"))
    before = F.coalesce(F.lag("_range").over(down), F.min("_range").over(Window.partitionBy()))
    heads = heads.withColumn("_from", before).withColumnRenamed("_range", "_head_range")
    same = [F.col("_range") == F.col("_head_range"), F.col("_down").eqNullSafe(F.col("_head._down")), F.col("_hash") == F.col("_head._hash")]
    first = rows.select("_range", "_down", "_hash", "text").join(F.broadcast(heads), same)
    heads = first.groupBy("_from").agg(F.min("text").alias("_head_text"))

    order = Window.partitionBy("_range").orderBy("_down", "_hash", "text")
    rows = rows.withColumn("_inner", F.lead("text").over(order))
    key = F.when(F.col("_inner").isNull(), F.col("_range"))
    joined = rows.withColumn("_edge", key).join(heads, (F.col("_range") == F.col("_from")) & F.col("_edge").isNotNull(), "left")
    return joined.withColumn("next_text", F.coalesce("_inner", "_head_text")).drop("_range", "_down", "_hash", "_inner", "_edge", "_from", "_head_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of their edited texts, with likenesses."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bad = materialize(colliding_names(docs), "collisions")
    rows = with_next(docs)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.alias("n_chars"), "text", "next_text",
        F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"_{name}", canonical(F.col(name)))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[wide_hash(F.col(f"_{name}")).alias(alias) for name, alias in (("text", "fingerprint"), ("edited", "edited_fingerprint"))],
        *[(F.col("_text") == F.col(f"_{name}")).cast("double").alias(alias) for name, alias in (("edited", "near_edited"), ("next_text", "near_next"))],
        *[F.sha2(f"_{name}", 256).alias(f"_{name}_sha") for name in ("text", "edited") if bad.count()],
    )
    if "_text_sha" in rows.columns:
        for name, alias in (("text", "fingerprint"), ("edited", "edited_fingerprint")):
            rows = rows.join(bad.withColumnRenamed("name", "_bad"), F.col(alias) == F.col("_bad"), "left")
            rows = rows.withColumn(alias, F.when(F.col("_bad").isNull(), F.col(alias)).otherwise(F.concat_ws("-", alias, f"_{name}_sha"))).drop("_bad")
    return rows.drop("_text_sha", "_edited_sha")
