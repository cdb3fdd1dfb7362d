"""Queries of readers, the log sink and the index build: the given tables are written as files first, then read as these readers do."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import corpus, indexing
from quillon.plans.registry import Tables, query
from quillon.sources import readers
from quillon.sources.store import shared_folder
from quillon.streaming import jobs

ROWS_A_FILE = 200


def folder(t: Tables, tag: str) -> str:
    return f"{shared_folder(t.spark)}/{tag}-{uuid.uuid4().hex}"


def document_files(t: Tables) -> str:
    """The documents as text files of at most ``ROWS_A_FILE`` lines, a folder per source; a document is a line."""
    path = folder(t, "files")
    lines = t.documents.select("source", F.translate("text", "\n\r", "  ").alias("value"))
    lines.write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("source").text(path)
    return path


FILES = "select source, count(*) as n_documents, sum(length(coalesce(text, '')))::bigint as chars from documents group by source"


def of_files(files: DataFrame, path: str) -> DataFrame:
    source = F.regexp_extract(path, "^source=([^/]*)/", 1)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = files.select(source.alias("source"), n_lines.alias("n"), F.length("text").alias("chars"))
    return rows.groupBy("source").agg(F.sum("n").cast("long").alias("n_documents"), F.sum(F.col("chars") - F.col("n")).cast("long").alias("chars"))


@query("A1_scan_pages", FILES)
def scan_pages(t: Tables) -> DataFrame:
    return of_files(readers.scan_pages(t.spark, document_files(t), "*.txt"), "source_path")


@query("A2_scan_code_files", FILES)
def scan_code_files(t: Tables) -> DataFrame:
    return of_files(readers.scan_code_files(t.spark, document_files(t), "*.txt"), "path")


def golden_files(t: Tables) -> str:
    """A line per document with its place in its file; every seventh is cut short, every eleventh has a blank line before it."""
    path = folder(t, "golden")
    item = F.struct(F.format_string("q%03d", "doc_id").alias("id"), F.lit("q?").alias("question"), F.lit("single_section").alias("type"), F.lit(True).alias("answerable"))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), "doc_id")).otherwise(F.to_json(item))
    lines = t.documents.select(F.explode(F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(" "), line)).otherwise(F.array(line))).alias("value"))
    lines = lines.withColumn("place", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) + 1)
    lines.select(F.when(F.col("value").startswith("{broken"), F.concat("value", F.lit(" "), "place")).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


@query("A3_read_golden", "select 'item' as part, case when doc_id % 7 > 0 then 'q' || case when doc_id < 100 then lpad(doc_id::varchar, 3, '0') else doc_id::varchar end end as id, true as placed from documents where doc_id % 7 > 0 union all select 'problem', doc_id::varchar, true from documents where doc_id % 7 = 0")
def read_golden(t: Tables) -> DataFrame:
    items, problems = readers.read_golden(t.spark, golden_files(t))
    words = F.split("line", " ")
    found = problems.select(F.lit("problem").alias("part"), F.get(words, F.lit(1)).alias("id"), (F.get(words, F.lit(2)).cast("long") == F.col("line_no")).alias("placed"))
    return items.select(F.lit("item").alias("part"), "id", F.lit(True).alias("placed")).unionByName(found)


@query("A12_log_sink", "select ts::date::varchar as day, count(distinct event_id) as n from events group by 1")
def log_sink(t: Tables) -> DataFrame:
    """Requests that come twice, through the stream's sink: each is written once, in its day."""
    path = folder(t, "log")
    requests = t.events.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    requests.unionByName(requests).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(requests.schema).parquet(f"{path}/in")
    jobs.log_sink(stream, f"{path}/out", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


def first_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors of two numbers, of the first digits of a text's key."""
    for pdf in batches:
        first = pdf["key"].str[:1].map(lambda c: int(c, 16) < 8)
        yield pd.DataFrame({"key": pdf["key"], "value": [[1.0, 0.0] if x else [0.0, 1.0] for x in first]})


@query("L19_build_again", """with d as (select count(*) as n, count_if(doc_id % 20 = 0) as changed from documents)
 select 1::bigint as index_version_id, 'ready' as status, n as documents, true as all_embedded, 0::bigint as reused from d union all select 1, 'ready', n, true, 1 from d union all select 2, 'ready', n, true, 0 from d union all select -2, 'ready', changed, true, 0 from d""")  # fmt: skip
def build_again(t: Tables) -> DataFrame:
    """A build, the same again, one of another configuration whose pages are changed in part, and what that one had to embed: changed pages only."""
    path = folder(t, "index")
    pages = t.documents.select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("source_path"), F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"), "doc_id")
    later = pages.withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("# New "), "doc_id", F.lit("\n\nChanged."))).otherwise(F.col("text")))
    versions = "index_version_id long, config_hash string, status string, is_active boolean"
    none = t.spark.createDataFrame([], versions)
    cache = t.spark.createDataFrame([], "key string, value array<float>")
    rows = []

    def add(version: dict, reused: int) -> None:
        rows.append((version["index_version_id"], version["status"], reused))

    places = f"{path}/versions", f"{path}/index"
    first = indexing.build_index(pages.drop("doc_id"), "https://d", cache, first_numbers, none, *places, {"v": 1}, 2)
    add(first, 0)
    known = t.spark.read.schema(versions).parquet(places[0])
    add(indexing.build_index(pages.drop("doc_id"), "https://d", cache, first_numbers, known, *places, {"v": 1}, 2), 1)
    chunks = t.spark.read.parquet(f"{places[1]}/chunks").where("index_version_id = 1")
    held = chunks.select(F.col("content_hash").alias("key"), F.col("embedding").alias("value")).dropDuplicates(["key"])
    add(indexing.build_index(later.drop("doc_id"), "https://d", held, first_numbers, known, *places, {"v": 2}, 2), 0)
    built = t.spark.createDataFrame(rows, "index_version_id long, status string, reused long")
    stored = [t.spark.read.parquet(f"{places[1]}/{name}") for name in ("documents", "chunks")]
    documents = stored[0].groupBy("index_version_id").agg(F.count("*").alias("documents"))
    whole = stored[1].groupBy("index_version_id").agg(F.bool_and(F.size("embedding") == 2).alias("all_embedded"))
    new = stored[1].where("index_version_id = 2").join(held, F.col("content_hash") == F.col("key"), "left_anti")
    counted = new.agg(F.lit(-2).cast("long").alias("index_version_id"), F.lit("ready").alias("status"), F.count_distinct("document_id").alias("documents"), F.lit(True).alias("all_embedded"), F.lit(0).cast("long").alias("reused"))
    return built.join(documents, "index_version_id").join(whole, "index_version_id").select("index_version_id", "status", "documents", "all_embedded", "reused").unionByName(counted)
