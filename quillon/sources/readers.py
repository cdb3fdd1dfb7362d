"""Readers with explicit schemas; bad rows go to a problems table, never to the result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize_question

GOLDEN = "id string, question string, type string, answerable boolean, reference_answer string, relevant_sections array<struct<section:string,grade:int>>, notes string"
PRICES = "kind string, model string, input_per_mtok decimal(12,6), output_per_mtok decimal(12,6), per_1k_searches decimal(12,6), status string"
RESULTS = (
    "results array<struct<config:string,id:string,type:string,latency_ms:double,cost_usd:double,error:string,"
    "components:array<struct<metric:string,value:double,errored:boolean,not_applicable:boolean>>>>"
)


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    full = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^\w+:/+", "/")
    own = root.split("://")[-1].rstrip("/")
    return read.text(root, wholetext=True).select(F.substring(full, len(own) + 2, 1 << 20).alias("source_path"), F.col("value").alias("text"))


def scan_pages(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """source_path, text of every page below ``root``; a page is a file and a row."""
    return _files(spark, root, pattern)


def scan_code_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """path, text of the files that pages may include."""
    return _files(spark, root, pattern).withColumnRenamed("source_path", "path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of text files that are read in splits of bytes, whatever their size.

    A split's lines have consecutive ids in one task, so a line's number is its place in its split behind the lines of the splits before, of
    which only the counts meet.
    """
    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split")]
    rows = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("_path", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_path", "_split", "_first", "_before")
    return rows.join(splits, ["_path", "_split"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of JSONL files; problems name the file, the 1-based line and its text. Blank lines do not count."""
    parsed = F.from_json("line", f"{GOLDEN}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).where(F.trim("line") != "").select("file", "line_no", "line", parsed.alias("item"))
    bad = F.col("item._bad").isNotNull() | F.col("item").isNull()
    return rows.where(~bad).select("item.*").drop("_bad"), rows.where(bad).select("file", "line_no", "line")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICES).json(path)


def read_generation_results(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (config, id, metric, state, value, latency_ms, cost_usd, error) of nested result files."""
    rows = spark.read.schema(RESULTS).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    rows = rows.select("r.*", F.explode_outer("r.components").alias("c"))
    state = F.when(F.col("c.errored"), "errored").when(F.col("c.not_applicable"), "na").when(F.col("c.metric").isNotNull(), "scored")
    return rows.select("config", "id", "type", "latency_ms", "cost_usd", "error", F.col("c.metric").alias("metric"), state.alias("state"), F.when(state == "scored", F.col("c.value")).alias("value"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet in CSV with commas, semicolons or tabs, quoted newlines allowed, a byte-order mark dropped.

    The separator is the one that the header has most of outside quotes; only its line comes to the driver.
    """
    first = (spark.read.text(path).first() or [""])[0]
    bare = re.sub('"[^"]*"', "", first)
    sep = max(",;\t", key=bare.count)
    rows = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip().strip('"') for c in rows.columns])
    return rows.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in rows.columns]).isNotNull())


def write_sheet(rows: DataFrame, path: str) -> None:
    """A label sheet as one CSV folder with a header per file: commas, quotes doubled, empty cells for null."""
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", None).option("emptyValue", "").csv(path)


def write_run(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").partitionBy("config").parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_sheet_rows(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append to a label sheet: items without the verdict, those already there left alone."""
    return items.drop("verdict", "judge").join(existing, "item_id", "left_anti")


def valid_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): 3 to 500 characters after trimming, no control characters."""
    text = F.regexp_replace("question", r"^\s+|\s+$", "")
    rule = F.when(F.length(text) < 3, "too_short").when(F.length(text) > 500, "too_long").when(text.rlike(r"\p{Cc}"), "control_character")
    rows = rows.withColumn("question", text).withColumn("rule", rule)
    return rows.where("rule is null").drop("rule").withColumn("normalized", normalize_question(F.col("question"))), rows.where("rule is not null")
