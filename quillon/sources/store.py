"""Intermediate tables in the shared folder: written once, read by everything that follows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUILT: dict[tuple, str] = {}


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillon-store-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session of one process may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_folder()
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def stored(df: DataFrame, tag: str, *by: str, buckets: int = 0, codec: str = "snappy") -> DataFrame:
    """``df`` written once, with equal values of ``by`` side by side, and read back. With ``buckets``, they stand in so many buckets of a table, and what
    is grouped by them needs no shuffle."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if buckets:
        df.write.format("parquet").option("compression", codec).bucketBy(buckets, *by).option("path", path).saveAsTable(table_at(path))
        return df.sparkSession.table(table_at(path))
    out = df.repartition(*by).sortWithinPartitions(*by) if by else df
    out.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_at(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def files_of(table: DataFrame) -> tuple[int, int]:
    """How many files a table read from files has, and a digest of their paths, sizes and times; computed by the tasks that read them."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = table.select(*meta).distinct()
    found = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("digest")).first()
    return found["n"], int(found["digest"] or 0)


def built_once(build: Callable[[], DataFrame], tag: str, source: DataFrame, *by: str, buckets: int = 0) -> DataFrame:
    """``stored(build())``, once per session and content of ``source``, a table read from files: written again if its files have changed, or if the
    built table has gone."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, tag, files_of(source))
    if key in _BUILT:
        try:
            found = spark.read.parquet(_BUILT[key])  # a table's name outlives its files
            return spark.table(table_at(_BUILT[key])) if buckets else found
        except AnalysisException:
            del _BUILT[key]
    found = stored(build(), tag, *by, buckets=buckets)
    _BUILT[key] = found.inputFiles()[0].rsplit("/", 1)[0]
    return found
