"""Helpers shared by the corpus operators: inputs, shared scratch files, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillon-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may do without the setting; it then
    gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _local_scratch()
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows with distinct keys, the same for the same rows: a hash of ``key`` first thins the keys to about four
    times ``n``, so that what the tasks hand to the final cut does not grow with the rows, and repeated keys count once."""
    n_keys = df.agg(F.approx_count_distinct(key)).first()[0]
    share = min(1.0, 4 * n / max(n_keys, 1))
    cells = 1 << 30
    thinned = df.where(F.pmod(F.xxhash64(key), F.lit(cells)) < int(share * cells)).dropDuplicates([key])
    return thinned.orderBy(F.xxhash64(key), key).limit(n)
