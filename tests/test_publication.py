"""Index versions become visible by their row alone."""

import pytest
from pyspark.sql import functions as F
from quillon.operators import indexing


def test_a_listed_version_is_refused_and_leftovers_are_replaced(spark, tmp_path):
    places = f"file://{tmp_path}/versions", f"file://{tmp_path}/index"
    documents = spark.createDataFrame([("a.md",), ("b.md",)], "document_id string")
    chunks = spark.createDataFrame([("a.md", 1, [1.0, 0.0]), ("b.md", 2, [0.0, 1.0])], "document_id string, chunk_id long, embedding array<float>")
    version = {"index_version_id": 1, "config_hash": "x"}
    # A run that stopped after its first write, and one of another version, which stays.
    for number, rows in ((1, documents.limit(1)), (7, documents)):
        rows.withColumn("index_version_id", F.lit(number)).write.mode("append").partitionBy("index_version_id").parquet(f"{places[1]}/documents")
    assert indexing.listed_versions(spark, places[0]) is None
    assert indexing.publish_index(documents, chunks, *places, version, 2)["status"] == "ready"
    kept = spark.read.parquet(f"{places[1]}/documents").groupBy("index_version_id").count().collect()
    assert sorted(map(tuple, kept)) == [(1, 2), (7, 2)]
    with pytest.raises(ValueError, match="published already"):
        indexing.publish_index(documents, chunks, *places, version, 2)
    assert indexing.listed_versions(spark, places[0]).count() == 1
    assert indexing.publish_index(documents, chunks, *places, version | {"index_version_id": 2}, 3)["status"] == "failed"
