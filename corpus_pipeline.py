"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next stage.
All but the last keep the columns of ``documents``.

1. Quality classifier: documents predicted bad go.
2. Quality rules: documents whose counts or score fail go; the statistics are those of the documents still there.
3. SimHash near-duplicates: of documents linked by a similarity of 0.8 or more (five-word shingles), the smallest doc_id stays.
4. Secret scans: every reported span becomes ``[SECRET]``; n_chars follows.
5. Best-fit packing: one row per piece, with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import line_crf, packing, quality_rules, secrets, similar, simhash
from quillon.llm.common import materialize, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep(docs, read_table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, similar.similar_groups(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
#: A random field, hashes and a tokenizer are not SQL; tests hold the result against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
