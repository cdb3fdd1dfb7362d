"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.chunk_bpe import encode_and_decode
from quillon.llm.common import read_table
from quillon.llm.conversations import repair
from quillon.llm.conversations import sql as repair_sql
from quillon.llm.digest import fingerprints
from quillon.llm.html_text import extract
from quillon.llm.line_crf import classify
from quillon.llm.minhash import near_duplicates as minhash_duplicates
from quillon.llm.minhash import sql as minhash_sql
from quillon.llm.packing import pack_documents
from quillon.llm.quality_rules import judge as judge_quality
from quillon.llm.secrets import scan
from quillon.llm.secrets import sql as secrets_sql
from quillon.llm.simhash import near_duplicates
from quillon.llm.token_files import round_trip
from quillon.llm.urls import judge as judge_urls
from quillon.llm.vector_codes import compress
from quillon.llm.vector_codes import sql as codes_sql


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op2_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(read_table(spark, sf_dir, "documents"))


def op3_canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op4_simhash_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_tree_model_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op6_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_addressable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def op10_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op11_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(read_table(spark, sf_dir, "documents"))


def op12_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_best_fit_packing,
    op2_chunk_reuse_bpe,
    op3_canonical_digests,
    op4_simhash_bit_planes,
    op5_tree_model_html,
    op6_ngram_quality_rules,
    op7_linked_secrets,
    op8_line_crf_quality,
    op9_addressable_token_files,
    op10_url_association_rules,
    op11_minhash_odd_sketches,
    op12_dual_tree_codes,
    op13_auction_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others need hashes that DuckDB lacks, tokenizers or fitted models."""
    return {"op7_linked_secrets": secrets_sql(), "op11_minhash_odd_sketches": minhash_sql(), "op12_dual_tree_codes": codes_sql(), "op13_auction_repair": repair_sql()}
