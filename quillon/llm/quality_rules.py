"""Quality rules, with Spark functions only: counts per document, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``BUCKETS`` buckets and counted over the whole corpus (raw) and over its trusted documents
(target: label quality 1). A document's score is the mean over its n-grams of log p_target - log p_raw, both with
additive smoothing; it is kept if the counts pass and the score reaches ``MIN_LLR``. The only thing that all tasks
share is the array of ``BUCKETS`` weights.

Null and empty texts have no words, score 0 and fail. Repeated rows count as often as they occur and each get a row; a document
with several labels is trusted if one of them is 1. Without any labelled document the score is 0 everywhere. An empty table
gives no rows. Extra columns are ignored (and kept by ``keep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let

BUCKETS = 10_000
SMOOTHING = 1.0
MIN_LLR = -0.07
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# White space and symbols of the counts.
SPACE = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ngrams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of neighbours (the last word pairs with the end)."""
    pairs = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows (hashes by place) that occur twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            F.transform(ordered, lambda x, k: F.struct(
                x["at"].alias("at"),
                ((F.get(ordered, k - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))).alias("hit"),
            )),
            lambda x: F.coalesce(x["hit"], F.lit(False)),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["at"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places, start,
            lambda acc, at: F.struct((acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"), (at + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    placed = F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(F.array_sort(placed), covered)).otherwise(F.lit(0))


def window_hashes(hashes: Column) -> Column:
    n = F.size(hashes)
    at = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the array of log p_target - log p_raw by bucket."""
    trusted = labels.groupBy(F.col("doc_id").alias("_trusted")).agg(F.max("quality").alias("_quality")).where("_quality = 1")
    # The labels grow with the documents, so they are never broadcast: a sort-merge join at every size.
    rows = docs.select("doc_id", "text").join(trusted.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    rows = rows.select(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"), F.col("_trusted").isNotNull().cast("long").alias("target"))
    grams = rows.select("target", F.explode(ngrams(F.col("hashes"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0)
    table = counts.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target")
    )

    def weight(c: Column) -> Column:
        part = [F.log((c[k] + SMOOTHING) / (F.col(f"n_{k}") + SMOOTHING * buckets)) for k in ("target", "raw")]
        return F.when(F.col("n_target") > 0, part[0] - part[1]).otherwise(F.lit(0.0))

    return table.select(F.transform("t", weight).alias("w"))


def rules(docs: DataFrame, labels: DataFrame, min_llr: float = MIN_LLR) -> DataFrame:
    """Every column of ``docs`` (doc_id, text, ...) with the counts, the score and the verdict behind them.

    All of a row's values come from one expression that binds each intermediate array once, so a filter on the verdict,
    which Spark moves below the projection, does not evaluate them again.
    """
    fitted = weights(docs, labels).first()["w"]
    table = F.split(F.lit(" ".join(map(repr, fitted))), " ").cast("array<double>")  # folds to one constant
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(VISIBLE))

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        kept = ~failed & (c["llr"] >= min_llr)
        return F.struct(*[c[k].alias(k) for k in COUNTS[:6]], failed.alias("base_failed"), kept.alias("kept"))

    def counts(ws: Column, hashes: Column) -> Column:
        total = F.aggregate(ngrams(hashes), F.lit(0.0), lambda acc, g: acc + F.get(table, g))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            let(window_hashes(hashes), repeat_words).cast("long").alias("n_repeat_words"),
            F.coalesce(total / F.nullif(2 * F.size(hashes), F.lit(0)), F.lit(0.0)).alias("llr"),
        )

    def all_of(ws: Column) -> Column:
        return let(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hashes: counts(ws, hashes)), verdict)

    rows = docs.select(*[c for c in docs.columns if c not in COUNTS], let(words(F.col("text")), all_of).alias("_r"))
    return rows.select("*", "_r.*").drop("_r")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts and the verdict."""
    return rules(docs.select("doc_id", "text"), labels).select("doc_id", *COUNTS)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return rules(inner, labels).where("kept").select("row.*")
