"""Graded retrieval metrics, their means, and paired comparison of two configurations.

``retrieved``: config, question_id, rank, section_id (page#anchor), anchor_path. ``qrels``: question_id, section, grade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10"]
TIE = 1e-9


def label_matches(label: Column, section_id: Column, anchor_path: Column) -> Column:
    """Same page, and no anchor in the label or one of the chunk's. A label ending in # is malformed: null."""
    page, anchor = F.split_part(label, F.lit("#"), F.lit(1)), F.split_part(label, F.lit("#"), F.lit(2))
    same = page == F.split_part(section_id, F.lit("#"), F.lit(1))
    hit = same & (~label.contains("#") | F.array_contains(anchor_path, anchor))
    return F.when(~label.endswith("#"), hit)


def label_ranks(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every label with the rank of the first chunk that matches it, null where none does.

    The join is on question and page; the anchors are compared within it.
    """
    page = F.split_part("section", F.lit("#"), F.lit(1))
    labels = qrels.select("question_id", "section", "grade", page.alias("_page"))
    chunks = retrieved.withColumn("_page", F.split_part("section_id", F.lit("#"), F.lit(1)))
    hits = chunks.join(labels, ["question_id", "_page"]).where(label_matches(F.col("section"), F.col("section_id"), F.col("anchor_path")))
    first = hits.groupBy("config", "question_id", "section").agg(F.min("rank").alias("rank"))
    configs = retrieved.select("config").distinct()
    every = qrels.join(F.broadcast(configs), F.lit(True))
    return every.join(first, ["config", "question_id", "section"], "left").select("config", "question_id", "section", "grade", "rank")


def nested_labels(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """Chunks that more than one label of a question matches: bad input for the metrics."""
    labels = qrels.withColumn("_page", F.split_part("section", F.lit("#"), F.lit(1)))
    chunks = retrieved.withColumn("_page", F.split_part("section_id", F.lit("#"), F.lit(1)))
    hits = chunks.join(labels, ["question_id", "_page"]).where(label_matches(F.col("section"), F.col("section_id"), F.col("anchor_path")))
    return hits.groupBy("config", "question_id", "rank").agg(F.count("*").alias("n_labels")).where("n_labels > 1")


def question_metrics(ranks: DataFrame) -> DataFrame:
    """config, question_id and the five metrics; questions without a grade-2 label have none."""
    grade2 = F.col("grade") == 2

    def recall(k: int) -> Column:
        return F.count_if(grade2 & (F.col("rank") <= k)) / F.count_if(grade2)

    gain = F.pow(F.lit(2.0), F.col("grade")) - 1

    def ndcg(k: int) -> Column:
        found = F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
        ideal = F.sum(F.when(F.col("_ideal") <= k, gain / F.log2(F.col("_ideal") + 1)).otherwise(0.0))
        return found / ideal

    order = Window.partitionBy("config", "question_id").orderBy(F.desc("grade"), "section")
    placed = ranks.withColumn("_ideal", F.row_number().over(order))
    best = F.min(F.when(grade2, F.col("rank")))
    return placed.groupBy("config", "question_id").agg(
        recall(5).alias("recall_at_5"), recall(10).alias("recall_at_10"), F.coalesce(1.0 / best, F.lit(0.0)).alias("mrr"),
        ndcg(5).alias("ndcg_at_5"), ndcg(10).alias("ndcg_at_10"), F.count_if(grade2).alias("_n2"),
    ).where("_n2 > 0").drop("_n2")


def long_metrics(per_question: DataFrame) -> DataFrame:
    """(config, question_id, metric, value)."""
    return per_question.unpivot(["config", "question_id"], METRICS, "metric", "value")


def config_means(per_question: DataFrame) -> DataFrame:
    """(config, metric, value, n): macro means over questions."""
    return long_metrics(per_question).groupBy("config", "metric").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def metric_problems(ranks: DataFrame) -> DataFrame:
    """(config, question_id, rule): grades other than 1 and 2, no grade-2 label, a rank given twice."""
    by = ranks.groupBy("config", "question_id").agg(
        F.count_if(~F.col("grade").isin(1, 2) | F.col("grade").isNull()).alias("bad"),
        F.count_if(F.col("grade") == 2).alias("answers"),
        (F.count("rank") - F.count_distinct("rank")).alias("twice"),
    )
    rules = F.array(
        F.when(F.col("bad") > 0, F.lit("grade")), F.when(F.col("answers") == 0, F.lit("no_grade_2")), F.when(F.col("twice") > 0, F.lit("repeated_rank"))
    )
    return by.select("config", "question_id", F.explode(F.array_compact(rules)).alias("rule"))


def run_problems(per_question: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored means (config, metric, value) that differ from the recomputed ones."""
    fresh = config_means(per_question).select("config", "metric", F.col("value").alias("fresh"))
    off = F.abs(F.col("value") - F.col("fresh")) > TIE
    return stored.join(fresh, ["config", "metric"], "full").where(off | F.col("value").isNull() | F.col("fresh").isNull())


def question_deltas(per_question: DataFrame, base: str, other: str) -> DataFrame:
    """(question_id, metric, delta) of ``other`` against ``base`` over the questions of both."""
    rows = long_metrics(per_question)
    a = rows.where(F.col("config") == base).select("question_id", "metric", F.col("value").alias("before"))
    b = rows.where(F.col("config") == other).select("question_id", "metric", F.col("value").alias("after"))
    return a.join(b, ["question_id", "metric"]).select("question_id", "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def unpaired_questions(per_question: DataFrame, base: str, other: str) -> DataFrame:
    """(question_id, only_in): questions on one side only, which refuse a comparison."""
    a, b = (per_question.where(F.col("config") == c).select("question_id") for c in (base, other))
    return a.join(b, "question_id", "left_anti").withColumn("only_in", F.lit(base)).unionByName(b.join(a, "question_id", "left_anti").withColumn("only_in", F.lit(other)))


def paired_diff(per_question: DataFrame, base: str, other: str, headline: str = "ndcg_at_5") -> DataFrame:
    """Per metric: both means, the mean delta and n; wins, losses and ties by the headline metric on every row."""
    deltas = question_deltas(per_question, base, other)
    head = F.col("metric") == headline
    counts = deltas.where(head).agg(
        F.count_if(F.col("delta") > TIE).alias("wins"), F.count_if(F.col("delta") < -TIE).alias("losses"), F.count_if(F.abs("delta") <= TIE).alias("ties")
    )
    means = deltas.groupBy("metric").agg(F.avg("before").alias("base_mean"), F.avg("after").alias("other_mean"), F.avg("delta").alias("mean_delta"), F.count("*").alias("n"))
    return means.join(F.broadcast(counts), F.lit(True))


def same_candidates(retrieved: DataFrame, base: str, other: str) -> DataFrame:
    """(question_id, section_id, side): candidates that one list has more often than the other; empty for a pure reordering."""
    a, b = (retrieved.where(F.col("config") == c).select("question_id", "section_id") for c in (base, other))
    return a.exceptAll(b).withColumn("side", F.lit(base)).unionByName(b.exceptAll(a).withColumn("side", F.lit(other)))
