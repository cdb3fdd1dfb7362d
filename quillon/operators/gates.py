"""Regression gates: runs against baselines, in long form.

Runs: config, metric, value, n. Baselines: config, metric, value, tolerance, floor (both null where not gated), golden,
index_hash. A gate gives metric rows and reason rows; it fails if a row failed or a reason exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9
# Error kinds by category.
PROVIDER_KINDS = ["ProviderRateLimited", "BackoffExhaustedError", "ProviderUnavailable", "ProviderTimeout", "EmbedderUnavailableError"]
HARNESS_KINDS = ["MalformedInput", "AssertionFailed"]
CATEGORIES = ["provider", "generator_bad_output", "judge_bad_output", "malformed_input", "cannot_run"]


def threshold(baseline: Column, tolerance: Column, floor: Column) -> Column:
    """The lowest passing value; null where neither part is set."""
    return F.when(tolerance.isNotNull() | floor.isNotNull(), F.greatest(floor, baseline - tolerance))


def passes(current: Column, lowest: Column) -> Column:
    """Null without a threshold; a missing or NaN value fails (NaN sorts above all numbers in Spark)."""
    return F.when(lowest.isNotNull(), F.coalesce(~F.isnan(current) & (current >= lowest - SLACK), F.lit(False)))


def gate_rows(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """(config, metric, baseline, current, delta, threshold, passed, n) for configs the run has."""
    base = baseline.select("config", "metric", F.col("value").alias("baseline"), "tolerance", "floor")
    sizes = run.groupBy("config").agg(F.max("n").alias("_n"))
    rows = run.select("config", "metric", F.col("value").alias("current"), "n").join(base, ["config", "metric"], "full").join(sizes, "config")
    lowest = threshold(F.col("baseline"), F.col("tolerance"), F.col("floor"))
    wanted = F.col("current").isNotNull() | lowest.isNotNull()
    return rows.where(wanted).select(
        "config", "metric", "baseline", "current", (F.col("current") - F.col("baseline")).alias("delta"),
        lowest.alias("threshold"), passes(F.col("current"), lowest).alias("passed"), F.coalesce("n", "_n").alias("n"),
    )


def gate_reasons(run: DataFrame, baseline: DataFrame, info: DataFrame) -> DataFrame:
    """(config, reason). ``info`` is one row: golden, index_hash of the run."""
    gated = baseline.where("tolerance is not null or floor is not null")
    configs = gated.select("config", "golden", "index_hash").distinct()
    present = run.select("config").distinct()
    missing = configs.join(present, "config", "left_anti").select("config", F.lit("missing_config").alias("reason"))
    mine = info.select(F.col("golden").alias("_g"), F.col("index_hash").alias("_i"))
    other = configs.join(present, "config").join(F.broadcast(mine), F.lit(True)).where("golden <> _g or index_hash <> _i")
    lacking = gated.join(present, "config").join(run.where("value is not null"), ["config", "metric"], "left_anti")
    none = configs.agg(F.count("*").alias("c")).where("c = 0").select(F.lit("*").alias("config"), F.lit("nothing_gated").alias("reason"))
    return (
        missing.unionByName(other.select("config", F.lit("other_setup").alias("reason")).distinct())
        .unionByName(lacking.select("config", F.concat(F.lit("missing_metric:"), "metric").alias("reason")))
        .unionByName(none)
    )


def retrieval_gate(run: DataFrame, baseline: DataFrame, info: DataFrame) -> DataFrame:
    """One row: status, failed metrics, reasons. Configs of another setup get no metric rows."""
    reasons = gate_reasons(run, baseline, info)
    rows = gate_rows(run, baseline).join(reasons.where("reason = 'other_setup'").select("config"), "config", "left_anti")
    failed = rows.agg(F.count_if(~F.col("passed")).alias("failed_metrics"), F.count_if(F.col("passed").isNotNull()).alias("gated_metrics"))
    counted = reasons.agg(F.count("*").alias("reasons"))
    both = failed.join(F.broadcast(counted), F.lit(True))
    return both.select(F.when((F.col("failed_metrics") > 0) | (F.col("reasons") > 0), "fail").otherwise("pass").alias("status"), "*")


def category(stage: Column, kind: Column, bases: Column) -> Column:
    """The bucket of an error; one that nobody classified is ``cannot_run``."""
    return (
        F.when(kind.isin(PROVIDER_KINDS) | F.array_contains(bases, "ProviderRateLimited"), "provider")
        .when((kind == "ProviderBadOutput") & (stage == "generator"), "generator_bad_output")
        .when(kind == "ProviderBadOutput", "judge_bad_output")
        .when(kind.isin(HARNESS_KINDS), "malformed_input")
        .when(kind.isNotNull(), "cannot_run")
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """Cases per config and category, a case once per category. ``errors``: config, id, stage, kind, bases."""
    named = errors.withColumn("category", category(F.col("stage"), F.col("kind"), F.col("bases")))
    found = named.groupBy("config", "id").agg(F.collect_set("category").alias("c"))
    return found.groupBy("config").agg(*[F.count_if(F.array_contains("c", x)).alias(x) for x in CATEGORIES])


def inconclusive(errors: Column, cases: Column) -> Column:
    """More than a fifth of the cases, in whole numbers; no case at all is inconclusive."""
    return (cases == 0) | (5 * errors > cases)


def warm(cases: DataFrame) -> DataFrame:
    """Answered cases with a latency that paid for no cold start and replayed nothing."""
    return cases.where("error_kind is null and latency_ms is not null and not cold_start and llm_cache_hits = 0")


def generation_gate(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row with the status: fail beats inconclusive beats pass. ``rows``: gate rows of gated, conclusive configs;
    ``summaries``: config, gated, provider, cases."""
    failed = rows.agg(F.count_if(~F.col("passed")).alias("failed_metrics"))
    doubtful = summaries.where("gated").agg(F.count_if(inconclusive(F.col("provider"), F.col("cases"))).alias("inconclusive_configs"))
    both = failed.join(F.broadcast(doubtful), F.lit(True))
    status = F.when(F.col("failed_metrics") > 0, "fail").when(F.col("inconclusive_configs") > 0, "inconclusive").otherwise("pass")
    return both.select(status.alias("status"), "*")


def baseline_problems(run: DataFrame, errors: DataFrame, judged: DataFrame) -> DataFrame:
    """(config, rule): configs that may not become a baseline: cases with errors, or without a judge."""
    failing = errors.groupBy("config").count().where("count > 0").select("config", F.lit("errors").alias("rule"))
    unjudged = run.select("config").distinct().join(judged, "config", "left_anti").select("config", F.lit("no_judge").alias("rule"))
    return failing.unionByName(unjudged)


def upsert_baseline(base: DataFrame, run: DataFrame) -> DataFrame:
    """The run's configs replace theirs, other rows stay, hand-written thresholds survive."""
    kept = base.join(run.select("config").distinct(), "config", "left_anti")
    rules = base.select("config", "metric", "tolerance", "floor")
    return kept.unionByName(run.join(rules, ["config", "metric"], "left").select(kept.columns))


def mixed_setups(base: DataFrame, info: DataFrame, run_configs: DataFrame) -> DataFrame:
    """Rows an upsert would keep though they were scored on another setup."""
    mine = info.select(F.col("golden").alias("_g"), F.col("index_hash").alias("_i"))
    return base.join(run_configs, "config", "left_anti").join(F.broadcast(mine), F.lit(True)).where("golden <> _g or index_hash <> _i").drop("_g", "_i")


def target_verdict(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """verdict met, missed or — per (metric, value); targets: metric, target, strict."""
    over = F.when(F.col("strict"), F.col("value") > F.col("target") + SLACK).otherwise(F.col("value") >= F.col("target") - SLACK)
    return rows.join(targets, "metric").withColumn("verdict", F.when(F.col("value").isNull(), "—").when(over, "met").otherwise("missed"))


def rag_value(means: DataFrame, metric: str = "correctness") -> DataFrame:
    """One row: the metric with retrieval less the metric without."""
    def of(config: str) -> Column:
        return F.max(F.when(F.col("config") == config, F.col("value")))

    return means.where(F.col("metric") == metric).agg((of("hybrid") - of("no_rag")).alias("rag_value"))
