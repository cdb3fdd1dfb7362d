"""Request telemetry: statistics, cost, counters, cache classification, outages, retention.

Requests: request_id, created_at, key (pseudonym), outcome, latency_ms, ... Every rule that needs "now" takes ``asof``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import continuous_percentiles
from quillon.sources.store import stored

LONGEST_WAIT = 3600


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the timestamp's own clock, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def daily_stats(requests: DataFrame) -> DataFrame:
    """Per UTC day: counts by outcome, exact continuous percentiles of latency."""
    rows = requests.withColumn("day", F.date_trunc("day", "created_at"))
    counts = rows.groupBy("day").agg(
        F.count("*").alias("requests"), F.count_if(F.col("outcome") == "answered").alias("answered"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if("cache_hit").alias("cache_hits"),
    )
    latency = continuous_percentiles(rows, "latency_ms", {"p50": 0.5, "p95": 0.95}, ["day"]).drop("n")
    return counts.join(latency.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")), "left").drop("_day")


def public_requests(requests: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Public, not replayed, of the last ``days`` days."""
    return requests.where((F.col("source") == "public") & ~F.col("cache_hit") & (F.col("created_at") >= asof - F.make_interval(days=F.lit(days))) & (F.col("created_at") < asof))


def stage_latency(requests: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, p50, p95); a stage that did not run is null and does not count."""
    long = requests.unpivot(["request_id"], stages, "stage", "ms").where("ms is not null")
    return continuous_percentiles(long, "ms", {"p50": 0.5, "p95": 0.95}, ["stage"])


def summary(requests: DataFrame) -> DataFrame:
    """One row of rates, null without requests."""
    n = F.count("*")
    return requests.agg(
        n.alias("requests"), F.try_divide(F.count_if("cache_hit"), n).alias("hit_rate"), F.try_divide(F.count_if(F.col("outcome") == "failed"), n).alias("failure_rate"),
        (1000 * F.avg("cost_usd")).alias("cost_per_1k"),
    )


def outcome_shares(requests: DataFrame) -> DataFrame:
    """(outcome, n, share)."""
    by = requests.groupBy("outcome").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def latest(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in ``order``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def shadow_cost(usage: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(costs, problems): per request the decimal cost with 8 places; usage without a verified price is a problem.

    usage: request_id, provider, model, input_tokens, output_tokens, searches; the price list is small and checked by its
    caller's table, so Spark chooses how to join it.
    """
    priced = usage.join(prices, "model", "left")
    free = F.col("provider") == "fake"
    problem = F.when(~free & F.col("status").isNull(), "unknown_model").when(~free & (F.col("status") != "verified"), "unverified_price")
    part = sum(
        (F.coalesce(F.col(units), F.lit(0)).cast("decimal(18,0)") * F.coalesce(F.col(price), F.lit(0)).cast("decimal(12,6)") / F.lit(per).cast("decimal(10,0)")
         for units, price, per in (("input_tokens", "input_per_mtok", 1_000_000), ("output_tokens", "output_per_mtok", 1_000_000), ("searches", "per_1k_searches", 1000))),
        F.lit(0).cast("decimal(12,8)"),
    )
    rows = priced.withColumn("rule", problem)
    cost = F.sum(F.when(free, F.lit(0).cast("decimal(30,12)")).otherwise(part.cast("decimal(30,12)")))
    costs = rows.where("rule is null").groupBy("request_id").agg(cost.cast("decimal(20,8)").alias("cost_usd"))
    return costs, rows.where("rule is not null").select("request_id", "model", "rule")


def usage_totals(attempts: DataFrame, *by: str) -> DataFrame:
    return attempts.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def window_end_wait(ts: Column, unit: str) -> Column:
    """Whole seconds to the end of the window, 1 at least."""
    span = {"minute": 60, "day": 86400}[unit]
    left = span - (micros(ts) - micros(F.date_trunc(unit, ts))) / 1e6
    return F.greatest(F.lit(1), F.ceil(left)).cast("int")


def rate_decisions(events: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """events (key, ts, event_id) with allowed, rejected_by, retry_after_s, in the order of (ts, event_id).

    A request that its minute rejects does not touch the day's counter; a null key is always admitted.
    """
    rows = events.where("key is not null").withColumn("_minute", F.date_trunc("minute", "ts"))
    first = rows.withColumn("_m", F.row_number().over(Window.partitionBy("key", "_minute").orderBy("ts", "event_id")))
    # What a minute admits is counted per minute, so the day's window runs over minutes, not over requests.
    minutes = rows.groupBy(F.col("key").alias("_k"), F.col("_minute").alias("_of")).agg(F.least(F.count("*"), F.lit(per_minute)).alias("_c"))
    before = Window.partitionBy("_k", F.date_trunc("day", "_of")).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select("_k", "_of", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    second = first.join(minutes, (F.col("key") == F.col("_k")) & F.col("_minute").eqNullSafe(F.col("_of")))
    in_minute = F.col("_m") <= per_minute
    by = F.when(~in_minute, "minute").when(F.col("_before") + F.col("_m") > per_day, "day")
    wait = F.when(by == "minute", window_end_wait(F.col("ts"), "minute")).when(by == "day", window_end_wait(F.col("ts"), "day")).otherwise(0)
    done = second.select(*events.columns, by.isNull().alias("allowed"), by.alias("rejected_by"), wait.alias("retry_after_s"))
    free = events.where("key is null").select("*", F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("rejected_by"), F.lit(0).alias("retry_after_s"))
    return done.unionByName(free)


def budget_decisions(calls: DataFrame, limit: int) -> DataFrame:
    """calls (call_id, ts) with admitted: the first ``limit`` of each UTC day.

    Calls are counted per minute; a call's place in its day is that in its minute behind the minutes before.
    """
    rows = calls.withColumn("_minute", F.date_trunc("minute", "ts"))
    minutes = rows.groupBy("_minute").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(F.date_trunc("day", "_minute")).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select(F.col("_minute").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_minute").orderBy("ts", "call_id"))
    placed = rows.withColumn("_place", inner).join(minutes, F.col("_minute").eqNullSafe(F.col("_of")))
    return placed.select(*calls.columns, (F.col("_before") + F.col("_place") <= limit).alias("admitted"))


def opening_requests(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """(key, request_id, at) of the storable requests that open an entry; at is struct(t, id), t in microseconds.

    A request opens an entry if none lives. So the opening after one at t is the first storable request at t + ttl or later: its
    successor. Time is cut into slices of a ttl: a successor is in the next slice, or the first of the one after; beyond that, the request follows
    a pause of a ttl, and such requests (and the first) open in any case. All requests reachable from these along successors open; pointers of doubled
    length reach them in as many rounds as the longest chain has binary digits. No request is gathered by key: a slice of a key is the unit.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.struct(micros(F.col("ts")).alias("t"), F.col("request_id").alias("id"))
    rows = requests.where(F.col("storable") & F.col("key").isNotNull()).select("key", at.alias("at"))
    rows = stored(rows.withColumn("slice", F.floor(F.col("at.t") / ttl)), "storable-requests")
    ends = rows.groupBy("key", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    earlier = rows.join(ends.select("key", (F.col("slice") + 1).alias("slice"), F.col("last").alias("slice_before")), ["key", "slice"], "left")
    order = Window.partitionBy("key", "slice").orderBy("at")
    before = F.coalesce(F.lag("at").over(order), "slice_before")
    roots = earlier.withColumn("before", before).where(F.col("before").isNull() | (F.col("at.t") - F.col("before.t") >= ttl)).select("key", "at")

    # The first request of the next slice at t + ttl or later: the nearest one behind it among requests and wanted times.
    nothing = F.lit(None).cast(rows.schema["at"].dataType)
    wanted = rows.select("key", (F.col("slice") + 1).alias("slice"), (F.col("at.t") + ttl).alias("t"), F.lit(0).alias("side"), F.col("at.id").alias("id"), nothing.alias("found"), F.col("at").alias("of"))
    there = rows.select("key", "slice", F.col("at.t").alias("t"), F.lit(1).alias("side"), F.col("at.id").alias("id"), F.col("at").alias("found"), nothing.alias("of"))
    back = Window.partitionBy("key", "slice").orderBy(F.desc("t"), F.desc("side"), F.desc("id"))
    near = wanted.unionByName(there).withColumn("next", F.last("found", ignorenulls=True).over(back)).where("of is not null")
    far = near.join(ends.select("key", (F.col("slice") - 1).alias("slice"), F.col("first").alias("slice_after")), ["key", "slice"], "left")
    jumps = far.select("key", F.col("of").alias("at"), F.coalesce("next", "slice_after").alias("to")).where("to is not null")

    opened, jumps = stored(roots, "openings"), stored(jumps, "successors")
    while True:
        reached = opened.join(jumps, ["key", "at"]).select("key", F.col("to").alias("at"))
        new = stored(reached.join(opened, ["key", "at"], "left_anti").distinct(), "openings")
        if new.isEmpty():
            return opened.select("key", F.col("at.id").alias("request_id"), "at")
        opened = stored(opened.unionByName(new), "openings")
        onward = jumps.select("key", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = stored(jumps.join(onward, ["key", "to"]).select("key", "at", F.col("beyond").alias("to")), "successors")


def cache_classify(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Per key the ordered requests as hit, miss or uncached, with the hits of their entry so far.

    A storable miss opens an entry that lives ``ttl_seconds`` whatever hits it gets; a miss that may not be stored opens none, and shows the hits
    of the entry before it. A slice of a ttl holds at most one opening, so a request's entry is that of its slice or the last one before; only
    slices are put in order by key.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.struct(micros(F.col("ts")).alias("t"), F.col("request_id").alias("id"))
    rows = requests.select("key", "request_id", at.alias("at")).withColumn("slice", F.floor(F.col("at.t") / ttl))
    opened = opening_requests(requests, ttl_seconds).select("key", F.floor(F.col("at.t") / ttl).alias("slice"), F.col("at").alias("own"))
    slices = rows.where("key is not null").select("key", "slice").distinct().join(opened, ["key", "slice"], "left")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.last("own", ignorenulls=True).over(earlier))
    placed = rows.join(slices, ["key", "slice"], "left")
    entry = F.when(F.col("own") <= F.col("at"), F.col("own")).otherwise(F.col("before"))
    placed = placed.withColumn("entry", entry).withColumn("live", F.coalesce(F.col("at.t") < F.col("entry.t") + ttl, F.lit(False)))
    placed = stored(placed.select("key", "request_id", "at", "entry", "live"), "placed-requests")
    counted = placed.where("live").withColumn("hits", F.row_number().over(Window.partitionBy("key", "entry").orderBy("at")) - 1)
    of_entry = placed.where("live").groupBy("key", "entry").agg((F.count("*") - 1).alias("hits"))
    late = placed.where("not live").join(of_entry, ["key", "entry"], "left")
    kind = F.when(F.col("entry") == F.col("at"), "miss").otherwise("hit")
    found = counted.select("key", "request_id", kind.alias("kind"), F.col("hits").cast("int").alias("hits"))
    return found.unionByName(late.select("key", "request_id", F.lit("uncached").alias("kind"), F.coalesce("hits", F.lit(0)).cast("int").alias("hits")))


def with_context(rows: DataFrame, ts: str, span_s: int) -> DataFrame:
    """``rows`` in buckets ``_b`` of ``span_s`` seconds, each row once as itself (``_own``) and once as context of the next bucket.

    What lies at most ``span_s`` before a row is in its bucket, so a window per bucket replaces one per key of all times.
    """
    own = F.floor(micros(F.col(ts)) / (span_s * 1_000_000))
    found = rows.withColumn("_own_b", own).withColumn("_b", F.explode(F.array(own, own + 1)))
    return found.withColumn("_own", F.col("_b") == F.col("_own_b")).drop("_own_b")


def failure_openings(attempts: DataFrame, failures: int = 3, within_s: int = 60, open_s: int = 30) -> DataFrame:
    """(provider, opened_at, reopen_at): where ``failures`` failures in a row fall within ``within_s`` seconds.

    Only attempts of the last ``within_s`` seconds count, so these are looked at in buckets of that span with the bucket before; the wait
    is the longer of the standard and the attempt's own.
    """
    order = Window.partitionBy("provider", "_b").orderBy("ts", "attempt_id")
    row = with_context(attempts, "ts", within_s)
    back = F.lag("ts", failures - 1).over(order)
    row = row.withColumn("_first", back).withColumn("_good", F.max((F.col("outcome") == "ok").cast("int")).over(order.rowsBetween(1 - failures, 0)))
    near = F.col("_first").isNotNull() & (micros(F.col("ts")) - micros(F.col("_first")) <= within_s * 1_000_000)
    opened = row.where(F.col("_own") & near & (F.col("_good") == 0))
    wait = F.greatest(F.lit(open_s), F.least(F.coalesce("retry_after_s", F.lit(0)), F.lit(LONGEST_WAIT)))
    return opened.select("provider", F.col("ts").alias("opened_at"), (F.col("ts") + F.make_dt_interval(secs=wait)).alias("reopen_at"))


def outage_intervals(attempts: DataFrame, failures: int = 3, within_s: int = 60, open_s: int = 30) -> DataFrame:
    """(provider, start, end): overlapping openings merged.

    No opening lasts longer than a bucket, so whether one begins an interval shows in its bucket and the one before; the last
    beginning before a bucket comes from a table of one row per bucket.
    """
    span = max(open_s, LONGEST_WAIT)
    found = with_context(failure_openings(attempts, failures, within_s, open_s), "opened_at", span)
    order = Window.partitionBy("provider", "_b").orderBy("opened_at", "reopen_at")
    so_far = F.max("reopen_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("opened_at") > so_far, F.lit(True))
    found = found.withColumn("_start", F.when(begins, F.col("opened_at"))).where("_own")
    buckets = found.groupBy(F.col("provider").alias("_p"), F.col("_b").alias("_pb")).agg(F.max("_start").alias("_s"))
    earlier = Window.partitionBy("_p").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_carry", F.max("_s").over(earlier))
    found = found.withColumn("_in", F.last("_start", ignorenulls=True).over(order))
    found = found.join(buckets, F.col("provider").eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_pb")))
    return found.groupBy("provider", F.coalesce("_in", "_carry").alias("start")).agg(F.max("reopen_at").alias("end"))


def retention(requests: DataFrame, asof: Column, text_days: int = 29, row_days: int = 180) -> DataFrame:
    """The requests that stay: old rows go, old texts and pseudonyms become null. Both boundaries are strict."""
    def before(days: int) -> Column:
        return F.col("created_at") < asof - F.make_interval(days=F.lit(days))

    kept = requests.where(~before(row_days))
    return kept.withColumns({c: F.when(~before(text_days), F.col(c)) for c in ("question", "key")})


def retention_counts(requests: DataFrame, asof: Column, text_days: int = 29, row_days: int = 180) -> DataFrame:
    """What ``retention`` would do, without doing it."""
    def before(days: int) -> Column:
        return F.col("created_at") < asof - F.make_interval(days=F.lit(days))

    has_text = F.col("question").isNotNull() | F.col("key").isNotNull()
    return requests.agg(F.count_if(before(text_days) & has_text).alias("texts_removed"), F.count_if(before(row_days)).alias("rows_deleted"))


def next_midnight(ts: Column, zone: str) -> Column:
    """The next local midnight as UTC; days may have 23 or 25 hours."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1).cast("timestamp"), zone)


def latency_samples(rows: DataFrame) -> DataFrame:
    """(step, phase, n, min_ms, median_ms, max_ms); rows without a latency count in n only."""
    ends = rows.groupBy("step", "phase").agg(F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    middle = continuous_percentiles(rows, "ms", {"median_ms": 0.5}, ["step", "phase"]).select(F.col("step").alias("_s"), F.col("phase").alias("_p"), "median_ms")
    same = F.col("step").eqNullSafe(F.col("_s")) & F.col("phase").eqNullSafe(F.col("_p"))
    return ends.join(middle, same, "left").select("step", "phase", "n", "min_ms", "median_ms", "max_ms")
