"""Telemetry queries: events stand for requests and attempts, line items for usage, conversations for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import continuous_percentiles, nearest_rank
from quillon.functions.text import normalize_question, pseudonym, question_hash, seeded_rank, snippet
from quillon.operators import indexing
from quillon.operators import telemetry as m
from quillon.plans.registry import Tables, query, r6
from quillon.sources.readers import valid_questions

ASOF = "2024-01-20 12:00:00"
TTL = 6 * 3600


def requests(t: Tables) -> DataFrame:
    """Requests: errors failed, views were answered from the cache, every tenth user is the evaluation."""
    hit = F.col("event_type") == "view"
    return t.events.select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("key"), F.concat(F.lit("question "), F.col("event_id") % 97).alias("question"),
        F.when(F.col("event_type") == "error", "failed").otherwise("answered").alias("outcome"), hit.alias("cache_hit"), F.col("value").alias("latency_ms"),
        F.when(F.col("user_id") % 10 == 0, "eval").otherwise("public").alias("source"), (F.col("value") / 10000).alias("cost_usd"), F.col("event_type"),
        F.get_json_object("props", "$.k").cast("double").alias("embed_ms"), F.when(~hit, F.col("value")).alias("retrieval_ms"),
    )


REQ = """req as (select event_id as request_id, ts as created_at, user_id::varchar as key, 'question ' || (event_id % 97) as question,
  case when event_type = 'error' then 'failed' else 'answered' end as outcome, event_type = 'view' as cache_hit, value as latency_ms,
  case when user_id % 10 = 0 then 'eval' else 'public' end as source, value / 10000 as cost_usd, event_type,
  json_extract_string(props, '$.k')::double as embed_ms, case when event_type <> 'view' then value end as retrieval_ms from events)"""


@query("E11_daily_stats", f"""with {REQ} select date_trunc('day', created_at)::date::varchar as day, count(*) as requests, count_if(outcome = 'answered') as answered, count_if(outcome = 'failed') as failed,
 count_if(cache_hit) as cache_hits, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95 from req group by 1""")  # fmt: skip
def daily_stats(t: Tables) -> DataFrame:
    return m.daily_stats(requests(t)).select(F.to_date("day").cast("string").alias("day"), "requests", "answered", "failed", "cache_hits", r6("p50"), r6("p95"))


@query("B8_public_requests", f"with {REQ} select request_id, key from req where source = 'public' and not cache_hit and created_at >= timestamp '{ASOF}' - interval 7 day and created_at < timestamp '{ASOF}'")
def public_requests(t: Tables) -> DataFrame:
    return m.public_requests(requests(t), F.lit(ASOF).cast("timestamp")).select("request_id", "key")


@query("E12_stage_latency", f"""with {REQ}, x as (select * from req where source = 'public' and not cache_hit and created_at >= timestamp '{ASOF}' - interval 7 day and created_at < timestamp '{ASOF}'),
 long as (select 'latency_ms' as stage, latency_ms as ms from x union all select 'embed_ms', embed_ms from x union all select 'retrieval_ms', retrieval_ms from x)
 select stage, count(ms) as n, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95 from long where ms is not null group by stage""")  # fmt: skip
def stage_latency(t: Tables) -> DataFrame:
    rows = m.public_requests(requests(t), F.lit(ASOF).cast("timestamp"))
    return m.stage_latency(rows, ["latency_ms", "embed_ms", "retrieval_ms"]).select("stage", "n", r6("p50"), r6("p95"))


@query("E13_metrics_summary", f"with {REQ} select count(*) as requests, round(count_if(cache_hit) / count(*)::double, 6) as hit_rate, round(count_if(outcome = 'failed') / count(*)::double, 6) as failure_rate, round(1000 * avg(cost_usd), 6) as cost_per_1k from req")
def summary(t: Tables) -> DataFrame:
    return m.summary(requests(t)).select("requests", *map(r6, ("hit_rate", "failure_rate", "cost_per_1k")))


@query("E14_outcome_shares", f"with {REQ} select event_type as outcome, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from req group by 1")
def outcome_shares(t: Tables) -> DataFrame:
    return m.outcome_shares(requests(t).drop("outcome").withColumnRenamed("event_type", "outcome")).select("outcome", "n", r6("share"))


@query("F5_latest_per_group", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest(t: Tables) -> DataFrame:
    return m.latest(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("E7_nearest_rank", """with x as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events)
 select event_type, max(n) as n, max(case when rn = (50 * n + 99) // 100 then value end) as p50, max(case when rn = (95 * n + 99) // 100 then value end) as p95 from x group by event_type""")  # fmt: skip
def nearest(t: Tables) -> DataFrame:
    return nearest_rank(t.events, "value", {"p50": 50, "p95": 95}, ["event_type"])


@query("E8_percentile_cont", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def percentile_cont(t: Tables) -> DataFrame:
    found = continuous_percentiles(t.events, "value", {"p50": 0.5, "p99": 0.99}, ["event_type"])
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query("E33_latency_samples", "select event_type as step, case when user_id % 2 = 0 then 'warm' else 'cold' end as phase, count(*) as n, min(value) as min_ms, round(quantile_cont(value, 0.5), 6) as median_ms, max(value) as max_ms from events group by 1, 2")
def latency_samples(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("step"), F.when(F.col("user_id") % 2 == 0, "warm").otherwise("cold").alias("phase"), F.col("value").alias("ms"))
    return m.latency_samples(rows).withColumn("median_ms", F.round("median_ms", 6))


@query("E35_rerank_stats", """with x as (select value, event_type = 'view' as hit, row_number() over (partition by event_type = 'view' order by value) as rn from events), n as (select count_if(not hit) as live, count_if(hit) as hits from x)
 select live as live_calls, hits as cache_hits, max(case when not hit and rn = (50 * live + 99) // 100 then value end) as p50, max(case when not hit and rn = (95 * live + 99) // 100 then value end) as p95 from x, n group by live, hits""")  # fmt: skip
def rerank_stats(t: Tables) -> DataFrame:
    rows = t.events.withColumn("hit", F.col("event_type") == "view")
    live = nearest_rank(rows.where("not hit").withColumn("all", F.lit(1)), "value", {"p50": 50, "p95": 95}, ["all"])
    counts = rows.agg(F.count_if(~F.col("hit")).alias("live_calls"), F.count_if("hit").alias("cache_hits"))
    return counts.join(F.broadcast(live.select("p50", "p95")), F.lit(True))


# --- usage and cost ---


def usage(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    return t.lineitem.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("request_id"), F.when(F.col("l_linenumber") == 7, "fake").otherwise("llm").alias("provider"), "model",
        (F.col("l_quantity") * 100).cast("long").alias("input_tokens"), (F.col("l_quantity") * 10).cast("long").alias("output_tokens"), F.col("l_linenumber").cast("long").alias("searches"), "l_shipdate",
    )


def prices(t: Tables) -> DataFrame:
    """A price list by brand; one brand is unverified, one is missing."""
    p = F.min("p_retailprice")
    rows = t.part.where("p_brand <> 'Brand#2'").groupBy(F.col("p_brand").alias("model")).agg((p / 1000).cast("decimal(12,6)").alias("input_per_mtok"), (p / 250).cast("decimal(12,6)").alias("output_per_mtok"), F.lit(2).cast("decimal(12,6)").alias("per_1k_searches"))
    return rows.withColumn("status", F.when(F.col("model") == "Brand#3", "unverified").otherwise("verified"))


USAGE = """usage as (select l_orderkey as request_id, case when l_linenumber = 7 then 'fake' else 'llm' end as provider, p_brand as model, (l_quantity * 100)::bigint as input_tokens,
  (l_quantity * 10)::bigint as output_tokens, l_linenumber::bigint as searches, l_shipdate from lineitem join part on l_partkey = p_partkey),
 prices as (select p_brand as model, min(p_retailprice) / 1000 as i, min(p_retailprice) / 250 as o, case when p_brand = 'Brand#3' then 'unverified' else 'verified' end as status from part where p_brand <> 'Brand#2' group by p_brand)"""


@query("E15_shadow_cost", f"""with {USAGE} select request_id, round(sum(case when provider = 'fake' then 0 else input_tokens::decimal(12,0) * i::decimal(12,6) + output_tokens::decimal(12,0) * o::decimal(12,6) + searches::decimal(12,0) * 2000 end), 2)::double as cost_micro_usd
 from usage left join prices using (model) where provider = 'fake' or status = 'verified' group by request_id""")  # fmt: skip
def shadow_cost(t: Tables) -> DataFrame:
    return m.shadow_cost(usage(t), prices(t))[0].select("request_id", (F.col("cost_usd") * 1_000_000).cast("decimal(24,2)").cast("double").alias("cost_micro_usd"))


@query("D15_price_problems", f"with {USAGE} select model, case when status is null then 'unknown_model' else 'unverified_price' end as rule, count(*) as n from usage left join prices using (model) where provider <> 'fake' and status is distinct from 'verified' group by 1, 2")
def price_problems(t: Tables) -> DataFrame:
    return m.shadow_cost(usage(t), prices(t))[1].groupBy("model", "rule").agg(F.count("*").alias("n"))


@query("A8_price_table", f"with {USAGE} select model, round(i, 6) as input_per_mtok, status from prices")
def price_table(t: Tables) -> DataFrame:
    return prices(t).select("model", F.col("input_per_mtok").cast("double").alias("input_per_mtok"), "status")


@query("E32_daily_usage", f"with {USAGE} select l_shipdate::date::varchar as day, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from usage group by 1")
def daily_usage(t: Tables) -> DataFrame:
    return m.usage_totals(usage(t).withColumn("day", F.to_date("l_shipdate").cast("string")), "day")


@query("E34_usage_totals", f"with {USAGE} select request_id, provider, model, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from usage group by 1, 2, 3")
def usage_totals(t: Tables) -> DataFrame:
    return m.usage_totals(usage(t), "request_id", "provider", "model")


# --- counters ---



@query("J1_rate_decisions", """with a as (select event_id, user_id::varchar as key, ts, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 1 as in_minute from events),
 b as (select *, sum(in_minute::int) over (partition by key, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) as used from a),
 c as (select *, case when not in_minute then 'minute' when used > 2 then 'day' end as rejected_by from b)
 select event_id, key, rejected_by is null as allowed, rejected_by, case rejected_by when 'minute' then greatest(1, ceil(60 - (epoch_us(ts) - epoch_us(date_trunc('minute', ts)::timestamp)) / 1e6))::int
   when 'day' then greatest(1, ceil(86400 - (epoch_us(ts) - epoch_us(date_trunc('day', ts)::timestamp)) / 1e6))::int else 0 end as retry_after_s from c""")  # fmt: skip
def rate_decisions(t: Tables) -> DataFrame:
    events = t.events.select("event_id", F.col("user_id").cast("string").alias("key"), "ts")
    return m.rate_decisions(events, 1, 2).drop("ts")


@query("F14_window_position", "select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as position from events")
def window_position(t: Tables) -> DataFrame:
    day = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return t.events.select("event_id", F.row_number().over(day).cast("long").alias("position"))


@query("J2_budget_decisions", "select event_id as call_id, row_number() over (partition by date_trunc('day', ts) order by ts, event_id) <= 100 as admitted from events")
def budget_decisions(t: Tables) -> DataFrame:
    return m.budget_decisions(t.events.select(F.col("event_id").alias("call_id"), "ts"), 100).drop("ts")


@query("J3_daily_tokens", "select date_trunc('day', ts)::date::varchar as day, count(*) as calls, sum(floor(value)::bigint)::bigint as tokens from events group by 1")
def daily_tokens(t: Tables) -> DataFrame:
    rows = t.events.withColumn("tokens", F.floor("value").cast("long"))
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@query("J4_cache_classify", f"""with recursive x as (select user_id % 40 as key, event_id, epoch_us(ts) as t, event_type <> 'error' as storable, row_number() over (partition by user_id % 40 order by ts, event_id) as rn from events),
 f as (select key, event_id, rn, case when storable then t + {TTL}000000 end as until, case when storable then 'miss' else 'uncached' end as kind, 0 as hits from x where rn = 1
   union all select x.key, x.event_id, x.rn, case when x.t < f.until then f.until when x.storable then x.t + {TTL}000000 else f.until end,
     case when x.t < f.until then 'hit' when x.storable then 'miss' else 'uncached' end, case when x.t < f.until then f.hits + 1 when x.storable then 0 else f.hits end
   from f join x on x.key = f.key and x.rn = f.rn + 1)
 select key, event_id as request_id, kind, hits from f""")  # fmt: skip
def cache_classify(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 40).alias("key"), F.col("event_id").alias("request_id"), "ts", (F.col("event_type") != "error").alias("storable"))
    return m.cache_classify(rows, TTL)


def attempts(t: Tables) -> DataFrame:
    wait = F.when(F.col("event_type") == "click", F.col("value").cast("int"))
    return t.events.select((F.col("user_id") % 5).cast("string").alias("provider"), F.col("event_id").alias("attempt_id"), "ts", F.when(F.col("event_type") == "view", "ok").otherwise("failed").alias("outcome"), wait.alias("retry_after_s"))


OPENINGS = """a as (select (user_id % 5)::varchar as provider, event_id, ts, event_type = 'view' as ok, case when event_type = 'click' then trunc(value)::int end as wait, sum((event_type = 'view')::int) over (partition by user_id % 5 order by ts, event_id) as run from events),
 b as (select *, lag(ts, 2) over (partition by provider, run order by ts, event_id) as first from a where not ok),
 o as (select provider, ts as opened_at, ts + to_seconds(greatest(30, least(coalesce(wait, 0), 3600))) as reopen_at from b where first is not null and epoch_us(ts) - epoch_us(first) <= 3600000000)"""


@query("F17_failure_openings", f"with {OPENINGS} select provider, epoch_us(opened_at) as opened_us, epoch_us(reopen_at) as reopen_us from o")
def failure_openings(t: Tables) -> DataFrame:
    rows = m.failure_openings(attempts(t), 3, 3600)
    return rows.select("provider", m.micros(F.col("opened_at")).alias("opened_us"), m.micros(F.col("reopen_at")).alias("reopen_us"))


@query("J5_outage_intervals", f"""with {OPENINGS}, n as (select *, coalesce(opened_at > max(reopen_at) over (partition by provider order by opened_at, reopen_at rows between unbounded preceding and 1 preceding), true)::int as new from o),
 g as (select *, sum(new) over (partition by provider order by opened_at, reopen_at rows unbounded preceding) as g from n) select provider, epoch_us(min(opened_at)) as start_us, epoch_us(max(reopen_at)) as end_us from g group by provider, g""")  # fmt: skip
def outage_intervals(t: Tables) -> DataFrame:
    rows = m.outage_intervals(attempts(t), failures=3, within_s=3600)
    return rows.select("provider", m.micros(F.col("start")).alias("start_us"), m.micros(F.col("end")).alias("end_us"))


@query("J6_retention", f"""with {REQ} select request_id, case when created_at >= timestamp '{ASOF}' - interval 5 day then question end as question, case when created_at >= timestamp '{ASOF}' - interval 5 day then key end as key
 from req where created_at >= timestamp '{ASOF}' - interval 15 day""")  # fmt: skip
def retention(t: Tables) -> DataFrame:
    return m.retention(requests(t), F.lit(ASOF).cast("timestamp"), 5, 15).select("request_id", "question", "key")


@query("J6_retention_counts", f"with {REQ} select count_if(created_at < timestamp '{ASOF}' - interval 5 day) as texts_removed, count_if(created_at < timestamp '{ASOF}' - interval 15 day) as rows_deleted from req")
def retention_counts(t: Tables) -> DataFrame:
    return m.retention_counts(requests(t), F.lit(ASOF).cast("timestamp"), 5, 15)


@query("I21_window_wait", "select event_id, greatest(1, ceil(60 - (epoch_us(ts) - epoch_us(date_trunc('minute', ts)::timestamp)) / 1e6))::int as minute_wait from events")
def window_wait(t: Tables) -> DataFrame:
    return t.events.select("event_id", m.window_end_wait(F.col("ts"), "minute").alias("minute_wait"))


@query("I22_next_midnight", "select event_id, epoch_us((((ts::timestamp at time zone 'UTC') at time zone 'America/Los_Angeles')::date + 1)::timestamp at time zone 'America/Los_Angeles') as midnight_us from events")
def next_midnight(t: Tables) -> DataFrame:
    return t.events.select("event_id", m.micros(m.next_midnight(F.col("ts"), "America/Los_Angeles")).alias("midnight_us"))


@query("I23_json_access", "select json_extract_string(props, '$.k')::int as k, count(*) as n from events group by 1")
def json_access(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


# --- questions ---

NORMAL = "regexp_replace(trim(regexp_replace(lower(text), '[\\s\\p{Z}]+', ' ', 'g')), '[ .,;:!?…。]+$', '')"


@query("I1_normalize_question", f"select conv_id, turn, {NORMAL} as normalized from conversations where role = 'user'")
def normalized(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", normalize_question(F.col("text")).alias("normalized"))


@query("I2_question_hash", f"select sha256({NORMAL}) as question_hash, count(*) as n from conversations where role = 'user' group by 1")
def hashed(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").groupBy(question_hash(F.col("text")).alias("question_hash")).agg(F.count("*").alias("n"))


KEY = b"key of this table"
PADS = {name: bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for name, pad in (("outer", 0x5C), ("inner", 0x36))}


@query("I3_pseudonym", "select c_custkey, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(c_name)))) as pseudonym from customer".format(**PADS))
def pseudonyms(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


@query("I8_snippet", """with x as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations)
 select conv_id, turn, case when length(t) <= 300 then t else regexp_replace(case when regexp_matches(substr(t, 301, 1), '\\S') then regexp_replace(substr(t, 1, 300), '^((?s:.)+)[ \\n\\t][^ \\n\\t]*$', '\\1') else substr(t, 1, 300) end, '\\s+$', '') end as snippet from x""")  # fmt: skip
def snippets(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", snippet(F.col("text")).alias("snippet"))


@query("I15_seeded_rank", "select item_id, sha256('7' || chr(31) || 'item' || chr(31) || item_id) as rank from benchmark")
def seeded(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", seeded_rank(7, "item", F.col("item_id").cast("string")).alias("rank"))


@query("I17_cache_key", "select conv_id, turn, sha256('[\"' || role || '\",\"' || conv_id || '\"]') as key from conversations")
def cache_key(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.sha2(F.to_json(F.array("role", F.col("conv_id").cast("string"))), 256).alias("key"))


@query("B9_question_admission", """with x as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as q from conversations)
 select case when length(q) < 3 then 'too_short' when length(q) > 500 then 'too_long' when regexp_matches(q, '[\\x00-\\x1f\\x7f-\\x9f]') then 'control_character' else 'admitted' end as rule, count(*) as n from x group by 1""")  # fmt: skip
def admission(t: Tables) -> DataFrame:
    ok, rejected = valid_questions(t.conversations.withColumnRenamed("text", "question"))
    return ok.select(F.lit("admitted").alias("rule")).unionByName(rejected.select("rule")).groupBy("rule").agg(F.count("*").alias("n"))


# --- content-addressed caches ---


def keyed(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.conversations.select(F.sha2("text", 256).alias("key"), F.concat_ws("-", "conv_id", "turn").alias("value"), "conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))
    first = rows.where("conv_id % 3 = 0").groupBy("key").agg(F.min_by("value", "seq").alias("value"))
    return rows.where("conv_id % 3 <> 0"), first


KEYED = """rows as (select sha256(text) as key, conv_id || '-' || turn as value, conv_id, conv_id * 100 + turn as seq from conversations),
 cache as (select key, arg_min(value, seq) as value from rows where conv_id % 3 = 0 group by key), new as (select * from rows where conv_id % 3 <> 0)"""


@query("A14_cache_put", f"with {KEYED} select * from cache union all select key, arg_min(value, seq) from new where key not in (select key from cache) group by key")
def cache_put(t: Tables) -> DataFrame:
    new, cache = keyed(t)
    return indexing.cache_put(cache, new)


@query("D10_cache_lookup", f"with {KEYED} select seq, n.key, c.value from new n left join cache c on n.key = c.key")
def cache_lookup(t: Tables) -> DataFrame:
    new, cache = keyed(t)
    return indexing.cache_lookup(new.select("seq", "key"), cache)


@query("C22_uncached_count", f"with {KEYED} select count(distinct key) as uncached from new where key not in (select key from cache)")
def uncached(t: Tables) -> DataFrame:
    new, cache = keyed(t)
    return indexing.uncached(new, cache)


@query("A14_cache_delete", f"with {KEYED} select key, value from cache where key not in (select key from new)")
def cache_delete(t: Tables) -> DataFrame:
    new, cache = keyed(t)
    return indexing.cache_delete(cache, new.select("key"))
