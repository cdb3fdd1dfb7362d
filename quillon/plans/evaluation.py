"""Evaluation queries: gates, generation metrics, agreement, sampling, golden sets, versions.

Labels stand for ratings (quality and toxicity as two raters), line items for generation cases, orders for verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import content_words, overlap, seeded_rank
from quillon.operators import agreement, answers, gates, indexing
from quillon.operators import metrics as mt
from quillon.plans import retrieval as rq
from quillon.plans.registry import Tables, query, r6

# --- gates over the two retrieval configurations: the full one is the baseline of the coarse one ---


def gate_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run, baseline, info): three metrics gated; nothing known of recall_at_10 in the run; another index for one config."""
    means = mt.config_means(rq.per_question(t))
    run = means.where("config = 'coarse' and metric <> 'recall_at_10'")
    base = means.where("config = 'dense'").select(F.explode(F.array(F.lit("coarse"), F.lit("other"), F.lit("gone"))).alias("config"), "metric", "value")
    tolerance = F.when(F.col("metric").isin("recall_at_5", "recall_at_10", "ndcg_at_5"), 0.04)
    base = base.select("config", "metric", "value", tolerance.alias("tolerance"), F.when(F.col("metric") == "ndcg_at_5", 0.01).alias("floor"), F.lit("g1").alias("golden"), F.when(F.col("config") == "other", "i0").otherwise("i1").alias("index_hash"))
    run = run.unionByName(run.withColumn("config", F.lit("other")))
    info = t.spark.range(1).select(F.lit("g1").alias("golden"), F.lit("i1").alias("index_hash"))
    return run, base, info


GATE = f"""{rq.EVAL}, run as (select c.config, metric, value, n from means, (select unnest(['coarse', 'other']) as config) c where means.config = 'coarse' and metric <> 'recall_at_10'),
 base as (select c.config, metric, value as baseline, case when metric in ('recall_at_5', 'recall_at_10', 'ndcg_at_5') then 0.04 end as tolerance, case when metric = 'ndcg_at_5' then 0.01 end as floor,
   case when c.config = 'other' then 'i0' else 'i1' end as index_hash from means, (select unnest(['coarse', 'other', 'gone']) as config) c where means.config = 'dense'),
 rows as (select config, metric, baseline, value as current, value - baseline as delta,
   case when tolerance is not null then greatest(coalesce(floor, -1e9), baseline - tolerance) end as threshold, coalesce(n, (select max(n) from run)) as n
   from base full join run using (config, metric) where config <> 'gone' and (value is not null or tolerance is not null)),
 judged as (select *, case when threshold is not null then coalesce(current >= threshold - 1e-9, false) end as passed from rows),
 reasons as (select 'gone' as config, 'missing_config' as reason union all select 'other', 'other_setup'
   union all select config, 'missing_metric:recall_at_10' from (select unnest(['coarse', 'other']) as config))"""


@query("B13_gate_rows", f"with {GATE} select config, metric, round(baseline, 6) as baseline, round(current, 6) as current, round(delta, 6) as delta, round(threshold, 6) as threshold, passed, n from judged")
def gate_rows(t: Tables) -> DataFrame:
    run, base, _ = gate_inputs(t)
    return gates.gate_rows(run, base).select("config", "metric", *map(r6, ("baseline", "current", "delta", "threshold")), "passed", "n")


@query("L11_gate_reasons", f"with {GATE} select * from reasons")
def gate_reasons(t: Tables) -> DataFrame:
    return gates.gate_reasons(*gate_inputs(t))


@query("L11_retrieval_gate", f"with {GATE} select 'fail' as status, count_if(not passed) as failed_metrics, count(passed) as gated_metrics, (select count(*) from reasons) as reasons from judged where config <> 'other'")
def retrieval_gate(t: Tables) -> DataFrame:
    return gates.retrieval_gate(*gate_inputs(t))


@query("A6_baseline_upsert", f"""with {GATE} select config, metric, round(baseline, 6) as value, tolerance from base where config = 'gone'
 union all select r.config, r.metric, round(r.value, 6), b.tolerance from run r left join base b using (config, metric)""")  # fmt: skip
def baseline_upsert(t: Tables) -> DataFrame:
    run, base, _ = gate_inputs(t)
    rows = run.select("config", "metric", "value", F.lit("g1").alias("golden"), F.lit("i1").alias("index_hash"))
    return gates.upsert_baseline(base, rows).select("config", "metric", r6("value"), "tolerance")


@query("D18_mixed_setups", f"with {GATE} select config, metric from base where config = 'other'")
def mixed_setups(t: Tables) -> DataFrame:
    _, base, info = gate_inputs(t)
    kept = t.spark.range(2).select(F.when(F.col("id") == 0, "coarse").otherwise("gone").alias("config"))
    return gates.mixed_setups(base, info, kept).select("config", "metric")


@query("B14_target_verdicts", f"with {GATE} select metric, case when value >= 0.5 - 1e-9 then 'met' else 'missed' end as verdict from means where config = 'dense'")
def target_verdicts(t: Tables) -> DataFrame:
    means = mt.config_means(rq.per_question(t)).where("config = 'dense'")
    targets = means.select("metric", F.lit(0.5).alias("target"), F.lit(False).alias("strict"))
    return gates.target_verdict(means, targets).select("metric", "verdict")


# --- generation cases from line items ---


def cases(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ["ProviderTimeout", "ProviderBadOutput", "MalformedInput", "SomethingElse"]))
    failed = F.col("l_partkey") % 9 == 0
    return t.lineitem.select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 4).alias("config"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"),
        F.when(failed, F.get(kinds, (F.col("l_suppkey") % 4).cast("int"))).alias("error_kind"), F.when(F.col("l_linenumber") % 2 == 0, "generator").otherwise("judge").alias("stage"),
        F.col("l_extendedprice").alias("latency_ms"), (F.col("l_linenumber") == 1).alias("cold_start"), (F.col("l_linenumber") == 2).cast("int").alias("llm_cache_hits"), (F.col("l_discount") / 10).alias("cost_usd"), F.col("l_returnflag").alias("grade"),
    )


CASES = """cases as (select 'c' || (l_suppkey % 4) as config, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as id,
  case when l_partkey % 9 = 0 then ['ProviderTimeout', 'ProviderBadOutput', 'MalformedInput', 'SomethingElse'][1 + l_suppkey % 4] end as error_kind,
  case when l_linenumber % 2 = 0 then 'generator' else 'judge' end as stage, l_extendedprice as latency_ms, l_linenumber = 1 as cold_start, (l_linenumber = 2)::int as llm_cache_hits,
  l_discount / 10 as cost_usd, l_returnflag as grade from lineitem)"""
CATEGORY = """case when error_kind = 'ProviderTimeout' then 'provider' when error_kind = 'ProviderBadOutput' and stage = 'generator' then 'generator_bad_output'
  when error_kind = 'ProviderBadOutput' then 'judge_bad_output' when error_kind = 'MalformedInput' then 'malformed_input' when error_kind is not null then 'cannot_run' end"""


@query("E19_error_counts", f"with {CASES}, x as (select distinct config, id, {CATEGORY} as c from cases) select config, " + ", ".join(f"count_if(c = '{c}') as {c}" for c in gates.CATEGORIES) + " from x group by config")
def error_counts(t: Tables) -> DataFrame:
    rows = cases(t).select("config", "id", "stage", F.col("error_kind").alias("kind"), F.array().cast("array<string>").alias("bases"))
    return gates.error_counts(rows)


@query("I19_error_category", f"with {CASES} select error_kind, stage, {CATEGORY} as category, count(*) as n from cases group by all")
def error_category(t: Tables) -> DataFrame:
    named = cases(t).withColumn("category", gates.category(F.col("stage"), F.col("error_kind"), F.array().cast("array<string>")))
    return named.groupBy("error_kind", "stage", "category").agg(F.count("*").alias("n"))


@query("E20_config_summary", f"""with {CASES}, w as (select config, latency_ms, row_number() over (partition by config order by latency_ms) as rn, count(*) over (partition by config) as n from cases where error_kind is null and not cold_start and llm_cache_hits = 0),
 p as (select config, max(n) as n_latency, max(case when rn = (50 * n + 99) // 100 then latency_ms end) as p50, max(case when rn = (95 * n + 99) // 100 then latency_ms end) as p95 from w group by config)
 select config, count(*) as cases, round(1000 * avg(case when error_kind is null then cost_usd end), 6) as cost_per_1k, any_value(n_latency) as n_latency, any_value(p50) as p50, any_value(p95) as p95,
  5 * count_if(error_kind = 'ProviderTimeout') > count(*) as inconclusive from cases join p using (config) group by config""")  # fmt: skip
def config_summary(t: Tables) -> DataFrame:
    from quillon.functions.numbers import nearest_rank

    rows = cases(t)
    latency = nearest_rank(gates.warm(rows), "latency_ms", {"p50": 50, "p95": 95}, ["config"]).withColumnRenamed("n", "n_latency")
    counted = rows.groupBy("config").agg(
        F.count("*").alias("cases"), F.round(1000 * F.avg(F.when(F.col("error_kind").isNull(), F.col("cost_usd"))), 6).alias("cost_per_1k"),
        gates.inconclusive(F.count_if(F.col("error_kind") == "ProviderTimeout"), F.count("*")).alias("inconclusive"),
    )
    return counted.join(latency, "config").select("config", "cases", "cost_per_1k", "n_latency", "p50", "p95", "inconclusive")


@query("B12_warm_cases", f"with {CASES} select config, count(*) as n from cases where error_kind is null and not cold_start and llm_cache_hits = 0 group by config")
def warm_cases(t: Tables) -> DataFrame:
    return gates.warm(cases(t)).groupBy("config").agg(F.count("*").alias("n"))


GRADE = "case grade when 'A' then 1.0 when 'R' then 0.5 else 0.0 end"


@query("E18_correctness", f"with {CASES} select config, count(*) as n, round(avg({GRADE}), 6) as correctness from cases where error_kind is null group by config")
def correctness(t: Tables) -> DataFrame:
    points = F.when(F.col("grade") == "A", 1.0).when(F.col("grade") == "R", 0.5).otherwise(0.0)
    return cases(t).where("error_kind is null").groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(points), 6).alias("correctness"))


@query("E31_rag_value", f"with {CASES}, m as (select config, avg({GRADE}) as v from cases where error_kind is null group by config) select round((select v from m where config = 'c1') - (select v from m where config = 'c2'), 6) as rag_value")
def rag_value(t: Tables) -> DataFrame:
    means = correctness(t).select(F.when(F.col("config") == "c1", "hybrid").when(F.col("config") == "c2", "no_rag").otherwise(F.col("config")).alias("config"), F.lit("correctness").alias("metric"), F.col("correctness").alias("value"))
    exact = cases(t).where("error_kind is null").groupBy("config").agg(F.avg(F.when(F.col("grade") == "A", 1.0).when(F.col("grade") == "R", 0.5).otherwise(0.0)).alias("value"))
    named = exact.select(F.when(F.col("config") == "c1", "hybrid").when(F.col("config") == "c2", "no_rag").otherwise(F.col("config")).alias("config"), F.lit("correctness").alias("metric"), "value")
    return gates.rag_value(named.join(means.select("config"), "config", "left_semi")).select(r6("rag_value"))


@query("E17_faithfulness", """with v as (select o_custkey % 50 as id, o_orderpriority in ('1-URGENT', '2-HIGH') as ok, o_orderkey % 977 = 0 as errored from orders)
 select id, case when bool_or(errored) then 'errored' else 'scored' end as state, case when not bool_or(errored) then round(count_if(ok) / count(*)::double, 6) end as value from v group by id""")  # fmt: skip
def faithfulness(t: Tables) -> DataFrame:
    verdicts = t.orders.select(F.lit("c").alias("config"), (F.col("o_custkey") % 50).alias("id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "SUPPORTED").otherwise("NOT_SUPPORTED").alias("verdict"), (F.col("o_orderkey") % 977 == 0).alias("errored"))
    return answers.faithfulness(verdicts).select("id", "state", r6("value"))


@query("L12_generation_gate", f"""with {CASES}, s as (select config, count_if(error_kind = 'ProviderTimeout') as provider, count(*) as cases from cases group by config), m as (select config, avg({GRADE}) as v from cases where error_kind is null group by config),
 f as (select count_if(v < 0.5 - 1e-9) as failed_metrics from m), d as (select count_if(5 * provider > cases) as inconclusive_configs from s)
 select case when failed_metrics > 0 then 'fail' when inconclusive_configs > 0 then 'inconclusive' else 'pass' end as status, failed_metrics, inconclusive_configs from f, d""")  # fmt: skip
def generation_gate(t: Tables) -> DataFrame:
    rows = cases(t)
    summaries = rows.groupBy("config").agg(F.lit(True).alias("gated"), F.count_if(F.col("error_kind") == "ProviderTimeout").alias("provider"), F.count("*").alias("cases"))
    points = F.when(F.col("grade") == "A", 1.0).when(F.col("grade") == "R", 0.5).otherwise(0.0)
    means = rows.where("error_kind is null").groupBy("config").agg(F.avg(points).alias("value"))
    return gates.generation_gate(means.select("config", gates.passes(F.col("value"), F.lit(0.5)).alias("passed")), summaries)


# --- agreement and sampling ---


def ratings(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("lang").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "control").otherwise("real").alias("source"))
    return t.labels.join(docs, "doc_id").select(F.col("doc_id").alias("item_id"), "kind", "source", F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("human"), F.when(F.col("toxic") == 0, "GOOD").otherwise("BAD").alias("judge"))


RATINGS = """ratings as (select l.doc_id as item_id, lang as kind, case when l.doc_id % 5 = 0 then 'control' else 'real' end as source, case when quality = 1 then 'GOOD' else 'BAD' end as human, case when toxic = 0 then 'GOOD' else 'BAD' end as judge
  from labels l join documents d on l.doc_id = d.doc_id)"""


@query("E22_confusion", f"with {RATINGS} select human, count_if(judge = 'GOOD') as \"GOOD\", count_if(judge = 'BAD') as \"BAD\", count(*) as total from ratings group by human")
def confusion(t: Tables) -> DataFrame:
    return agreement.confusion(ratings(t), ["GOOD", "BAD"])


@query("E24_agreement_scopes", f"""with {RATINGS}, x as (select case grouping_id(kind, source) when 0 then 'kind_source' when 1 then 'kind' when 2 then 'source' else 'pooled' end as scope, kind, source, count(*) as n, count_if(human = judge) as agreed,
   count_if(human = 'GOOD') * count_if(judge = 'GOOD') + count_if(human = 'BAD') * count_if(judge = 'BAD') as e from ratings group by grouping sets ((), (kind), (source), (kind, source)))
 select scope, kind, source, n, agreed, case when e <> n * n then round((agreed * n - e) / (n * n - e)::double, 6) end as kappa, e = n * n as undefined from x""")  # fmt: skip
def agreement_scopes(t: Tables) -> DataFrame:
    return agreement.agreement_scopes(ratings(t)).withColumn("kappa", F.round("kappa", 6))


@query("E23_cohens_kappa", f"""with {RATINGS}, x as (select count(*) as n, count_if(human = judge) as agreed, count_if(human = 'GOOD') * count_if(judge = 'GOOD') + count_if(human = 'BAD') * count_if(judge = 'BAD') as e from ratings)
 select n, agreed, round((agreed * n - e) / (n * n - e)::double, 6) as kappa from x""")  # fmt: skip
def cohens_kappa(t: Tables) -> DataFrame:
    return agreement.agreement_scopes(ratings(t)).where("scope = 'pooled'").select("n", "agreed", r6("kappa"))


@query("D13_sheet_join", f"""with {RATINGS} select 'problem' as part, case when item_id % 11 = 0 then 'missing_item' when item_id % 13 = 0 then 'unknown_label' end as rule, count(*) as n from ratings where item_id % 11 = 0 or item_id % 13 = 0 group by 2
 union all select 'rated', human, count(*) from ratings where item_id % 11 <> 0 and item_id % 13 <> 0 group by 2 union all select 'problem', 'unknown_item', 1""")  # fmt: skip
def sheet_join(t: Tables) -> DataFrame:
    key = ratings(t)
    label = F.when(F.col("item_id") % 13 == 0, "maybe").otherwise(F.concat(F.lit(" "), F.lower("human"), F.lit(" ")))
    sheet = key.where("item_id % 11 <> 0").select("item_id", label.alias("human")).unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("good").alias("human")))
    rated, problems = agreement.rate_items(sheet, key.drop("human"), ["GOOD", "BAD"])
    return rated.select(F.lit("rated").alias("part"), F.col("human").alias("rule")).unionByName(problems.select(F.lit("problem").alias("part"), "rule")).groupBy("part", "rule").agg(F.count("*").alias("n"))


@query("F12_fair_share", f"""with {RATINGS}, x as (select *, row_number() over (partition by human, kind order by sha256('3' || chr(31) || 'draw' || chr(31) || item_id)) as round from ratings),
 y as (select *, row_number() over (order by round, human, kind) as turn from x) select item_id, human, kind from y where turn <= 30""")  # fmt: skip
def fair_share(t: Tables) -> DataFrame:
    rank = seeded_rank(3, "draw", F.col("item_id").cast("string"))
    return agreement.fair_share(ratings(t), ["human", "kind"], 30, rank).select("item_id", "human", "kind")


@query("L16_judge_sample", f"""with {RATINGS}, x as (select *, concat_ws('|', kind, source, item_id) as k from ratings), y as (select *, row_number() over (partition by human, kind order by sha256('5' || chr(31) || 'item' || chr(31) || k)) as round from x),
 z as (select *, row_number() over (order by round, human, kind) as turn from y) select k, 'a' || lpad(row_number() over (order by sha256('5' || chr(31) || 'id' || chr(31) || k))::varchar, 2, '0') as item_id from z where turn <= 25""")  # fmt: skip
def judge_sample(t: Tables) -> DataFrame:
    rows = ratings(t).select(F.col("human").alias("verdict"), F.col("kind").alias("config"), F.col("source").alias("question_id"), F.col("item_id").cast("string").alias("item"))
    chosen = agreement.judge_sample(rows, 25, 5)
    return chosen.select(F.concat_ws("|", "config", "question_id", "item").alias("k"), "item_id")


@query("E30_calibration", "select case when o_totalprice / 500000 < 0.5 then 'low' when o_totalprice / 500000 <= 0.8 then 'mid' else 'high' end as bucket, count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as supported_rate from orders group by 1")
def calibration(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_totalprice") / 500000).alias("confidence"), (F.col("o_orderstatus") == "F").alias("supported"))
    return agreement.calibration(rows).select("bucket", "n", r6("supported_rate"))


WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda w: w not in ({})))"


def control_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(claims, sources): a conversation's first and last text; its section is one of seven."""
    q = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("claim"), F.max_by("text", "turn").alias("source"))
    words = q.select("conv_id", "claim", "source", content_words(F.col("claim")).alias("words"), content_words(F.col("source")).alias("source_words"), F.array((F.col("conv_id") % 7).cast("string")).alias("sections"))
    claims = words.select(F.col("conv_id").alias("question_id"), "sections", "words", "claim")
    return claims, words.select(F.col("conv_id").alias("source_question"), F.col("sections").alias("source_sections"), "source_words", "source")


CONTROLS = f"""q as (select conv_id, arg_min(text, turn) as claim, arg_max(text, turn) as source from conversations group by conv_id),
 w as (select conv_id, claim, source, {WORDS.format('claim', rq.STOPS)} as x, {WORDS.format('source', rq.STOPS)} as y from q),
 donors as (select conv_id, x, conv_id || '|' || claim as donor, row_number() over (order by sha256('1' || chr(31) || 'control-claim' || chr(31) || conv_id || '|' || claim)) as rn from w),
 fits as (select rn, d.conv_id as q, s.conv_id as b, coalesce(len(list_intersect(d.x, s.y)) / nullif(len(d.x), 0)::double, 0) as overlap, sha256('1' || chr(31) || 'control-sources:' || donor || chr(31) || s.conv_id || '|' || s.source) as h
   from donors d join w s on s.conv_id <> d.conv_id and s.conv_id % 7 <> d.conv_id % 7),
 lists as (select rn, list({{'b': b, 'overlap': overlap}} order by h) as ps from fits where overlap <= 0.3 group by rn)"""


@query("D14_control_pairs", f"""with {CONTROLS}, x as (select rn, q, b, overlap, row_number() over (partition by rn order by h) as place from fits where overlap <= 0.3)
 select q as question_id, place, b as source_question, round(overlap, 6) as overlap from x where rn <= 30 and place <= 5""")  # fmt: skip
def control_pairs(t: Tables) -> DataFrame:
    claims, sources = control_tables(t)
    queue = agreement.control_donors(claims, 1)
    donors = queue.orderBy("_k", "donor").limit(30).collect()
    pairs = agreement.fitting_sources(donors, queue, sources, 1, 0.3, 5)
    return pairs.select(F.split_part("donor", F.lit("|"), F.lit(1)).cast("long").alias("question_id"), F.col("place").cast("long").alias("place"), "source_question", r6("overlap"))


@query("L17_negative_controls", f"""with recursive {CONTROLS}, steps as (select 0::bigint as rn, []::bigint[] as used, null::bigint as question_id, null::bigint as source_question, null::double as overlap union all
   select rn, case when made then list_concat(used, [q, pick.b]) else used end, case when made then q end, case when made then pick.b end, case when made then pick.overlap end
   from (select d.rn, s.used, d.conv_id as q, list_filter(l.ps, lambda p: not list_contains(s.used, p.b))[1] as pick, pick is not null and not list_contains(s.used, d.conv_id) and len(s.used) < 40 as made
     from steps s join donors d on d.rn = s.rn + 1 left join lists l on l.rn = d.rn))
 select source_question, question_id, round(overlap, 6) as overlap from steps where question_id is not null""")  # fmt: skip
def negative_controls(t: Tables) -> DataFrame:
    return agreement.negative_controls(*control_tables(t), 20, 1, 0.3).select("source_question", "question_id", r6("overlap"))


@query("I14_content_overlap", f"""with q as (select conv_id, arg_min(text, turn) as a, arg_max(text, turn) as b from conversations group by conv_id),
 w as (select conv_id, {WORDS.format('a', rq.STOPS)} as x, {WORDS.format('b', rq.STOPS)} as y from q)
 select conv_id, len(x) as n_words, round(len(list_intersect(x, y)) / nullif(len(x), 0)::double, 6) as overlap from w""")  # fmt: skip
def content_overlap(t: Tables) -> DataFrame:
    q = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    x, y = content_words(F.col("a")), content_words(F.col("b"))
    return q.select("conv_id", F.size(x).cast("long").alias("n_words"), F.round(overlap(x, y), 6).alias("overlap"))


@query("E25_type_counts", "select role as type, count(*) as n, count(distinct conv_id) as n_conversations from conversations group by role")
def type_counts(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("role").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"))


@query("D12_unpaired_questions", "select distinct conv_id as question_id, 'user' as only_in from conversations where conv_id not in (select conv_id from conversations where role = 'assistant')")
def unpaired(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("config"), F.col("conv_id").alias("question_id")).distinct()
    return mt.unpaired_questions(rows, "user", "assistant")


# --- index versions from nations ---


def versions(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("index_version_id"), (n == 7).alias("is_active"), F.when(n % 4 == 0, "failed").otherwise("ready").alias("status"), F.concat(F.lit("h"), F.col("n_regionkey")).alias("config_hash"))


@query("A11_list_versions", "select n_nationkey as index_version_id, row_number() over (order by n_nationkey desc) as place from nation")
def list_versions(t: Tables) -> DataFrame:
    return indexing.list_versions(versions(t)).select("index_version_id", F.row_number().over(Window.orderBy(F.desc("index_version_id"))).cast("long").alias("place"))


@query("F16_prunable_versions", "select n_nationkey as index_version_id from (select n_nationkey, row_number() over (order by n_nationkey desc) as rn from nation where n_nationkey <> 7) where rn > 5")
def prunable(t: Tables) -> DataFrame:
    return indexing.prunable(versions(t), 5).select("index_version_id")


@query("L20_activate", "select n_nationkey as index_version_id, n_nationkey = 9 as is_active from nation")
def activate(t: Tables) -> DataFrame:
    return indexing.activate(versions(t), 9).select("index_version_id", "is_active")


@query("A9_version_problems", "select 'ready_twice' as rule, count(*) as n from (select n_regionkey from nation where n_nationkey % 4 <> 0 group by 1 having count(*) > 1) having count(*) > 0")
def version_problems(t: Tables) -> DataFrame:
    return indexing.version_problems(versions(t))
