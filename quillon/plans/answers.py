"""Answer queries: assistant turns are answers with markers and links, three labelled sources each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import answers as a
from quillon.plans.registry import Tables, query, r6


def given(t: Tables) -> DataFrame:
    turn = F.col("turn").cast("int")
    text = F.concat("text", F.lit(" [c"), turn % 4 + 1, F.lit("] and [c1, c9]. See [link](https://a.example/x) or www.b.example/y, `https://code` [c3](https://c.example/z) ``a ` https://in.code``\n> [c2]: https://d.example/c2 'two'\n[c3]: the third"))
    claims = F.array(
        F.struct(F.lit("one").alias("text"), F.array(F.lit("c1"), F.concat(F.lit("c"), turn % 3 + 1)).alias("citation_ids"), F.lit(0.9).alias("self_confidence")),
        F.struct(F.lit("two").alias("text"), F.array(F.lit("c8")).alias("citation_ids"), F.lit(0.5).alias("self_confidence")),
    )
    status = F.when(F.col("conv_id") % 7 == 0, "insufficient_context").otherwise("answered")
    rows = t.conversations.where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), "turn", status.alias("status"), text.alias("answer_markdown"), claims.alias("claims"))


def sources(t: Tables) -> DataFrame:
    rows = given(t).select("request_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    n = F.col("n")
    return rows.select(
        "request_id", F.concat(F.lit("c"), n).alias("label"), n.cast("long").alias("chunk_id"), F.concat(F.lit("https://docs.example/"), n).alias("url"), F.concat(F.lit("T"), n).alias("title"),
        F.lit("a > b").alias("breadcrumb_text"), F.repeat(F.lit("word "), n * 40).alias("content"), n.alias("dense_rank"), (n * 0.1).alias("dense_distance"), F.when(n != 2, n).alias("fts_rank"),
        F.when(n != 2, 5.0 - n).alias("fts_score"), (1.0 / (60 + n)).alias("rrf_score"), F.lit(None).cast("double").alias("rerank_score"),
    )


def lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = sources(t)
    return rows.select("request_id", "label", "chunk_id", "url", "title", "breadcrumb_text", "content"), rows.select("request_id", "chunk_id", "dense_rank", "dense_distance", "fts_rank", "fts_score", "rrf_score", "rerank_score")


GIVEN = """given as (select conv_id * 100 + turn as request_id, turn, conv_id % 7 = 0 as refusal, text from conversations where role = 'assistant'),
 uses as (select request_id, 'c' || (turn % 4 + 1) as label, 1 as place, false as in_claim, refusal from given union all select request_id, null, 2, false, refusal from given
  union all select request_id, 'c3', 2, false, refusal from given
  union all select request_id, 'c1', 3, true, refusal from given union all select request_id, 'c' || (turn % 3 + 1), 4, true, refusal from given union all select request_id, 'c8', 5, true, refusal from given),
 valid as (select *, label in ('c1', 'c2', 'c3') as ok from uses)"""


@query("L8_citations", f"""with {GIVEN}, f as (select request_id, label, min(place) as place from valid where ok and not refusal group by all)
 select request_id, row_number() over (partition by request_id order by place) as n, label, rtrim(substr(repeat('word ', 40 * substr(label, 2)::int), 1, 300)) as snippet from f""")  # fmt: skip
def citations(t: Tables) -> DataFrame:
    return a.citations(given(t), lists(t)[0]).select("request_id", F.col("n").cast("long").alias("n"), "label", "snippet")


@query("L8_citation_summary", f"""with {GIVEN} select request_id, count(distinct case when ok and not refusal then label end) as n_citations, count_if(ok is not true and not (refusal and in_claim)) as invalid_citations,
 case when bool_or(refusal) then 2 else 0 end as dropped_claims, count_if(ok and not refusal) = 0 and not bool_or(refusal) as bad_output from valid group by request_id""")  # fmt: skip
def citation_summary(t: Tables) -> DataFrame:
    rows = a.citation_summary(given(t), lists(t)[0])
    return rows.withColumn("dropped_claims", F.col("dropped_claims").cast("long"))


@query("I10_strip_urls", """select conv_id * 100 + turn as request_id, text || ' [c' || (turn % 4 + 1) || '] and [c1, c9]. See link or, `https://code` [c3] ``a ` https://in.code``' || chr(10) || '>' || chr(10) || '[c3]: the third' as answer_markdown, 4 as removed from conversations where role = 'assistant'""")
def strip_urls(t: Tables) -> DataFrame:
    return a.strip_urls(given(t))


SUPPORT = """support as (select n, 'c' || n as label, ((4 - n) / 3.0::double + 1 - n * 0.05::double) / 2 as d, case when n = 2 then 0 else ((4 - n) / 3.0::double + (5 - n) / 4.0::double) / 2 end as l, 61.0::double / (60 + n) as f from (select unnest([1, 2, 3]) as n)),
 claims as (select request_id, turn, 0 as claim_no, 0.9::double as self from given union all select request_id, turn, 1, 0.5 from given),
 cited as (select distinct c.request_id, c.claim_no, s.* from claims c join support s on c.claim_no = 0 and (s.label = 'c1' or s.label = 'c' || (turn % 3 + 1))),
 best as (select c.request_id, c.claim_no, any_value(self) as self, count(x.n) as n, coalesce(max((d + l + f) / 3), 0) as r, coalesce(max(least(d, l)), 0) as a from claims c left join cited x using (request_id, claim_no) group by all),
 scored as (select *, 0.4 * r + 0.25 * a + 0.2 * (n / (n + 1.0::double)) + 0.15 * self as c from best)"""


@query("L9_claim_confidence", f"with {GIVEN}, {SUPPORT} select request_id, claim_no, n as n_citations, round(r, 6) as retrieval, round(a, 6) as agreement, round(case when n = 0 then least(c, 0.2) else c end, 6) as confidence from scored")
def claim_confidence(t: Tables) -> DataFrame:
    labels, retrieved = lists(t)
    return a.score_claims(given(t), labels, retrieved).select("request_id", "claim_no", "n_citations", *map(r6, ("retrieval", "agreement", "confidence")))


@query("E29_answer_confidence", f"with {GIVEN}, {SUPPORT} select request_id, round(min(case when n = 0 then least(c, 0.2) else c end), 6) as confidence, count(*) as n_claims from scored group by request_id")
def answer_confidence(t: Tables) -> DataFrame:
    labels, retrieved = lists(t)
    return a.answer_confidence(a.score_claims(given(t), labels, retrieved)).select("request_id", r6("confidence"), "n_claims")


@query("D21_usable_sources", f"with {GIVEN} select distinct request_id, 0 as claim_no, label from valid where ok and in_claim")
def usable_sources(t: Tables) -> DataFrame:
    claims = given(t).select("request_id", F.posexplode("claims").alias("claim_no", "c")).select("request_id", "claim_no", "c.citation_ids")
    return a.usable_sources(claims, lists(t)[0]).select("request_id", "claim_no", "label")
