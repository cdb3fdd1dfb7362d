"""Retrieval queries: embeddings stand for chunk vectors, documents for chunk texts, benchmark passages for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import l2_normalize, norm, row_places
from quillon.functions.text import STOP_WORDS, analyze, pseudo_score
from quillon.operators import indexing, metrics
from quillon.operators import retrieval as r
from quillon.plans.registry import Tables, query, r6
from quillon.sources.store import built_once, stored

K = 20
#: Spark's own limit.
MAX_BUCKETS = 100_000
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked_vectors(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 20 is a question."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def text_chunks(t: Tables) -> DataFrame:
    head = F.substring_index("text", "\n", 1)
    return t.documents.select(F.col("doc_id").alias("chunk_id"), head.alias("heading"), F.expr("substr(text, length(substring_index(text, '\n', 1)) + 1)").alias("body"))


def asked_texts(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def asked_both(t: Tables) -> DataFrame:
    return asked_texts(t).join(t.embeddings.select(F.col("vec_id").alias("question_id"), "embedding"), "question_id")


def terms_sql(source: str, key: str, text: str, more: str = "") -> str:
    """Rows (key, term) of a text column, as the analyzer makes them."""
    return f"""select {key}{more}, regexp_replace(regexp_replace(regexp_replace(w, '([a-z]{{2}})ies$', '\\1y'), '([a-z]{{3}})(?:ing|ed|es|s)$', '\\1'),
      '(b)b$|(d)d$|(g)g$|(m)m$|(n)n$|(p)p$|(r)r$|(t)t$', '\\1\\2\\3\\4\\5\\6\\7\\8') as term
      from (select {key}{more}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) as w from {source}) where w not in ({STOPS})"""


DENSE = f"""dense as (select q.vec_id as question_id, c.vec_id as chunk_id,
    1 - list_inner_product(c.embedding::double[], q.embedding::double[]) as distance
  from embeddings q, embeddings c where q.vec_id % 20 = 0),
 dense_top as (select * from (select *, row_number() over (partition by question_id order by distance, chunk_id) as dense_rank from dense) where dense_rank <= {K})"""
FIELDS = """fields as (select doc_id as chunk_id, 1 as a, split_part(text, chr(10), 1) as text from documents
  union all select doc_id, 0, substr(text, length(split_part(text, chr(10), 1)) + 1) from documents)"""
POSTINGS = f"""{FIELDS}, terms as ({terms_sql('fields', 'chunk_id', 'text', ', a')}),
 postings as (select term, chunk_id, sum(a)::bigint as hits_a, sum(1 - a)::bigint as hits_b from terms group by term, chunk_id)"""
LEXICAL = f"""{POSTINGS}, asked as (select distinct item_id as question_id, term from ({terms_sql('benchmark', 'item_id', 'text')})),
 scored as (select question_id, chunk_id, round(sum(hits_a * 1.0::double + hits_b * 0.4::double), 9) as fts_score from asked join postings using (term) group by all),
 fts_top as (select * from (select *, row_number() over (partition by question_id order by fts_score desc, chunk_id) as fts_rank from scored) where fts_rank <= {K})"""
HYBRID = f"""{LEXICAL}, bd as (select b.item_id as question_id, c.vec_id as chunk_id, 1 - list_inner_product(c.embedding::double[], q.embedding::double[]) as distance
   from benchmark b join embeddings q on b.item_id = q.vec_id, embeddings c),
 bd_top as (select * from (select *, row_number() over (partition by question_id order by distance, chunk_id) as dense_rank from bd) where dense_rank <= {K}),
 ft as (select * from fts_top where question_id in (select vec_id from embeddings)),
 merged as (select coalesce(d.question_id, f.question_id) as question_id, coalesce(d.chunk_id, f.chunk_id) as chunk_id, dense_rank, fts_rank,
   coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + fts_rank), 0) as rrf_score
   from bd_top d full join ft f on d.question_id = f.question_id and d.chunk_id = f.chunk_id),
 fused as (select * from (select *, row_number() over (partition by question_id order by rrf_score desc, chunk_id) as fused_rank from merged) where fused_rank <= 40)"""


@query("L1_dense_search", f"with {DENSE} select question_id, chunk_id, round(greatest(distance, 0), 6) as distance, dense_rank from dense_top")
def dense_search(t: Tables) -> DataFrame:
    rows = r.dense_search(asked_vectors(t), vectors(t), K)
    return rows.select("question_id", "chunk_id", F.round(F.greatest("distance", F.lit(0.0)), 6).alias("distance"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query("C23_postings", f"with {POSTINGS} select * from postings")
def postings(t: Tables) -> DataFrame:
    return r.postings(text_chunks(t))


def index_of(t: Tables) -> r.LexicalIndex:
    """The postings and their levels as tables that all lexical queries of a session read. A chunk's rows stand in one bucket of a bounded number of
    chunks, where its hits are summed and cut to the best of each question."""
    buckets = min(r.counting_tasks(t.documents), MAX_BUCKETS)
    rows = built_once(lambda: r.weighted(postings(t)), "postings", t.documents, "chunk_id", buckets=buckets)
    levels = built_once(lambda: r.levels_of(rows), "posting-levels", t.documents)
    return r.LexicalIndex(rows, levels)


@query("C24_analyzer", f"with x as ({terms_sql('benchmark', 'item_id', 'text')}) select term, count(*) as n, count(distinct item_id) as n_items from x group by term")
def analyzer(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.explode(analyze(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


@query("B6_any_term_match", f"with {LEXICAL} select question_id, count(distinct chunk_id) as n_candidates from asked join postings using (term) group by question_id")
def any_term(t: Tables) -> DataFrame:
    terms = asked_texts(t).select("question_id", F.explode(F.array_distinct(analyze(F.col("question")))).alias("term"))
    return terms.join(index_of(t).rows, "term").groupBy("question_id").agg(F.count_distinct("chunk_id").alias("n_candidates"))


@query("L2_lexical_search", f"with {LEXICAL} select question_id, chunk_id, round(fts_score, 6) as fts_score, fts_rank from fts_top")
def lexical_search(t: Tables) -> DataFrame:
    rows = r.lexical_search(asked_texts(t), index_of(t), K)
    return rows.select("question_id", "chunk_id", r6("fts_score"), F.col("fts_rank").cast("long").alias("fts_rank"))


@query("L3_hybrid_search", f"with {HYBRID} select question_id, chunk_id, dense_rank, fts_rank, round(rrf_score, 9) as rrf_score, fused_rank from fused")
def hybrid_search(t: Tables) -> DataFrame:
    rows = r.hybrid_search(asked_both(t), vectors(t), index_of(t), K, K, 40)
    ranks = [F.col(c).cast("long").alias(c) for c in ("dense_rank", "fts_rank", "fused_rank")]
    return rows.select("question_id", "chunk_id", *ranks, F.round("rrf_score", 9).alias("rrf_score"))



def scores(candidates: DataFrame) -> DataFrame:
    text = F.concat_ws(":", "question_id", "chunk_id")
    return candidates.where("question_id % 3 <> 1 or chunk_id % 2 = 0").select("question_id", "chunk_id", pseudo_score(text).alias("rerank_score"))


SCORE_SQL = "('0x' || substr(sha256(question_id || ':' || chunk_id), 1, 13))::bigint / 4503599627370496.0::double"
RERANKED = f"""{HYBRID}, s as (select *, case when question_id % 3 <> 1 or chunk_id % 2 = 0 then {SCORE_SQL} end as s from fused),
 d as (select *, count(s) over (partition by question_id) < count(*) over (partition by question_id) as degraded from s),
 e as (select *, case when not degraded then s end as rerank_score from d),
 final as (select *, row_number() over (partition by question_id order by rerank_score desc nulls last, fused_rank) as final_rank from e)"""


@query("L4_rerank", f"with {RERANKED} select question_id, chunk_id, fused_rank, round(rerank_score, 6) as rerank_score, case when degraded then 'missing_scores' end as rerank_error, final_rank from final where final_rank <= 10")
def rerank(t: Tables) -> DataFrame:
    found = stored(r.hybrid_search(asked_both(t), vectors(t), index_of(t), K, K, 40), "fused")
    rows = r.rerank(found, scores(found), 10)
    ranks = [F.col(c).cast("long").alias(c) for c in ("fused_rank", "final_rank")]
    return rows.select("question_id", "chunk_id", *ranks, r6("rerank_score"), "rerank_error")


@query("L5_rerank_problems", f"""with {HYBRID}, given as (select question_id, chunk_id, case when chunk_id % 5 = 0 then 1.5 else 0.5 end as s from fused where chunk_id % 7 <> 0
   union all select question_id, -1, 0.5 from (select distinct question_id from fused))
 select question_id, 'out_of_range' as rule, count(*) as n from given where s > 1 group by 1
 union all select question_id, 'missing', count(*) from fused where chunk_id % 7 = 0 group by 1
 union all select question_id, 'unknown', count(*) from given where chunk_id = -1 group by 1""")  # fmt: skip
def rerank_problems(t: Tables) -> DataFrame:
    found = stored(r.hybrid_search(asked_both(t), vectors(t), index_of(t), K, K, 40).select("question_id", "chunk_id"), "fused")
    given = found.where("chunk_id % 7 <> 0").select("question_id", "chunk_id", F.when(F.col("chunk_id") % 5 == 0, 1.5).otherwise(0.5).alias("rerank_score"))
    extra = found.select("question_id").distinct().select("question_id", F.lit(-1).cast("long").alias("chunk_id"), F.lit(0.5).alias("rerank_score"))
    return r.rerank_problems(found, given.unionByName(extra))


@query("L7_context_labels", f"""with {DENSE}, x as (select d.*, 's' || e.label as section_id from dense_top d join embeddings e on d.chunk_id = e.vec_id where dense_rank <= 5),
 y as (select *, min(dense_rank) over (partition by question_id, section_id) as best from x)
 select question_id, chunk_id, section_id, 'c' || row_number() over (partition by question_id order by best, chunk_id) as label from y""")  # fmt: skip
def context_labels(t: Tables) -> DataFrame:
    found = r.dense_search(asked_vectors(t), vectors(t), K).where("dense_rank <= 5")
    named = found.join(vectors(t).select("chunk_id", F.concat(F.lit("s"), "label").alias("section_id")), "chunk_id")
    return r.context_labels(named, 5, "dense_rank").select("question_id", "chunk_id", "section_id", "label")


@query("L7_build_context", f"""with {LEXICAL}, x as (select f.*, d.source as section_id, d.text from fts_top f join documents d on f.chunk_id = d.doc_id where fts_rank <= 5),
 y as (select *, min(fts_rank) over (partition by question_id, section_id) as best from x),
 z as (select *, row_number() over (partition by question_id order by best, chunk_id) as no from y)
 select question_id, count(*) as n_sources, sha256(string_agg('<source id="c' || no || '" section="' || section_id || '" url="https://docs.example/' || chunk_id || '">' || chr(10) ||
   regexp_replace(text, '^\\n+|\\n+$', '', 'g') || chr(10) || '</source>', chr(10) || chr(10) order by no)) as context_sha256 from z group by question_id""")  # fmt: skip
def build_context(t: Tables) -> DataFrame:
    # Written, so that its size is known before the join: few rows are broadcast, and no text is shuffled.
    found = stored(r.lexical_search(asked_texts(t), index_of(t), K).where("fts_rank <= 5"), "context-ranks")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section_id"), F.col("source").alias("breadcrumb_text"), F.concat(F.lit("https://docs.example/"), "doc_id").alias("url"), F.col("text").alias("content"))
    rows = r.build_context(found.join(docs, "chunk_id"), 5, "fts_rank")
    return rows.select("question_id", "n_sources", F.sha2("context", 256).alias("context_sha256"))


@query("C19_l2_normalize", "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, 1.0::double as unit_norm from embeddings")
def l2(t: Tables) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * 3)
    return t.embeddings.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"), F.round(norm(l2_normalize(scaled)), 5).alias("unit_norm"))


@query("A10_active_chunks", "select vec_id as chunk_id, label as index_version_id from embeddings where label = (select max(label) from embeddings where label < 7)")
def active_chunks(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("index_version_id"))
    newest = chunks.where("index_version_id < 7").agg(F.max("index_version_id").alias("v"))
    versions = chunks.select("index_version_id").distinct().join(F.broadcast(newest), F.lit(True))
    return r.active_chunks(versions.withColumn("is_active", F.col("index_version_id") == F.col("v")), chunks).select("chunk_id", "index_version_id")


@query("E10_verify_index", "select count(*) as chunks, count_if(embedding is null) as null_vectors, count_if(len(embedding) <> 64) as wrong_dim, (select count(*) from documents) as documents, true as ok from embeddings")
def verify_index(t: Tables) -> DataFrame:
    return indexing.verify_index(t.documents, t.embeddings, 64)


# --- graded evaluation over two configurations: all dimensions, and the first eight only ---


def retrieved(t: Tables) -> DataFrame:
    """Both configurations' results, searched once per session and content of the vectors: every evaluation reads them several times."""
    return built_once(lambda: searched(t), "retrieved", t.embeddings)


def searched(t: Tables) -> DataFrame:
    chunks = vectors(t)
    coarse = [df.withColumn("embedding", F.slice("embedding", 1, 8)) for df in (asked_vectors(t), chunks)]
    found = r.dense_search(asked_vectors(t), chunks, K).withColumn("config", F.lit("dense"))
    found = found.unionByName(r.dense_search(*coarse, K).withColumn("config", F.lit("coarse")))
    named = chunks.select("chunk_id", F.concat(F.lit("p"), "label", F.lit("#a"), F.col("chunk_id") % 4).alias("section_id"), F.array(F.concat(F.lit("a"), F.col("chunk_id") % 4)).alias("anchor_path"))
    return found.withColumnRenamed("dense_rank", "rank").join(named, "chunk_id").select("config", "question_id", "rank", "section_id", "anchor_path", "chunk_id")


def qrels(t: Tables) -> DataFrame:
    q, page = F.col("vec_id"), lambda k: F.concat(F.lit("p"), (F.col("label") + k) % 10)
    labels = F.array(
        F.struct(F.concat(page(0), F.lit("#a"), q % 4).alias("section"), F.lit(2).alias("grade")), F.struct(page(1).alias("section"), F.lit(1).alias("grade")),
        F.struct(F.concat(page(2), F.lit("#a"), (q + 1) % 4).alias("section"), F.lit(2).alias("grade")),
    )
    return t.embeddings.where("vec_id % 20 = 0").select(q.alias("question_id"), F.explode(labels).alias("l")).select("question_id", "l.*")


EVAL = f"""{DENSE}, coarse as (select q.vec_id as question_id, c.vec_id as chunk_id, 1 - list_inner_product(c.embedding[1:8]::double[], q.embedding[1:8]::double[]) as distance
   from embeddings q, embeddings c where q.vec_id % 20 = 0),
 found as (select 'dense' as config, question_id, chunk_id, dense_rank as rank from dense_top union all
   select 'coarse', question_id, chunk_id, rank from (select *, row_number() over (partition by question_id order by distance, chunk_id) as rank from coarse) where rank <= {K}),
 retrieved as (select f.*, 'p' || e.label as page, 'a' || (f.chunk_id % 4) as anchor from found f join embeddings e on f.chunk_id = e.vec_id),
 qrels as (select vec_id as question_id, 'p' || label || '#a' || (vec_id % 4) as section, 2 as grade from embeddings where vec_id % 20 = 0
   union all select vec_id, 'p' || ((label + 1) % 10), 1 from embeddings where vec_id % 20 = 0
   union all select vec_id, 'p' || ((label + 2) % 10) || '#a' || ((vec_id + 1) % 4), 2 from embeddings where vec_id % 20 = 0),
 ranks as (select c.config, q.question_id, q.section, q.grade, min(r.rank) as rank from qrels q cross join (select distinct config from found) c
   left join retrieved r on r.config = c.config and r.question_id = q.question_id and r.page = split_part(q.section, '#', 1)
     and (not contains(q.section, '#') or r.anchor = split_part(q.section, '#', 2)) group by all),
 placed as (select *, row_number() over (partition by config, question_id order by grade desc, section) as ideal, pow(2, grade) - 1 as gain from ranks),
 per_question as (select config, question_id,
   count_if(grade = 2 and rank <= 5) / count_if(grade = 2)::double as recall_at_5, count_if(grade = 2 and rank <= 10) / count_if(grade = 2)::double as recall_at_10,
   coalesce(1.0::double / min(case when grade = 2 then rank end), 0) as mrr,
   sum(case when rank <= 5 then gain / log2(rank + 1) else 0 end) / sum(case when ideal <= 5 then gain / log2(ideal + 1) else 0 end) as ndcg_at_5,
   sum(case when rank <= 10 then gain / log2(rank + 1) else 0 end) / sum(case when ideal <= 10 then gain / log2(ideal + 1) else 0 end) as ndcg_at_10
   from placed group by config, question_id),
 long as (unpivot per_question on recall_at_5, recall_at_10, mrr, ndcg_at_5, ndcg_at_10 into name metric value value),
 means as (select config, metric, avg(value) as value, count(*) as n from long group by all)"""


@query("E1_label_ranks", f"with {EVAL} select * from ranks")
def label_ranks(t: Tables) -> DataFrame:
    return metrics.label_ranks(retrieved(t), qrels(t)).withColumn("rank", F.col("rank").cast("long"))


def per_question(t: Tables) -> DataFrame:
    return metrics.question_metrics(metrics.label_ranks(retrieved(t), qrels(t)))


ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in metrics.METRICS)


@query("L10_retrieval_eval", f"with {EVAL} select config, question_id, {ROUNDED} from per_question")
def retrieval_eval(t: Tables) -> DataFrame:
    return per_question(t).select("config", "question_id", *map(r6, metrics.METRICS))


@query("E6_config_means", f"with {EVAL} select config, metric, round(value, 6) as value, n from means")
def config_means(t: Tables) -> DataFrame:
    return metrics.config_means(per_question(t)).select("config", "metric", r6("value"), "n")


@query("E5_metric_problems", f"with {EVAL} select config, question_id, 'repeated_rank' as rule from ranks group by all having count(rank) > count(distinct rank)")
def metric_problems(t: Tables) -> DataFrame:
    return metrics.metric_problems(metrics.label_ranks(retrieved(t), qrels(t)))


@query("E26_paired_diff", f"""with {EVAL}, pairs as (select a.question_id, a.metric, a.value as before, b.value as after, b.value - a.value as delta
   from long a join long b using (question_id, metric) where a.config = 'coarse' and b.config = 'dense'),
 head as (select count_if(delta > 1e-9) as wins, count_if(delta < -1e-9) as losses, count_if(abs(delta) <= 1e-9) as ties from pairs where metric = 'ndcg_at_5')
 select metric, round(avg(before), 6) as base_mean, round(avg(after), 6) as other_mean, round(avg(delta), 6) as mean_delta, count(*) as n, any_value(wins) as wins, any_value(losses) as losses, any_value(ties) as ties
 from pairs, head group by metric""")  # fmt: skip
def paired_diff(t: Tables) -> DataFrame:
    rows = metrics.paired_diff(per_question(t), "coarse", "dense")
    return rows.select("metric", *map(r6, ("base_mean", "other_mean", "mean_delta")), "n", "wins", "losses", "ties")


@query("G3_report_order", f"""with {EVAL}, pairs as (select a.question_id, b.value - a.value as delta from long a join long b using (question_id, metric)
   where a.config = 'coarse' and b.config = 'dense' and metric = 'ndcg_at_5')
 select question_id, round(delta, 6) as delta, row_number() over (order by round(delta, 9), question_id) as place from pairs""")  # fmt: skip
def report_order(t: Tables) -> DataFrame:
    rows = metrics.question_deltas(per_question(t), "coarse", "dense").where("metric = 'ndcg_at_5'")
    rows = stored(rows.select("question_id", "metric", "delta", F.round("delta", 9).alias("by")), "report-order")
    return row_places(rows, ["metric"], "by", "question_id").select("question_id", r6("delta"), "place")


@query("H2_same_candidates", f"""with {EVAL}, a as (select question_id, page || '#' || anchor as section_id from retrieved where config = 'coarse'),
 b as (select question_id, page || '#' || anchor as section_id from retrieved where config = 'dense')
 select *, 'coarse' as side from (select * from a except all select * from b) union all select *, 'dense' from (select * from b except all select * from a)""")  # fmt: skip
def same_candidates(t: Tables) -> DataFrame:
    return metrics.same_candidates(retrieved(t), "coarse", "dense")


@query("E27_stored_means", f"with {EVAL} select config, metric, round(value + (case when metric = 'mrr' then 0.1 else 0 end), 6) as stored, round(value, 6) as fresh from means where metric = 'mrr'")
def stored_means(t: Tables) -> DataFrame:
    rows = per_question(t)
    stored = metrics.config_means(rows).select("config", "metric", (F.col("value") + F.when(F.col("metric") == "mrr", 0.1).otherwise(0.0)).alias("value"))
    return metrics.run_problems(rows, stored).select("config", "metric", r6("value", "stored"), r6("fresh"))


@query("L18_unresolved_labels", f"with {EVAL} select question_id, section from qrels q where contains(section, '#') and not exists (select 1 from embeddings e where 'p' || e.label || '#a' || (e.vec_id % 4) = q.section and e.vec_id % 3 = 0) or (not contains(section, '#') and not exists (select 1 from embeddings e where 'p' || e.label = q.section and e.vec_id % 3 = 0))")
def unresolved_labels(t: Tables) -> DataFrame:
    chunks = vectors(t).select(F.concat(F.lit("p"), "label", F.lit("#a"), F.col("chunk_id") % 4).alias("section_id"), F.array(F.concat(F.lit("a"), F.col("chunk_id") % 4)).alias("anchor_path"))
    return indexing.unresolved_labels(qrels(t), chunks).select("question_id", "section")
