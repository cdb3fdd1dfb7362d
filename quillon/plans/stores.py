"""Queries of readers, writers, version filters, search modes and section shapes over the given tables.

Tables are written in the readers' formats to the shared folder and read back, so a row shows the whole way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import pseudo_score
from quillon.operators import corpus as c
from quillon.operators import retrieval as r
from quillon.plans import retrieval as rq
from quillon.plans.registry import Tables, query, r6
from quillon.sources import readers
from quillon.sources.store import shared_folder, stored
from quillon.streaming import jobs


def new_path(t: Tables, tag: str) -> str:
    return f"{shared_folder(t.spark)}/{tag}-{uuid.uuid4().hex}"


@query("A4_generation_results", """select 'c' || (o_orderkey % 3) as config, o_orderkey::varchar as id, case o_orderkey % 4 when 0 then 'errored' when 1 then 'na' else 'scored' end as state,
 case when o_orderkey % 4 > 1 then round(o_totalprice / 500000, 6) end as value from orders""")  # fmt: skip
def generation_results(t: Tables) -> DataFrame:
    """One JSON file per part of the orders, each with a nested list of results."""
    kind = F.col("o_orderkey") % 4
    part = F.struct(F.lit("correctness").alias("metric"), (F.col("o_totalprice") / 500000).alias("value"), (kind == 0).alias("errored"), (kind == 1).alias("not_applicable"))
    one = F.struct(F.concat(F.lit("c"), F.col("o_orderkey") % 3).alias("config"), F.col("o_orderkey").cast("string").alias("id"), F.array(part).alias("components"))
    files = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("value"))
    path = new_path(t, "results")
    files.repartition("file").write.partitionBy("file").text(path)
    return readers.read_generation_results(t.spark, path).select("config", "id", "state", r6("value"))


@query("A5_retrieval_run", "select 'c' || (l_linenumber % 2) as config, l_orderkey as question_id, count(*) as n, sum(l_partkey)::bigint as chunks from lineitem group by all")
def retrieval_run(t: Tables) -> DataFrame:
    path = new_path(t, "run")
    readers.write_run(t.lineitem.select(F.concat(F.lit("c"), F.col("l_linenumber") % 2).alias("config"), F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("chunk_id")), path)
    return readers.read_run(t.spark, path).groupBy("config", "question_id").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("chunks"))


@query("A7_label_sheet", """select c_custkey::varchar as item_id, c_name || ', "known" as' || chr(10) || c_mktsegment as claim, case when c_custkey % 3 > 0 then c_mktsegment end as human from customer""")
def label_sheet(t: Tables) -> DataFrame:
    """A sheet with separators, quotes and line ends inside its cells, and one in its header."""
    claim = F.concat("c_name", F.lit(', "known" as\n'), "c_mktsegment")
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("item_id"), claim.alias("claim;,text"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("human"))
    path = new_path(t, "sheet")
    readers.write_sheet(rows, path)
    return readers.read_sheet(t.spark, path).withColumnRenamed("claim;,text", "claim")


@query("J7_idempotent_append", "select cast(ts as date)::varchar as day, count(distinct event_id) as requests, count(distinct user_id) as users from events group by 1")
def idempotent_append(t: Tables) -> DataFrame:
    """Every event arrives twice on a stream; the log has it once, by day."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = stream.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    path = new_path(t, "log")
    jobs.log_sink(rows, path, new_path(t, "log-progress")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"))


@query("B5_version_filter", "select lang, count(*) as n from documents where doc_id % 3 = 1 group by lang")
def version_filter(t: Tables) -> DataFrame:
    chunks = t.documents.withColumn("index_version_id", F.col("doc_id") % 3)
    return r.of_version(chunks, 1).groupBy("lang").agg(F.count("*").alias("n"))


@query("K5_search_modes", f"""with {rq.HYBRID}, {rq.RERANKED.split('as fused_rank from merged) where fused_rank <= 40)')[1].lstrip(',')}
 select 'dense' as mode, question_id, count(*) as n, sum(chunk_id * dense_rank)::bigint as ordered from bd_top group by all
 union all select 'fts', question_id, count(*), sum(chunk_id * fts_rank)::bigint from ft group by all
 union all select 'hybrid', question_id, count(*), sum(chunk_id * fused_rank)::bigint from fused group by all
 union all select 'hybrid_rerank', question_id, count(*), sum(chunk_id * final_rank)::bigint from final where final_rank <= 10 group by all""")  # fmt: skip
def search_modes(t: Tables) -> DataFrame:
    asked, index = rq.asked_both(t), rq.index_of(t)
    found = None
    for mode, rank in r.RANKS.items():
        rows = r.search(mode, asked, rq.vectors(t), index, rq.K, 40, rq.scores, 10)
        rows = rows.groupBy(F.lit(mode).alias("mode"), "question_id").agg(F.count("*").alias("n"), F.sum(F.col("chunk_id") * F.col(rank)).alias("ordered"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("F11_section_groups", f"""with {rq.DENSE}, x as (select d.*, 's' || e.label as section_id from dense_top d join embeddings e on d.chunk_id = e.vec_id where dense_rank <= 5),
 y as (select *, min(dense_rank) over (partition by question_id, section_id) as best from x), z as (select *, row_number() over (partition by question_id order by best, chunk_id) as no from y)
 select question_id, section_id, min(no) as first, max(no) - min(no) + 1 = count(*) as together, count(*) as n from z group by all""")  # fmt: skip
def section_groups(t: Tables) -> DataFrame:
    found = r.dense_search(rq.asked_vectors(t), rq.vectors(t), rq.K).where("dense_rank <= 5")
    named = found.join(rq.vectors(t).select("chunk_id", F.concat(F.lit("s"), "label").alias("section_id")), "chunk_id")
    rows = r.context_labels(named, 5, "dense_rank").groupBy("question_id", "section_id")
    rows = rows.agg(F.min("label_no").alias("first"), F.max("label_no").alias("last"), F.count("*").alias("n"))
    return rows.select("question_id", "section_id", F.col("first").cast("long").alias("first"), (F.col("last") - F.col("first") + 1 == F.col("n")).alias("together"), "n")


def shaped(t: Tables, head: str, limit: int) -> DataFrame:
    """The first chunk of a page that begins with ``head`` and goes on with a document's words of small letters."""
    words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0)), " ")
    pages = t.documents.select(F.concat(F.lit("p"), "doc_id", F.lit(".md")).alias("source_path"), F.concat(F.lit(head + "Words: "), words).alias("text"))
    first = stored(c.pack_sections(c.sections(c.blocks(c.page_lines(pages))), limit), "shaped").where("ordinal = 0")
    return first.select("source_path", F.sha2("content", 256).alias("first_chunk"))


THIN, SMALL = "# T\n\n## A\n\n### B\n\n", "# T\n\n## A\n\none small\n\n## B\n\ntwo small"
WORDS = "w as (select doc_id, chr(10) || chr(10) as l, regexp_extract_all(coalesce(text, ''), '[a-z]+') as ws from documents)"


@query("C11_thin_parents", f"""with {WORDS} select 'p' || doc_id || '.md' as source_path, sha256(rtrim('# T' || l || '## A' || l || '### B' || l || 'Words: ' || coalesce(array_to_string(ws, ' '), ''))) as first_chunk from w""")
def thin_parents(t: Tables) -> DataFrame:
    """Empty parent sections open their child's chunk; no page reaches the limit."""
    return shaped(t, THIN, 10**9)


@query("C12_small_siblings", f"""with {WORDS}, s as (select *, '# T' || l || '## A' || l || 'one small' || l || '## B' || l || 'two small' as small from w)
 select 'p' || doc_id || '.md' as source_path, sha256(case when len(ws) + 13 <= 60 then rtrim(small || l || '## C' || l || 'Words: ' || coalesce(array_to_string(ws, ' '), '')) else small end) as first_chunk from s""")  # fmt: skip
def small_siblings(t: Tables) -> DataFrame:
    """Small sections of one parent are one chunk, and the next one joins them if all fit the limit of 60 words."""
    return shaped(t, SMALL + "\n\n## C\n\n", 60)
