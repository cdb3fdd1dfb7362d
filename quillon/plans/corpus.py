"""Corpus queries: every document becomes a documentation page with headings and, for some, a code block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import nearest_rank
from quillon.functions.text import escape_attribute, escape_content, normalize_label, sentences, slug, token_count
from quillon.operators import corpus as c
from quillon.operators import includes, indexing
from quillon.plans.registry import Tables, query, r6

BASE = "https://docs.example"
CODE = "```py\n# not a heading\n```\n\n"


def doc_pages(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), F.when(F.col("doc_id") % 3 == 0, F.lit(CODE)).otherwise(""), F.replace("text", F.lit(".\n"), F.lit(".\n\n## Part\n\n")))
    return t.documents.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"), text.alias("text"))


def all_pages(t: Tables) -> DataFrame:
    index = t.documents.select("source").distinct().select(F.concat("source", F.lit("/index.md")).alias("source_path"), F.concat(F.lit("---\nlang: en\n---\n# About "), "source", F.lit(" { #about }\n\nIndex.")).alias("text"))
    return doc_pages(t).unionByName(index)


PAGES = """docs as (select doc_id, source, source || '/' || doc_id || '.md' as source_path, text as raw,
  '# Doc ' || doc_id || chr(10) || chr(10) || case when doc_id % 3 = 0 then '```py' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || chr(10) else '' end
   || replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || '## Part' || chr(10) || chr(10)) as text,
  ((length(text) - length(replace(text, '.' || chr(10), ''))) // 2)::bigint as n_parts from documents)"""


@query("C1_page_lines", f"with {PAGES} select source_path, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines from docs union all select distinct source || '/index.md', 3 from documents")
def page_lines(t: Tables) -> DataFrame:
    return c.page_lines(all_pages(t)).groupBy("source_path").agg(F.count("*").alias("n_lines"))


@query("C3_page_hash", f"with {PAGES} select source_path, sha256(text) as content_hash from docs")
def page_hash(t: Tables) -> DataFrame:
    return c.page_hash(c.page_lines(doc_pages(t)))


@query("B1_page_exclusion", f"with {PAGES} select source_path from docs where source <> 'src3' and not regexp_matches(source_path, '^src1.*/[0-9]*7\\.md$')")
def exclusion(t: Tables) -> DataFrame:
    return c.exclude_pages(doc_pages(t), ["src3/*", "src1*/*7.md"]).select("source_path")


@query("B2_page_url", "select source || '/' || doc_id || '.md' as source_path, 'https://docs.example/' || source || '/' || doc_id || '/' as url from documents union all select distinct source || '/index.md', 'https://docs.example/' || source || '/' from documents")
def page_url(t: Tables) -> DataFrame:
    return all_pages(t).select("source_path", c.page_url(F.col("source_path"), BASE).alias("url"))


@query("B3_page_title", "select source || '/' || doc_id || '.md' as source_path, 'Doc ' || doc_id as title from documents union all select distinct source || '/index.md', 'About ' || source from documents")
def page_title(t: Tables) -> DataFrame:
    return c.page_title(c.page_lines(all_pages(t)))


@query("C9_nav_path", "select source || '/' || doc_id || '.md' as source_path, 'About ' || source as nav from documents union all select distinct source || '/index.md', '' from documents")
def nav_path(t: Tables) -> DataFrame:
    pages = all_pages(t)
    return c.nav_path(pages, c.page_title(c.page_lines(pages))).select("source_path", F.array_join("nav", " > ").alias("nav"))


@query("F6_fence_state", f"with {PAGES} select source_path, 3 as n_lines from docs where doc_id % 3 = 0")
def fence_state(t: Tables) -> DataFrame:
    return c.with_fence_state(c.page_lines(all_pages(t))).where("fence is not null").groupBy("source_path").agg(F.count("*").alias("n_lines"))


@query("C4_blocks", f"with {PAGES} select source_path, 'heading' as block_type, n_parts + 1 as n from docs union all select source_path, 'code', 1 from docs where doc_id % 3 = 0")
def blocks(t: Tables) -> DataFrame:
    return c.blocks(c.page_lines(doc_pages(t))).where("block_type <> 'text'").groupBy("source_path", "block_type").agg(F.count("*").alias("n"))


def marked_pages(t: Tables) -> DataFrame:
    """Pages of every kind of block: underlined headings, lists with nested items and fences, tables, quotes with lazy lines, indented code, comments, containers."""
    n = F.col("doc_id").cast("string")

    def many(what: Column, count: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.concat(what, i.cast("string"))), "\n")

    items = many(F.lit("- item\n  - nested\n\n  ```\n  # no\n\n  ```\n  item "), F.col("doc_id") % 4 + 1)
    table = F.concat(F.lit("| a | b |\n|---|:-:|\n"), many(F.lit("| x | "), F.col("doc_id") % 3 + 1))
    container = F.when(F.col("doc_id") % 2 == 0, F.lit("/// tip\n\n- x\n\ny\n\n///"))
    parts = [F.concat(F.lit("Doc "), n, F.lit("\n===")), items, table, F.concat(F.lit("> q "), n, F.lit("\nlazy")), F.concat(F.lit("    code "), n, F.lit("\n\n    more")), F.concat(F.lit("<!-- "), n, F.lit("\n\nend -->")), container, F.lit("~~~\n# no\n\n```\n~~~"), F.concat(F.lit("***\nlast "), n)]
    return t.documents.select(F.concat(F.lit("m/"), n, F.lit(".md")).alias("source_path"), F.concat_ws("\n\n", *parts).alias("text"))


@query("C4_block_kinds", """with d as (select doc_id, doc_id::varchar as n, chr(10) as l from documents), parts as (select doc_id, unnest([{'k': 'heading', 'm': 'Doc ' || n || l || '==='},
   {'k': 'list', 'm': replace(array_to_string(list_transform(range(1, doc_id % 4 + 2), lambda i: '- item' || l || '  - nested' || l || l || '  ```' || l || '  # no' || l || l || '  ```' || l || '  item ' || i), '~~'), '~~', l)},
   {'k': 'table', 'm': '| a | b |' || l || '|---|:-:|' || l || replace(array_to_string(list_transform(range(1, doc_id % 3 + 2), lambda i: '| x | ' || i), '~~'), '~~', l)}, {'k': 'quote', 'm': '> q ' || n || l || 'lazy'},
   {'k': 'indented', 'm': '    code ' || n || l || l || '    more'}, {'k': case when doc_id % 2 = 0 then 'container' end, 'm': '/// tip' || l || l || '- x' || l || l || 'y' || l || l || '///'}, {'k': 'fence', 'm': '~~~' || l || '# no' || l || l || '```' || l || '~~~'},
   {'k': 'paragraph', 'm': 'last ' || n}]) as p from d) select 'm/' || doc_id || '.md' as source_path, p.k as kind, sha256(p.m) as markdown from parts where p.k is not null""")  # fmt: skip
def block_kinds(t: Tables) -> DataFrame:
    return c.blocks(c.page_lines(marked_pages(t))).select("source_path", "kind", F.sha2("markdown", 256).alias("markdown"))


@query("C6_noise_code", f"with {PAGES} select source_path, 1 as n from docs where doc_id % 3 = 0")
def noise_code(t: Tables) -> DataFrame:
    twice = doc_pages(t).withColumn("text", F.concat("text", F.lit("\n\n" + CODE), F.lit("```\n" + "QUJD" * 120 + "\n```")))
    rows = c.drop_noise_code(c.blocks(c.page_lines(twice))).where("block_type = 'code'")
    return rows.join(doc_pages(t).where("contains(text, 'not a heading')").select("source_path"), "source_path", "left_semi").groupBy("source_path").agg(F.count("*").alias("n"))


@query("C8_anchors", f"with {PAGES}, p as (select source_path, unnest(range(n_parts)) as i from docs) select source_path, case when i = 0 then 'part' else 'part_' || i end as anchor from p union all select source_path, 'doc-' || doc_id from docs")
def anchors(t: Tables) -> DataFrame:
    return c.anchors(c.blocks(c.page_lines(doc_pages(t)))).select("source_path", "anchor")


@query("C10_sections", f"with {PAGES} select source_path, n_parts + 1 as n_sections from docs")
def sections(t: Tables) -> DataFrame:
    return c.sections(c.blocks(c.page_lines(doc_pages(t)))).groupBy("source_path").agg(F.count_distinct("section_no").alias("n_sections"))


@query("C15_chunks")
def chunks(t: Tables) -> DataFrame:
    rows = c.chunks(all_pages(t), BASE).drop("anchor_path", "content")
    return c.with_chunk_ids(rows).select("chunk_id", "source_path", "ordinal", "section_id", "breadcrumb_text", "url", "token_count", "content_hash")


@query("C14_sentences", "with x as (select doc_id, regexp_replace(text, '\\s+$', '') as t from documents) select doc_id, len(regexp_extract_all(t, '[.!?][\"'')\\]*_]{0,3}\\s+')) + 1 as n_sentences from x where t <> ''")
def sentence_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(sentences(F.regexp_replace("text", r"\s+$", ""))).cast("long").alias("n_sentences"))


@query("C16_token_count", "select doc_id, len(regexp_extract_all(text, '\\S+')) as tokens from documents")
def tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", token_count(F.col("text")).cast("long").alias("tokens"))


@query("E9_token_stats", """with x as (select len(regexp_extract_all(text, '\\S+')) as n from documents), y as (select n, row_number() over (order by n) as rn, count(*) over () as c from x)
 select min(n) as min_tokens, max(case when rn = (50 * c + 99) // 100 then n end) as p50, max(case when rn = (95 * c + 99) // 100 then n end) as p95, max(n) as max_tokens, sum(n)::bigint as total, count_if(n > 450) as over_max from y""")  # fmt: skip
def token_stats(t: Tables) -> DataFrame:
    rows = t.documents.select(token_count(F.col("text")).cast("long").alias("n"), F.lit(1).alias("all"))
    ranks = nearest_rank(rows, "n", {"p50": 50, "p95": 95}, ["all"]).select("p50", "p95")
    whole = rows.agg(F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.sum("n").alias("total"), F.count_if(F.col("n") > 450).alias("over_max"))
    return whole.join(F.broadcast(ranks), F.lit(True))


@query("B16_too_long", "with x as (select source || '@' || doc_id as s from documents where len(regexp_extract_all(text, '\\S+')) > 450) select (select count(*) from x) as n, (select string_agg(s, ',' order by s) from (select s from x order by s limit 10)) as first")
def too_long(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("section_id"), F.col("doc_id").alias("ordinal"), token_count(F.col("text")).alias("token_count"))
    return c.too_long(rows, 450).select("n", F.array_join("first", ",").alias("first"))


@query("C17_content_hash", "select doc_id, sha256(source || chr(10) || chr(10) || text) as content_hash from documents")
def content_hash(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("source").alias("breadcrumb_text"), F.col("text").alias("content"))
    return c.with_content_hash(rows).select("doc_id", "content_hash")


@query("C20_hash_embedding", """with h as (select item_id, k, sha256('query' || chr(31) || text || chr(31) || k) as h from benchmark, (select unnest(range(3)) as k)),
 x as (select item_id, k * 8 + i as place, ('0x' || substr(h, i * 8 + 1, 8))::bigint / 2147483648.0::double - 1 as v from h, (select unnest(range(8)) as i))
 select item_id, place, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as value from x""")  # fmt: skip
def hash_embedding(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.posexplode(indexing.hash_embedding(F.col("text"), "query", 24)).alias("place", "value"))
    return rows.select("item_id", F.col("place").cast("long").alias("place"), r6("value"))


def located(t: Tables) -> DataFrame:
    return t.documents.select("source", F.concat("source", F.lit("#"), "lang").alias("section_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("source_path"), F.col("n_chars").alias("token_count"))


@query("C25_sample_sections", "select section_id from (select distinct source || '#' || lang as section_id from documents) order by sha256('9' || chr(31) || 'section' || chr(31) || section_id) limit 15")
def sample_sections(t: Tables) -> DataFrame:
    return c.sample_sections(located(t), 15, 9)


@query("C26_page_sections", "select 'src1#' || lang as section_id, min(doc_id) as first, count(*) as n_chunks, sum(n_chars)::bigint as tokens from documents where source = 'src1' group by lang")
def page_sections(t: Tables) -> DataFrame:
    return c.page_sections(located(t), "src1")


@query("C21_embed_cached", "select conv_id, turn, conv_id % 3 = 0 or text in (select text from conversations where conv_id % 3 = 0) as hit, 8 as dim from conversations")
def embed_cached(t: Tables) -> DataFrame:
    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [[float(len(x) + k) for k in range(8)] for x in pdf["text"]]})

    texts = t.conversations.select("conv_id", "turn", "text", F.sha2("text", 256).alias("key"))
    cache = texts.where("conv_id % 3 = 0").select("key", F.array_repeat(F.lit(1.0).cast("float"), 8).alias("value")).dropDuplicates(["key"])
    vectors, _ = indexing.embed_cached(texts, cache, lengths)
    return vectors.select("conv_id", "turn", (F.get("value", F.lit(1)) == 1.0).alias("hit"), F.size("value").cast("long").alias("dim"))


@query("I13_slug", "select p_partkey, replace(p_name, ' ', '-') as slug from part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", slug(F.initcap("p_name")).alias("slug"))


@query("I11_escape", "select page_id, sha256(regexp_replace(html, '<(\\s*/?\\s*)(source)', '&lt;\\1\\2', 'gi')) as content, replace(replace(replace(url, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') as attribute from pages")
def escapes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(escape_content(F.col("html")), 256).alias("content"), escape_attribute(F.col("url")).alias("attribute"))


@query("B15_normalize_label", "select l_shipdate::date::varchar as day, replace(upper(trim(regexp_replace(replace(' ' || l_returnflag || '-' || l_linestatus || '  x', '-', ' '), '\\s+', ' ', 'g'))), ' ', '_') as label, count(*) as n from lineitem group by all")
def labels(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), "l_returnflag", F.lit("-"), "l_linestatus", F.lit("  x"))
    return t.lineitem.select(F.to_date("l_shipdate").cast("string").alias("day"), normalize_label(text).alias("label")).groupBy("day", "label").agg(F.count("*").alias("n"))


@query("I26_safe_link", "select page_id, regexp_matches(url, '^https?://') as safe from pages")
def safe_link(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")).isin("http", "https"), F.lit(False)).alias("safe"))


@query("H5_distinct_texts", "select text_hash, min(doc_id) as first_id, count(*) as n from (select doc_id, sha256(text) as text_hash from documents) group by text_hash")
def distinct_texts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("H6_one_setup", "select source, count(distinct lang) <= 1 as one_language, count(distinct lang) as n from documents group by source")
def one_setup(t: Tables) -> DataFrame:
    n = F.count_distinct("lang")
    return t.documents.groupBy("source").agg((n <= 1).alias("one_language"), n.alias("n"))


@query("B10_golden_problems", """with x as (select item_id, 'q' || case when item_id < 1000 then lpad(item_id::varchar, 3, '0') else item_id::varchar end as id, ['single_section', 'multi_section', 'unanswerable'][1 + item_id % 3] as type, item_id % 4 <> 0 as answerable, item_id % 5 as g from benchmark)
 select id, 'id' as rule from x where item_id > 999 union all select id, 'answerable' as rule from x where answerable = (type = 'unanswerable') union all select id, 'grade' from x where g = 0
 union all select id, 'too_few_answers' from x where answerable and (case when g = 2 then 1 else 0 end) < (case when type = 'multi_section' then 2 else 1 end) union all select id, 'labels_on_unanswerable' from x where not answerable
 union all select id, 'grade' from x where g > 2""")  # fmt: skip
def golden_problems(t: Tables) -> DataFrame:
    i = F.col("item_id")
    kind = F.get(F.array(*map(F.lit, ["single_section", "multi_section", "unanswerable"])), (i % 3).cast("int"))
    items = t.benchmark.select(
        F.format_string("q%03d", i).alias("id"), kind.alias("type"), (i % 4 != 0).alias("answerable"), F.array(F.struct(F.lit("a/b.md#c").alias("section"), (i % 5).cast("int").alias("grade"))).alias("relevant_sections")
    )
    return indexing.golden_problems(items)


@query("B17_golden_subset", "select 'kept' as part, item_id from benchmark where item_id % 9 = 0 union all select 'unknown', -1")
def golden_subset(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("id"))
    ids = items.where("id % 9 = 0").unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    kept, unknown = indexing.golden_subset(items, ids)
    return kept.select(F.lit("kept").alias("part"), F.col("id").alias("item_id")).unionByName(unknown.select(F.lit("unknown").alias("part"), F.col("id").alias("item_id")))


# --- directives and containers: a page per document, a code file per nation ---


def with_directives(t: Tables) -> DataFrame:
    """Pages with a fenced include, one inside a list's fence, a container and a comment; every seventh include leads out of the root."""
    k = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("../../../src/f")).otherwise(F.lit("../../src/f")), (F.col("doc_id") % 30).cast("string"), F.lit(".py"))
    text = F.concat(F.lit("start\n{* "), k, F.lit(" ln[2:3] title[\"t\"] *}\n- item\n\n  ```py hl_lines=\"1\"\n  {!> "), k, F.lit(" !}\n  ```\n\n/// tip\n\nfirst\n\nsecond\n\n///\n\n<!-- gone -->\n\nend"))
    return t.documents.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"), text.alias("text"))


def code_files(t: Tables) -> DataFrame:
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat("n_name", F.lit(" "), i)), "\n")
    return t.nation.select(F.concat(F.lit("src/f"), "n_nationkey", F.lit(".py")).alias("path"), lines.alias("text"))


@query("C2_includes", """with x as (select source || '/' || doc_id || '.md' as source_path, chr(10) as l, case when doc_id % 7 > 0 then n_name end as n from documents left join nation on n_nationkey = doc_id % 30)
 select source_path, sha256('start' || l || case when n is not null then '```python title="t"' || l || '# Code above omitted 👆' || l || l || n || ' 2' || l || n || ' 3' || l || l || '# Code below omitted 👇' || l || '```' || l else '' end
  || '- item' || l || l || '  ```py' || l || case when n is not null then '  ' || n || ' 1' || l || '  ' || n || ' 2' || l || '  ' || n || ' 3' || l || '  ' || n || ' 4' || l || '  ' || n || ' 5' || l else '' end || '  ```' || l || l
  || '/// tip' || l || l || 'first' || l || l || 'second' || l || l || '///' || l || l || '<!-- gone -->' || l || l || 'end') as resolved from x""")  # fmt: skip
def resolved_includes(t: Tables) -> DataFrame:
    lines, _ = includes.resolve_includes(c.page_lines(with_directives(t)), code_files(t))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "sub_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("source_path").agg(F.sha2(text, 256).alias("resolved"))


@query("D9_include_problems", """select source || '/' || doc_id || '.md' as source_path, unnest([1, 5])::bigint as line_no, case when doc_id % 7 = 0 then 'outside_root' else 'missing_file' end as rule from documents where doc_id % 30 >= 25 or doc_id % 7 = 0""")
def include_problems(t: Tables) -> DataFrame:
    _, problems = includes.resolve_includes(c.page_lines(with_directives(t)), code_files(t))
    return problems.withColumn("line_no", F.col("line_no").cast("long"))


@query("C7_containers", "select source || '/' || doc_id || '.md' as source_path, 4 as n_blocks, 7 as container_lines from documents")
def containers(t: Tables) -> DataFrame:
    rows = c.blocks(c.page_lines(with_directives(t)))
    inside = F.max(F.when(F.col("markdown").startswith("///"), F.size(F.split("markdown", "\n"))))
    return rows.groupBy("source_path").agg(F.count("*").alias("n_blocks"), inside.cast("long").alias("container_lines"))


@query("C5_comment_drop", "select count(*) as pages, 0 as comments from documents")
def comment_drop(t: Tables) -> DataFrame:
    rows = c.blocks(c.page_lines(with_directives(t)))
    return rows.agg(F.count_distinct("source_path").alias("pages"), F.count_if(F.col("markdown").contains("<!--")).alias("comments"))


@query("C13_long_sections")
def long_sections(t: Tables) -> DataFrame:
    """Documents as pages of one long section: packed parts stay within the limit."""
    pages = t.documents.select(F.concat(F.lit("p"), "doc_id", F.lit(".md")).alias("source_path"), F.concat(F.lit("# T\n\n"), "text").alias("text"))
    parts = c.pack_sections(c.sections(c.blocks(c.page_lines(pages))), 200, 20, 10)
    return parts.groupBy("source_path").agg(F.count("*").alias("n_parts"), F.max(token_count(F.col("content"))).alias("longest"))
