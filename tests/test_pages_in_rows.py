"""Pages are chunked within their rows: the chunks are those of the operators on tables of lines and blocks, and no text is shuffled."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from quillon.operators import corpus as c
from quillon.operators import indexing
from quillon.plans import QUERIES, Tables

LINES = [
    "", "", "", "plain text. More of it here! And (so on.) end", "word " * 30, "# Top", "# Top { #named }", "## Part", "## Part", "## Pärt  K\u212a İ ς", "### Deep { #x y }", "### Deep", "###### six", "####### seven", "Title", "====", " ===", "---",
    "- item", "  - inner", "1. one", "2. two", "\t- tab", "> quote", "lazy", "    code", "\tcode", "```", "```py", "~~~", "````", "``` a`b", "| a | b |", "|---|:-:|", "| x | y |", "/// tip", "///", "//// note", "////", "///\u2028", "/// \t", "///x",
    "<!-- c -->", "<!-- open", "end -->", "<div>", "</div>", "<x-y>", "<p>{{ x }}", "{% raw %}", "{% endraw %}", "{% if %}", "QUJD" * 120, "same code", "***", "a\u2028b", "é\x0bf\x0cg", "e.g. this. i.e. that! `a. b` ok?", "#hash", "\xa0", "line\r", "=",
]
LIMITS = {"limit": 30, "overlap": 5, "least": 8}


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(11)
    rows = [("a/index.md", "# About A\n\nx"), ("a/b/index.md", "No title"), ("index.md", "# Root"), ("a/b/c/index.md", "---\nk: v\n---\n# C & <d>\n\nz"), ("empty.md", ""), ("null.md", None), ("/odd//p.md", "# Odd\n\ntext"), ("blank.md", "\n \n")]
    fence = "\n```\nsame code\n```\n"
    for k in range(250):
        text = "\n".join(rng.choice(LINES) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["", "a/", "a/b/", "a/b/c/", "z/y/"]) + f"{k}.md", rng.choice(["", "---\n", "---\nx: y\n---\n"]) + text + fence * rng.randrange(3)))
    return spark.createDataFrame(rows, "source_path string, text string")


def by_rows(pages):
    """The chunks by the operators on tables, joined page by page."""
    found = c.blocks(c.page_lines(pages))
    parts = c.pack_sections(c.sections(c.drop_noise_code(found)), **LIMITS)
    heads = c.anchors(found).join(found.where("level = 1").select("source_path", "block_no"), ["source_path", "block_no"])
    titles = heads.groupBy("source_path").agg(F.min_by("text", "block_no").alias("title"))
    rows = parts.join(titles, "source_path", "left").join(c.nav_path(pages, titles), "source_path", "left")
    tail = F.when(F.size("anchor_path") > 0, F.concat(F.lit("#"), F.element_at("anchor_path", -1))).otherwise("")
    crumb = F.concat_ws(" > ", F.concat("nav", F.array(F.coalesce("title", "source_path")), "heading_path"))
    return rows.select("source_path", "ordinal", F.concat("source_path", tail).alias("section_id"), "anchor_path", crumb.alias("breadcrumb_text"), "content", "token_count")


def shuffled(df) -> list[str]:
    """The columns that the exchanges of a plan take in."""
    plan = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"\) Exchange\s*\nInput(?: \[\d+\])?: \[(.*)\]", df._jdf.queryExecution().explainString(plan))


def test_blocks_of_a_page_are_those_of_its_lines(pages):
    kinds = ["block_no", "block_type", "kind", "level", "markdown"]
    expected = sorted(map(tuple, c.blocks(c.page_lines(pages)).select("source_path", *kinds).collect()))
    found = c.with_blocks(pages)
    assert sorted(map(tuple, found.select("source_path", F.inline("blocks")).select("source_path", *kinds).collect())) == expected
    assert {k for _, _, _, k, _, _ in expected} == {"heading", "paragraph", "list", "quote", "fence", "indented", "table", "html", "container"}
    anchors = found.select("source_path", F.inline(c.anchored(F.col("heads")))).collect()
    assert sorted(map(tuple, anchors)) == sorted(map(tuple, c.anchors(c.blocks(c.page_lines(pages))).collect()))


def test_chunks_of_pages_are_those_of_their_lines_and_no_text_is_shuffled(pages):
    """every step had its own shuffle of the whole text."""
    own = c.chunks(pages, "https://d", **LIMITS)
    rows = by_rows(pages)
    expected = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, own.select(*rows.columns).collect())) == expected and len(expected) > 500
    assert not [x for x in shuffled(own) if re.search("(lines|blocks|parts|markdown|content|text)#", x)]
    assert [x for x in shuffled(rows) if "markdown#" in x]


def test_chunk_rows_are_numbered_without_their_text(spark, sf_dir, monkeypatch):
    """the content was written and read again for numbers that need only the pages' counts."""
    written = {}

    def spy(df, tag, *by, store=c.stored, **options):
        written[tag] = df.columns
        return store(df, tag, *by, **options)

    monkeypatch.setattr(c, "stored", spy)
    rows = QUERIES["C15_chunks"](Tables(spark, sf_dir))
    assert "content" not in written["chunk-rows"] and "page-blocks" not in written
    assert rows.agg(F.count_distinct("chunk_id") == F.max("chunk_id")).first()[0] and rows.count() > 200


def test_index_build_shuffles_texts_into_buckets_only(spark, pages, tmp_path, monkeypatch):
    """a text was shuffled for its vector, for its number and for every step of the chunks. Equal texts are embedded once, and a known one is not."""
    seen, publish = [], indexing.publish_index

    def spy(documents, chunks, *rest):
        seen.append(shuffled(chunks))
        return publish(documents, chunks, *rest)

    def embed(batches):
        for pdf in batches:
            assert not pdf["key"].duplicated().any() and not pdf["text"].str.startswith("About A").any()
            yield pd.DataFrame({"key": pdf["key"], "value": [[float(len(x)), 1.0] for x in pdf["text"]]})

    monkeypatch.setattr(indexing, "publish_index", spy)
    places = f"file://{tmp_path}/versions", f"file://{tmp_path}/index"
    none = spark.createDataFrame([], "index_version_id long, config_hash string, status string, is_active boolean")
    rows = c.with_chunk_ids(c.chunks(pages, "https://d")).withColumn("text", F.concat_ws("\n\n", "breadcrumb_text", "content"))
    cache = rows.where("startswith(text, 'About A')").select(F.col("content_hash").alias("key"), F.array(F.lit(0.0), F.lit(-1.0)).cast("array<float>").alias("value")).dropDuplicates(["key"])
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        assert indexing.build_index(pages, "https://d", cache, embed, none, *places, {}, 2)["status"] == "ready"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    found = spark.read.parquet(f"{places[1]}/chunks")
    vector = F.when(F.col("text").startswith("About A"), F.array(F.lit(0.0), F.lit(-1.0))).otherwise(F.array(F.length("text").cast("double"), F.lit(1.0)))
    columns = ["chunk_id", "source_path", "ordinal", "section_id", "anchor_path", "breadcrumb_text", "url", "content", "token_count", "content_hash"]
    expected = sorted(map(tuple, rows.select(*columns, vector).collect()))
    assert sorted(map(tuple, found.select(*[F.col("document_id" if x == "source_path" else x) for x in columns], F.col("embedding").cast("array<double>")).collect())) == expected
    assert len(seen) == 1 and seen[0] and not [x for x in seen[0] if re.search("(content|text)#", x)]
