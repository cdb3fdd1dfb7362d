"""Operators and readers on small inline tables, streams against their batch twins, and plans."""

import hashlib
import hmac
import json
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from quillon.functions import links, numbers, text
from quillon.operators import agreement, answers, gates, indexing, retrieval, telemetry
from quillon.plans import QUERIES, Tables
from quillon.sources import readers, store
from quillon.streaming import jobs


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column).collect()]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.analyze(x), "The runs, RUNNING; Cities of it") == [["run", "run", "city"]]
    assert one(spark, text.normalize_question(x), "  What IS  ﬁne?! ", "a.b c") == ["what is fine", "a.b c"]
    assert one(spark, text.nfkc(x), "ﬁ Å") == [unicodedata.normalize("NFKC", "ﬁ Å")]
    key = b"k" * 90
    assert one(spark, text.pseudonym(x, key), "é")[0] == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    assert one(spark, text.snippet(x, 10), "short", "one two three", "abcdefghijklmn", "one two 12 x") == ["short", "one two", "abcdefghij", "one two 12"]
    assert one(spark, text.sentences(x), "One. Two, e.g. this! `a. b` ok? (Yes.) End") == [["One.", "Two, e.g. this!", "`a. b` ok?", "(Yes.)", "End"]]
    assert one(spark, text.escape_content(x), "a < source> </ SOURCE>") == ["a &lt; source> &lt;/ SOURCE>"]
    assert one(spark, text.normalize_label(x), " not-supported  x ") == ["NOT_SUPPORTED_X"]
    assert one(spark, text.slug(x), "Été: a B_c!") == ["ete-a-b_c"]


def test_numbers(spark):
    x = F.col("x")
    assert one(spark, numbers.unit(x), 0.5, -1.0, 3.0, float("nan"), float("inf"), None, kind="double") == [0.5, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert one(spark, numbers.l2_normalize(x), [3.0, 4.0], [0.0, 0.0], kind="array<double>") == [[0.6, 0.8], None]
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 27)], "g string, v double")
    assert numbers.nearest_rank(rows, "v", {"p": 95}, ["g"]).first().p == 25.0


def test_gates(spark):
    cases = spark.createDataFrame([(0.54, 0.58, 0.04, None), (0.539, 0.58, 0.04, None), (float("nan"), 0.5, 0.04, None), (None, 0.5, 0.04, None), (0.5, 0.5, None, 0.6), (0.1, 0.5, None, None)], "c double, b double, t double, f double")
    got = [r[0] for r in cases.select(gates.passes(F.col("c"), gates.threshold(F.col("b"), F.col("t"), F.col("f")))).collect()]
    assert got == [True, False, False, False, False, None]
    assert [r[0] for r in spark.createDataFrame([(1, 5), (2, 9), (0, 0)], "e int, n int").select(gates.inconclusive(F.col("e"), F.col("n"))).collect()] == [False, True, True]


def test_rerank_keeps_order_of_degraded_questions(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 2)], "question_id long, chunk_id long, fused_rank int")
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (2, 11, 0.9)], "question_id long, chunk_id long, rerank_score double")
    rows = {(r.question_id, r.final_rank): (r.chunk_id, r.rerank_error) for r in retrieval.rerank(found, scores, 5).collect()}
    assert rows == {(1, 1): (11, None), (1, 2): (10, None), (2, 1): (10, "missing_scores"), (2, 2): (11, "missing_scores")}
    with pytest.raises(ValueError):
        retrieval.top(found, 0, "r", "chunk_id")
    with pytest.raises(ValueError):
        retrieval.retrieval_configs({"k": 1}, ["hybrid_rerank"])
    assert retrieval.retrieval_configs({"k": 1, "rerank_model": "m"}, ["dense"]) == [{"k": 1, "mode": "dense"}]


def test_rerank_cached(spark):
    found = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q", "b"), (2, 2, "q", "b")], "question_id long, chunk_id long, question string, content string")
    key = hashlib.sha256(b'["m","q","a"]').hexdigest()
    cache = spark.createDataFrame([(key, 0.75)], "key string, rerank_score double")

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "rerank_score": 0.25})

    scores, new, stats = retrieval.rerank_cached(found, cache, "m", score)
    assert sorted(r.rerank_score for r in scores.collect()) == [0.25, 0.25, 0.75] and new.count() == 1
    assert tuple(stats.first()) == (1, 2)


def test_scores_out_of_range_are_refused(spark):
    found = spark.createDataFrame([(1, 1, "q", "a")], "question_id long, chunk_id long, question string, content string")

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "rerank_score": 1.5})

    with pytest.raises(Exception, match="no score"):
        retrieval.rerank_cached(found, spark.createDataFrame([], "key string, rerank_score double"), "m", score)[0].collect()


def plain_lexical(questions, rows, k):
    return retrieval.top(
        questions.select("question_id", F.explode(F.array_distinct(text.analyze(F.col("question")))).alias("term")).join(rows, "term").groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.col("hits_a") + F.col("hits_b") * 0.4), 9).alias("fts_score")),
        k, "fts_rank", F.desc("fts_score"), "chunk_id")


def test_levels_of_postings_are_left_out(spark):
    """Rare heading words decide; the common word's single hits are not read. The rows are those of all postings, whatever k."""
    rng = random.Random(7)
    body = lambda k: " ".join(["common"] * rng.choice([1, 1, 1, 1, 9]) + [f"w{rng.randrange(30)}" for _ in range(rng.randrange(8))] + ["rareword"] * (k % 97 == 0) * rng.randrange(1, 9))
    chunks = spark.createDataFrame([(k, "zebra title" if k % 150 == 0 else None, body(k)) for k in range(3000)], "chunk_id long, heading string, body string")
    questions = spark.createDataFrame([(1, "common rareword"), (2, "zebra common w1 w2"), (3, "common"), (4, "the of"), (5, "w3 w4 w5 rareword absentword"), (6, "absentword")], "question_id long, question string")
    found = retrieval.postings(chunks)
    index = retrieval.lexical_index(found, 50)
    for k in (1, 5, 40, 5000):
        got = sorted(map(tuple, retrieval.lexical_search(questions, index, k).collect()))
        assert got == sorted(map(tuple, plain_lexical(questions, found, k).collect()))
    terms = questions.select("question_id", F.explode(F.array_distinct(text.analyze(F.col("question")))).alias("term"))
    read = retrieval.needed_levels(terms, index, 5).join(index.levels, ["term", "hit"]).groupBy("question_id").agg(F.sum("n").alias("n"))
    whole = {r.question_id: r.n for r in terms.join(index.levels, "term").groupBy("question_id").agg(F.sum("n").alias("n")).collect()}
    part = {r.question_id: r.n for r in read.collect()}
    assert part[3] < whole[3] / 2 and all(part[q] <= whole[q] for q in part) and set(part) == {1, 2, 3, 5}
    parts = index.rows.groupBy("term", "hit", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 120 and index.rows.where("term = 'common'").count() == 3000


def test_built_tables_follow_their_source(spark, tmp_path):
    """A table that is written anew under the same name is built anew; otherwise it is built once."""
    path = f"file://{tmp_path}/t"
    builds = []

    def build():
        builds.append(1)
        return spark.read.parquet(path).selectExpr("x + 1 as y")

    for rows in (3, 3, 5):
        if not builds or rows == 5:
            spark.range(rows).selectExpr("id as x").coalesce(1).write.mode("overwrite").parquet(path)
        assert store.built_once(build, "follow", spark.read.parquet(path), "y").count() == rows
    assert len(builds) == 2


def test_kappa_is_undefined_when_chance_is_certain(spark):
    rows = spark.createDataFrame([(i, "k", "s", "A", "A") for i in range(4)], "item_id int, kind string, source string, human string, judge string")
    found = agreement.agreement_scopes(rows).collect()
    assert len(found) == 4 and all(r.undefined and r.kappa is None for r in found)


def test_rates_cache_and_outages(spark):
    at = [f"2024-01-01 00:00:{s:02d}" for s in (0, 1, 2, 3)] + ["2024-01-01 00:01:00"]
    events = spark.createDataFrame([("k", t, i) for i, t in enumerate(at)] + [(None, at[0], 9)], "key string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: (r.rejected_by, r.retry_after_s) for r in telemetry.rate_decisions(events, 2, 2).collect()}
    assert got == {0: (None, 0), 1: (None, 0), 2: ("minute", 58), 3: ("minute", 57), 4: ("day", 86340), 9: (None, 0)}
    requests = spark.createDataFrame([("k", f"2024-01-01 00:00:{s:02d}", i, ok) for i, (s, ok) in enumerate([(0, False), (1, True), (5, True), (10, True), (11, True), (12, False)])], "key string, ts string, request_id long, storable boolean").withColumn("ts", F.to_timestamp("ts"))
    kinds = {r.request_id: (r.kind, r.hits) for r in telemetry.cache_classify(requests, 10).collect()}
    assert kinds == {0: ("uncached", 0), 1: ("miss", 0), 2: ("hit", 1), 3: ("hit", 2), 4: ("miss", 0), 5: ("hit", 1)}
    attempts = spark.createDataFrame([("p", f"2024-01-01 00:00:{s:02d}", i, o, w) for i, (s, o, w) in enumerate([(0, "f", None), (5, "f", None), (6, "ok", None), (7, "f", None), (8, "f", None), (9, "f", 100)])], "provider string, ts string, attempt_id long, outcome string, retry_after_s int").withColumn("ts", F.to_timestamp("ts"))
    out = telemetry.outage_intervals(attempts).collect()
    assert len(out) == 1 and (out[0].end - out[0].start).total_seconds() == 100


def test_midnight_across_clock_changes(spark):
    ts = F.to_timestamp(F.col("x"))
    got = one(spark, telemetry.next_midnight(ts, "America/Los_Angeles").cast("string"), "2024-03-10 09:00:00", "2024-11-03 08:00:00")
    assert got == ["2024-03-11 07:00:00", "2024-11-04 08:00:00"]


def test_cost_problems(spark):
    usage = spark.createDataFrame([(1, "x", "m", 1_000_000, 0, 0), (1, "x", "m", 0, 1, 0), (2, "fake", "zz", 5, 5, 5), (3, "x", "zz", 1, 1, 1), (4, "x", "u", 1, 1, 1)], "request_id long, provider string, model string, input_tokens long, output_tokens long, searches long")
    prices = spark.createDataFrame([("m", "0.1", "0.4", "0", "verified"), ("u", "1", "1", "1", "unverified")], "model string, i string, o string, s string, status string")
    prices = prices.selectExpr("model", "cast(i as decimal(12,6)) input_per_mtok", "cast(o as decimal(12,6)) output_per_mtok", "cast(s as decimal(12,6)) per_1k_searches", "status")
    costs, problems = telemetry.shadow_cost(usage, prices)
    assert {r.request_id: str(r.cost_usd) for r in costs.collect()} == {1: "0.10000040", 2: "0E-8"}
    assert {(r.request_id, r.rule) for r in problems.collect()} == {(3, "unknown_model"), (4, "unverified_price")}


def test_strip_urls_leaves_code_alone(spark):
    claims = "request_id long, status string, answer_markdown string, claims array<struct<text:string,citation_ids:array<string>,self_confidence:double>>"
    text_in = "See [a [b]](http://x.example/(1)) ok.\n```\nhttp://in.code\n```\n[ref]: http://y.example\n<mail@x.example> `http://z` http://localhost:8000/docs."
    rows = answers.strip_urls(spark.createDataFrame([(1, "answered", text_in, [])], claims)).first()
    assert rows.answer_markdown == "See a [b] ok.\n```\nhttp://in.code\n```\n\n `http://z` `http://localhost:8000/docs`." and rows.removed == 3


def test_strip_urls_of_single_lines(spark):
    cases = {
        "[c1](https://x.example) and ![c1, c2](u)": ("[c1] and [c1, c2]", 2),
        "``a `http://in.code` b`` then http://out.example.": ("``a `http://in.code` b`` then.", 1),
        "`open and www.x.example": ("`open and", 1),
        "[![alt](i.png)](https://x.example) end": ("alt end", 2),
        '[a](<u v> "t (x)") [b](u \'t\') [c](u (t))': ("a b c", 3),
        "[http://shown.example](http://to.example), ok": (", ok", 1),
        "[see `code`](https://x.example/(a)) z": ("[see `code`] z", 1),
        "text](https://x.example": ("text]", 1),
        "[a [b [c] d] e](u)": ("a [b [c] d] e", 1),
        "> - [ref]: https://x.example 'title'": ("> -", 1),
        "[c1]: the order of things.": ("[c1]: the order of things.", 0),
        "HTTPS://X.example/a?b=(c), www.y.example!": ("(c),!", 2),
        "<HTTP://localhost:80/x> <ftp://f.example> <a@b.example>.": ("`HTTP://localhost:80/x`.", 2),
        "localhost:8000 stays, http://localhost.example goes": ("localhost:8000 stays, goes", 1),
        "[mine](http://127.0.0.1/x) [http://127.0.0.1/x](u)": ("mine `http://127.0.0.1/x`", 2),
        "plain [brackets] (and) `code`": ("plain [brackets] (and) `code`", 0),
        "[c1]: https://x.example": ("", 1),
        "1. > [c2]: <https://x.example/a b> \"open title": ("1. >", 1),
        "-[a]: b": ("-[a]: b", 0),
        "[a\\]b]: u": ("", 1),
        "https://www.x.example/y and http:// alone": (" and http:// alone", 1),
        "www.a.examplewww.b.example. End": (". End", 2),
        "a<b and 3 < 4 > 1 <br> <x:y> <urn:a:b>": ("a<b and 3 < 4 > 1 <br> <x:y>", 1),
        "(see http://x.example/a?b#c).": ("(see).", 1),
        "[a](b c) [d](e \"f g\")": ("[a] d", 2),
        "user@127.0.0.1 http://me@127.0.0.1:80/x!": ("user@127.0.0.1 `http://me@127.0.0.1:80/x`!", 0),
    }
    given = spark.createDataFrame([(i, "answered", t, []) for i, t in enumerate(cases)], "request_id long, status string, answer_markdown string, claims array<struct<text:string,citation_ids:array<string>,self_confidence:double>>")
    got = {r.request_id: (r.answer_markdown, r.removed) for r in answers.strip_urls(given).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_markers(spark):
    cases = {"[c1] [c2, c3][c4;c5] [ c1] [c] [c1x] [[c7]] [c8": [["c1"], ["c2", "c3"], ["c4", "c5"], ["c7"]], "": [], "c1]": [], "[c1\u00b2]": []}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    rows = {r.i: r for r in frame.select("i", links.markers(F.col("t")).alias("m"), links.with_markers(F.col("t"), lambda m: F.array_join(m, "+")).alias("w")).collect()}
    assert [rows[i].m for i in range(len(cases))] == list(cases.values())
    assert rows[0].w == "c1 c2+c3c4+c5 [ c1] [c] [c1x] [c7] [c8"


def test_definitions_do_not_cite(spark):
    claims = "request_id long, status string, answer_markdown string, claims array<struct<text:string,citation_ids:array<string>,self_confidence:double>>"
    given = spark.createDataFrame([(1, "answered", "One [c2].\n[c1]: https://a.example \"t\"\n> [c3]: <b>\n[see [c4]](https://x.example)\n```\n[c5]\n```", [])], claims)
    assert sorted(r.label for r in answers.label_uses(given).collect()) == ["c2", "c4"]
    labels = spark.createDataFrame([(1, f"c{k}", k) for k in range(1, 6)], "request_id long, label string, chunk_id long").selectExpr("*", "'u' as url", "'t' as title", "'b' as breadcrumb_text", "'x' as content")
    assert answers.rewrite_markers(given, labels).first().answer_markdown == "One [1].\n\n>\nsee [2]\n```\n[c5]\n```"


def test_claims_without_citation_are_capped(spark):
    rows = {(r.request_id, r.claim_no): r for r in answers.score_claims(*_claims(spark)).collect()}
    assert rows[(1, 1)].confidence == pytest.approx(0.15) and rows[(1, 2)].confidence == 0.0
    assert rows[(1, 0)].confidence > rows[(1, 1)].confidence and rows[(1, 0)].n_citations == 1


def _claims(spark):
    a = spark.createDataFrame([(1, "answered", "x", [("a", ["c1", "c1", "c7"], 1.0), ("b", [], 1.0), ("c", [], float("nan"))])], "request_id long, status string, answer_markdown string, claims array<struct<text:string,citation_ids:array<string>,self_confidence:double>>")
    labels = spark.createDataFrame([(1, "c1", 5)], "request_id long, label string, chunk_id long")
    got = spark.createDataFrame([(1, 5, 1, 0.2, None, None, 0.016, None), (1, 6, 2, 0.3, 1, float("inf"), 0.01, 2.0)], "request_id long, chunk_id long, dense_rank int, dense_distance double, fts_rank int, fts_score double, rrf_score double, rerank_score double")
    return a, labels, got


def test_index_build_publish_and_reuse(spark, tmp_path):
    pages = spark.createDataFrame([("a.md", "# A\n\nSome text.\n\n## B\n\nMore text here.")], "source_path string, text string")
    versions = "index_version_id long, config_hash string, status string, is_active boolean"
    none = spark.createDataFrame([], versions)
    cache = spark.createDataFrame([], "key string, value array<float>")

    def embed(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "value": [[1.0, 0.0]] * len(pdf)})

    paths = f"file://{tmp_path}/versions", f"file://{tmp_path}/index"
    row = indexing.build_index(pages, "https://d", cache, embed, none, *paths, {"b": 1, "a": 2}, 2)
    assert row["status"] == "ready" and row["index_version_id"] == 1
    known = spark.read.parquet(paths[0]).select("index_version_id", "config_hash", "status", "is_active")
    assert indexing.build_index(pages, "https://d", cache, embed, known, *paths, {"a": 2, "b": 1}, 2)["index_version_id"] == 1
    assert indexing.build_index(pages, "https://d", cache, embed, known, *paths, {"a": 3}, 9)["status"] == "failed"
    with pytest.raises(ValueError):
        indexing.compatible({"embedding_model": "m", "embedding_dim": 2}, "m", 3)


def test_hash_embedding_is_a_unit_vector(spark):
    a, b, c = one(spark, indexing.hash_embedding(F.col("x"), "doc", 20), "x", "x", "y")
    assert a == b != c and len(a) == 20 and sum(v * v for v in a) == pytest.approx(1)


def test_readers(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/sub/a b.md").write_text("# A\n")
    (tmp_path / "docs/x.py").write_text("pass\n")
    root = f"file://{tmp_path}/docs"
    assert [(r.source_path, r.text) for r in readers.scan_pages(spark, root).collect()] == [("sub/a b.md", "# A\n")]
    assert [r.path for r in readers.scan_code_files(spark, root).collect()] == ["x.py"]
    (tmp_path / "g.jsonl").write_text('{"id": "q001", "question": "x", "answerable": true}\n{broken\n')
    items, problems = readers.read_golden(spark, f"file://{tmp_path}/g.jsonl")
    assert [r.id for r in items.collect()] == ["q001"] and [(r.file, r.line_no, r.line) for r in problems.collect()] == [("g.jsonl", 2, "{broken")]
    (tmp_path / "sheet.csv").write_text('﻿item_id;human\na1;"yes\nplease"\n;\na2;no\n', encoding="utf-8")
    assert sorted(r.item_id for r in readers.read_sheet(spark, f"file://{tmp_path}/sheet.csv").collect()) == ["a1", "a2"]
    results = {"results": [{"config": "c", "id": "1", "components": [{"metric": "m", "value": 1.0, "errored": False, "not_applicable": False}, {"metric": "n", "value": 0.0, "errored": True}]}, {"config": "c", "id": "2", "error": "x"}], "extra": 1}
    (tmp_path / "r.json").write_text(json.dumps(results))
    rows = readers.read_generation_results(spark, f"file://{tmp_path}/r.json").collect()
    assert sorted((r.id, r.metric or "", r.state or "", r.value) for r in rows) == [("1", "m", "scored", 1.0), ("1", "n", "errored", None), ("2", "", "", None)]
    run = spark.createDataFrame([("dense", 1)], "config string, n int")
    readers.write_run(run, f"file://{tmp_path}/run")
    assert readers.read_run(spark, f"file://{tmp_path}/run").first().config == "dense"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Two files read in splits of a few lines each: numbers run on, also with line ends of two characters and a last line without one."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(f"{k} {'x' * (k % 50)}\n" for k in range(1, 901)))
    (tmp_path / "in/b.jsonl").write_bytes(b"".join(b"%d\r\n" % k for k in range(1, 301)) + b"301")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.numbered_lines(spark, f"file://{tmp_path}/in")
        assert spark.read.text(f"file://{tmp_path}/in").rdd.getNumPartitions() > 10
        got = {(r.file, r.line_no): r.line.split()[0] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", k): str(k) for k in range(1, 901)} | {("b.jsonl", k): str(k) for k in range(1, 302)}


def drain(frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append" if name == "rates" else "complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams_match_their_batch_twins(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens"))
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    drain(jobs.window_counts(stream, "1 hour"), "windows")
    batch = events.groupBy(F.window("ts", "1 hour"), "key").count().select("key", F.col("window.start").alias("start"), "count")
    assert spark.table("windows").exceptAll(batch).isEmpty() and batch.exceptAll(spark.table("windows")).isEmpty()
    drain(jobs.daily_usage(stream), "usage")
    assert {(r.calls, r.tokens) for r in spark.table("usage").collect()} == {(r.calls, r.tokens) for r in QUERIES["J3_daily_tokens"](Tables(spark, sf_dir)).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        drain(jobs.rate_decisions(stream.select("key", "ts", "event_id"), 1, 2), "rates")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    twin = telemetry.rate_decisions(events.select("key", "ts", "event_id"), 1, 2).select("key", "event_id", "allowed", "rejected_by")
    assert twin.count() == spark.table("rates").count() and twin.exceptAll(spark.table("rates")).isEmpty()


def test_log_sink_writes_each_request_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "request_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = jobs.log_sink(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(r.request_id for r in out.collect()) == [1, 2] and "day" in out.columns


def test_plans(spark, sf_dir):
    def plan(name):
        return QUERIES[name](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()

    dense = plan("L1_dense_search")
    assert "WindowGroupLimit" in dense and "BroadcastNestedLoopJoin" in dense
    for name in ("L1_dense_search", "L2_lexical_search", "L3_hybrid_search", "E24_agreement_scopes", "J1_rate_decisions", "J4_cache_classify", "L9_claim_confidence"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name)
    assert "ReadSchema: struct<event_type:string,value:double>" in plan("E8_percentile_cont")


def test_negative_controls_against_plain(spark):
    """The greedy choice, over every pair; words and sections that clash, several claims and sources of a question."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    claims = [(q, [f"s{q % 5}"], sorted(rng.sample(words, 4)), f"claim {q} {k}") for q in range(30) for k in range(q % 3 + 1)] + [(31, ["s9"], [], "no words")]
    sources = [(q, [f"s{(q + k) % 5}"], sorted(rng.sample(words, 6)), f"source {q} {k}") for q in range(30) for k in range(2)]
    given = spark.createDataFrame(claims, "question_id long, sections array<string>, words array<string>, claim string")
    pool = spark.createDataFrame(sources, "source_question long, source_sections array<string>, source_words array<string>, source string")

    def sha(*parts):
        return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()

    order = {r.donor: r.k for r in given.select(F.concat_ws("|", "question_id", "claim").alias("donor")).withColumn("k", text.seeded_rank(5, "control-claim", F.col("donor"))).collect()}
    for n in (3, 40):
        made, used = [], set()
        for q, sec, ws, claim in sorted(claims, key=lambda c: order[f"{c[0]}|{c[3]}"]):
            if len(made) == n or q in used:
                continue
            fit = [(sha(5, f"control-sources:{q}|{claim}", f"{b}|{x}"), b, x) for b, bs, bw, x in sources if b != q and b not in used and not set(sec) & set(bs) and len(set(ws) & set(bw)) <= 0.5 * len(ws)]
            if fit:
                made.append((min(fit)[1], q, claim, min(fit)[2]))
                used |= {q, min(fit)[1]}
        got = agreement.negative_controls(given, pool, n, 5, 0.5).collect()
        assert [tuple(r)[:4] for r in got] == made and len(made) == min(n, len(made)) > 2
    donors = agreement.control_donors(given, 5).limit(5)
    plan = agreement.fitting_sources(donors.collect(), donors, pool, 5, 0.5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    alike = agreement.too_alike(agreement.control_donors(given, 5), pool.withColumn("source_name", F.concat_ws("|", "source_question", "source")), 0.5)
    expected = {(f"{q}|{c}", f"{b}|{x}") for q, _, ws, c in claims for b, _, bw, x in sources if len(set(ws) & set(bw)) > 0.5 * len(ws)}
    assert {tuple(r) for r in alike.collect()} == expected and expected


def test_percentiles_of_hot_groups_against_numpy(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.random(), 0.5])) for _ in range(4000)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("none", None)]
    got = {r["g"]: r for r in numbers.continuous_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, ["g"]).collect()}
    for g in ("hot", "one", None):
        values = [v for k, v in rows if k == g]
        assert [got[g][k] for k in "abcd"] == pytest.approx([np.quantile(values, p) for p in (0.5, 0.95, 0.0, 1.0)]) and got[g]["n"] == len(values)
    assert "none" not in got


def test_outages_against_plain(spark):
    rng = random.Random(4)
    t, rows = 0, []
    for k in range(3000):
        t += rng.choice([1, 5, 19, 20, 31, 61, 900, 4000] if k % 7 == 0 else [1, 5, 19, 20])
        rows.append((k, rng.choice("ab"), t, rng.choice(["ok", "timeout", "error"]), rng.choice([None, 10, 100, 5000])))
    given = spark.createDataFrame(rows, "attempt_id long, provider string, s long, outcome string, retry_after_s int").withColumn("ts", F.timestamp_seconds("s"))
    expected = []
    for p in "ab":
        mine = [r for r in rows if r[1] == p]
        openings = []
        for k in range(2, len(mine)):
            last = mine[k - 2 : k + 1]
            if all(r[3] != "ok" for r in last) and last[2][2] - last[0][2] <= 60:
                openings.append((last[2][2], last[2][2] + max(30, min(last[2][4] or 0, 3600))))
        merged = []
        for a, b in openings:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        expected += [(p, a, b) for a, b in merged]
    got = telemetry.outage_intervals(given).select("provider", F.unix_seconds("start"), F.unix_seconds("end")).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 20


def test_cache_openings_against_plain(spark):
    """Keys with and without pauses, ties, and gaps of exactly the time to live."""
    rng = random.Random(9)
    rows, t = [], {"a": 0, "b": 0, "c": 0}
    for k in range(900):
        key = rng.choice("abc")
        t[key] += rng.choice([0, 1, 5, 10] if key == "a" else [1, 10, 30, 100])
        rows.append((key, k, t[key], rng.random() < 0.8))
    given = spark.createDataFrame(rows, "key string, request_id long, s long, storable boolean").withColumn("ts", F.timestamp_seconds("s"))
    expected = {}
    for key, k, s, storable in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last = expected.setdefault(key, [])
        if storable and (not last or s >= last[-1][1] + 30):
            last.append((k, s))
    got = telemetry.opening_requests(given, 30).collect()
    assert sorted((r.key, r.request_id) for r in got) == sorted((key, k) for key, found in expected.items() for k, _ in found)
    plain = []
    for key in "abc":
        until, hits = None, 0
        for _, k, s, storable in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if until is not None and s < until:
                hits += 1
                plain.append((key, k, "hit", hits))
            elif storable:
                until, hits = s + 30, 0
                plain.append((key, k, "miss", 0))
            else:
                plain.append((key, k, "uncached", hits))
    assert sorted(map(tuple, telemetry.cache_classify(given, 30).collect())) == sorted(plain)
    assert telemetry.cache_classify(given.limit(0), 30).count() == 0


def test_cache_of_a_key_that_never_pauses(spark):
    """One chain of 2,000 entries over 40,000 requests of a key; no array, no window over the whole key's requests."""
    given = spark.range(40_000).select(F.lit("k").alias("key"), F.col("id").alias("request_id"), (F.col("id") * 10 % 199_990).alias("s"), F.lit(True).alias("storable")).withColumn("ts", F.timestamp_seconds("s"))
    times = sorted((i * 10 % 199_990, i) for i in range(40_000))
    opened = []
    for s, i in times:
        if not opened or s >= opened[-1][0] + 95:
            opened.append((s, i))
    found = telemetry.opening_requests(given, 95)
    assert sorted(r.request_id for r in found.collect()) == sorted(i for _, i in opened) and len(opened) > 1900
    assert "collect_list" not in telemetry.cache_classify(given, 95)._jdf.queryExecution().optimizedPlan().toString()


def test_rates_of_a_hot_key_count_minutes(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else "cold", k, rng.randrange(3 * 86_400)) for k in range(4000)]
    events = spark.createDataFrame(rows, "key string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    minute, day, expected = {}, {}, {}
    for key, k, s in sorted(rows, key=lambda r: (r[2], r[1])):
        minute[key, s // 60] = minute.get((key, s // 60), 0) + 1
        if minute[key, s // 60] > 2:
            expected[k] = "minute"
            continue
        day[key, s // 86_400] = day.get((key, s // 86_400), 0) + 1
        expected[k] = "day" if day[key, s // 86_400] > 500 else None
    decided = telemetry.rate_decisions(events, 2, 500)
    assert {r.event_id: r.rejected_by for r in decided.collect()} == expected and set(expected.values()) == {"minute", "day", None}


def test_row_places_of_a_hot_group_with_ties_and_nulls(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("g"),
        F.when(F.col("id") % 7 > 0, F.col("id") * 7919 % 211).alias("v"),
        "id",
    )
    expected = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    found = numbers.row_places(rows, ["g"], "v", "id")
    assert found.columns == expected.columns and found.exceptAll(expected).count() == 0 and found.count() == 3000
    assert numbers.row_places(rows.limit(0), ["g"], "v").count() == 0
    empty = numbers.row_places(rows.where("v is null"), ["g"], "v", "id")
    assert sorted(r.place for r in empty.collect() if r.g == "cold") == list(range(1, 1 + rows.where("v is null and g = 'cold'").count()))


def test_slices_of_places_are_cut_at_one_set_of_borders(spark):
    """Quantile sketches that are merged anew for rows and for counts need not agree."""
    rows = spark.range(0, 400_000, 1, 32).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 399_989).cast("double").alias("v"), "id")
    values = np.sort(np.arange(400_000) * 7919 % 399_989)
    found = numbers.nearest_rank(rows, "v", {"p50": 50, "p95": 95}, ["g"])
    assert tuple(found.first())[1:] == (values[199_999], values[379_999], 400_000)
    places = numbers.row_places(rows, ["g"], "v", "id")
    assert places.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (400_000, 1, 400_000)
    for df in (found, numbers.continuous_percentiles(rows, "v", {"p50": 0.5}, ["g"]), places):
        assert "percentile_approx" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_search_orders_bounded_pairs_only(spark, sf_dir):
    """Against all pairs: copies tie by chunk_id, vectors that are absent or short come last, a question without a vector has the first chunks."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 3)).round(1)
    rows = [(k, None if k % 500 == 3 else vectors[k % 40].tolist()[: 2 if k % 500 == 4 else 3]) for k in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(k, None if k == 9 else rng.normal(size=3).tolist()) for k in range(10)], "question_id long, embedding array<float>")
    given = {k: np.float32(v).astype(float) for k, v in rows if v is not None and len(v) == 3}
    found = retrieval.dense_search(asked, chunks, 60)
    got = {(r.question_id, r.dense_rank): r.chunk_id for r in found.collect()}
    expected = {}
    for q in asked.collect():
        def at(k, q=q):
            if q.embedding is None or k not in given:
                return (1, 0.0, k)
            a, b = given[k], np.float32(q.embedding).astype(float)
            return (0, 1.0 - (((0.0 + a[0] * b[0]) + a[1] * b[1]) + a[2] * b[2]), k)
        expected |= {(q.question_id, i + 1): k for i, k in enumerate(sorted(range(1500), key=at)[:60])}
    assert got == expected
    whole = {(r.question_id, r.chunk_id) for r in retrieval.dense_search(asked, chunks.where("chunk_id < 70"), 70).collect()}
    assert whole == {(q, c) for q in range(10) for c in range(70)}
    # the vectors are searched once for all that is read from them, and means need no pairs
    for name in ("L10_retrieval_eval", "L11_retrieval_gate"):
        assert "embedding#" not in QUERIES[name](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in QUERIES["D1_question_chunk_distance"](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()


def test_lexical_index_is_shuffled_neither_by_term_nor_for_few_questions(spark, monkeypatch):
    rows = [(k, f"head {k % 3}", " ".join(f"w{(k * j) % 11}" for j in range(1, 8))) for k in range(300)]
    found = retrieval.postings(spark.createDataFrame(rows, "chunk_id long, heading string, body string"))
    assert "hashpartitioning(term" not in found._jdf.queryExecution().executedPlan().toString()
    index = retrieval.lexical_index(store.stored(found, "test-postings"), block=16)
    assert "hashpartitioning(term#" not in index.rows._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    index = retrieval.LexicalIndex(store.stored(index.rows, "test-index"), store.stored(index.levels, "test-levels"))
    asked = spark.createDataFrame([(1, "w3 w5 head"), (2, "w7"), (3, "none")], "question_id long, question string")
    search = retrieval.lexical_search(asked, index, 7)
    plan = search._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan
    few = {tuple(r) for r in search.collect()}
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_LEVELS", 0)
    assert few == {tuple(r) for r in retrieval.lexical_search(asked, index, 7).collect()} and len(few) == 14


def test_dense_search_in_blocks_equals_all_pairs(spark, monkeypatch):
    """Copies in several blocks, vectors that are absent, short, NaN, infinite, huge or tiny, on both sides: the ranks and distances of the join of all pairs."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 4)).round(1)
    odd = {3: None, 4: [1.0, 2.0], 5: [float("nan"), 1.0, 0.0, 2.0], 6: [float("inf"), 0.0, 1.0, 1.0], 7: [1e200, -1e200, 1.0, 0.0], 8: [1e-200, 0.0, 0.0, 0.0], 9: [0.0] * 4, 10: [1.0, None, 2.0, 3.0], 11: [-1e155, 1e155, 1e155, 0.0]}
    vector = lambda k, m: odd[k % m] if k % m in odd else base[k % 60].tolist()
    chunks = spark.createDataFrame([(k, vector(k, 97)) for k in range(900)], "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, vector(k, 40)) for k in range(80)], "question_id long, embedding array<double>")
    exact = lambda rows: sorted((r.question_id, r.dense_rank, r.chunk_id, repr(r.distance)) for r in rows.collect())
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 30)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 250)
    for k in (1, 12, 400, 1000):
        monkeypatch.setattr(retrieval, "JOINED_PAIRS", 10**9)
        joined = retrieval.dense_search(asked, chunks, k)
        monkeypatch.setattr(retrieval, "JOINED_PAIRS", 1000)
        found = retrieval.dense_search(asked, chunks, k)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
        assert exact(found) == exact(joined)
    singles, names = asked.withColumn("embedding", F.col("embedding").cast("array<float>")), chunks.withColumn("chunk_id", F.concat(F.lit("é"), "chunk_id"))
    found = retrieval.dense_search(singles, names, 7)
    monkeypatch.setattr(retrieval, "JOINED_PAIRS", 10**9)
    assert exact(found) == exact(retrieval.dense_search(singles, names, 7))


def test_analyzer_runs_patterns_on_few_words(spark):
    """The rules as one pattern after the other, on every ending of up to four letters that they look at."""
    import itertools
    import re

    def stem(w):
        for pattern, replacement in [(r"([a-z]{2})ies$", r"\1y"), (r"([a-z]{3})(?:ing|ed|es|s)$", r"\1"), (r"([bdgmnprt])\1$", r"\1")]:
            w = re.sub(pattern, replacement, w)
        return w

    tails = ["".join(t) for n in range(5) for t in itertools.product("ieszb", repeat=n)] + ["dd", "gging", "nned", "ttes", "rring", "mms", "pp", "lling", "sses", "éies", "3ies", "zzed", "llies", "bbies", "ings", "eds"]
    words = sorted({head + tail for head in ("", "q", "qx", "qxv", "qx7", "éz") for tail in tails} - {"", *text.STOP_WORDS})
    given = spark.createDataFrame([(w,) for w in words], "w string").withColumn("got", text.analyze(F.col("w")))
    assert {r.w: r.got for r in given.collect()} == {w: [stem(w)] for w in words}
    patterns = str(text.analyze(F.col("w"))._jc)
    assert patterns.lower().count("regexp_replace") == 2


def test_context_texts_are_not_shuffled(spark, sf_dir):
    """Few found chunks are broadcast to the documents, also where nothing is known of their number before they are written."""
    for name in ("D4_chunk_fields", "L7_build_context"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        try:
            plan = QUERIES[name](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    index = QUERIES["I6_lexical_score"](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "part#" not in index and "Join" not in index


def test_scores_are_summed_and_cut_in_their_bucket(spark, sf_dir, tmp_path, monkeypatch):
    """Only each bucket's best of a question are shuffled; an index whose files have gone is written again."""
    t = Tables(spark, sf_dir)
    plan = QUERIES["L2_lexical_search"](t)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Bucketed: true" in plan and "Exchange hashpartitioning(question_id#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(question_id#" in line and "chunk_id#" in line]
    rows = spark.range(50).select("id", (F.col("id") % 7).alias("g"))
    rows.write.parquet(f"{tmp_path}/given.parquet")
    given = Tables(spark, str(tmp_path)).given
    first = store.built_once(lambda: rows, "bucketed", given, "g", buckets=3)
    again = store.built_once(lambda: rows, "bucketed", given, "g", buckets=3)
    assert first.inputFiles() == again.inputFiles() and again.count() == 50
    assert "Exchange" not in again.groupBy("g").count()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(store, "_BUILT", {key: path + "-gone" for key, path in store._BUILT.items()})
    assert store.built_once(lambda: rows, "bucketed", given, "g", buckets=3).count() == 50
