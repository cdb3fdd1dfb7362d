import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import minhash, odd_sketch, queries

from test_similar import corpus, plain_groups, plain_set


def expected_rows(docs):
    """(doc_id, n_shingles, component_id, kept) over all pairs; documents without words are linked with nothing."""
    sets = {d: plain_set(t, 2) for d, t in docs.items()}
    roots = plain_groups({d: t for d, t in docs.items() if sets[d]}, 2)
    return sorted((d, len(s), roots.get(d, d), roots.get(d, d) == d) for d, s in sets.items())


@pytest.mark.parametrize("bucket", [3, 4096])
def test_query_against_all_pairs(docs, bucket):
    texts = [*corpus(11), "a b c d e", "a b c d", "B a", "b A", " ", "one"]
    rows = minhash.near_duplicates(docs(texts, "7L as vertex"), bucket=bucket)
    got = sorted(map(tuple, rows.collect()))
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got == expected_rows(dict(enumerate(texts)))
    assert 40 < sum(r[3] for r in got) < len(texts) - 30


def test_registered_query_on_a_given_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.queries()["op11_minhash_odd_sketches"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == expected_rows(docs)


def test_sql_against_all_pairs():
    texts = [*corpus(12), "a b c d e", "a b c d", "B a", "b A", " ", "one"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    assert sorted(con.sql(minhash.sql()).fetchall()) == expected_rows(dict(enumerate(texts)))


def test_empty_table_null_ids_and_repeated_rows(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    rows = minhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, ""), (7, None), (8, "")])).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, rows)) == [(-1, 0, -1, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 0, 7, True), (8, 0, 8, True)]


def drawn(rng, union, similarity, even=False):
    h = rng.integers(0, 2**64 - 1, union, dtype=np.uint64)
    shared = int(np.ceil(union * similarity - 1e-9))
    cut = shared + ((union - shared) // 2 if even else rng.integers(0, union - shared + 1))
    return np.sort(h[:cut]), np.sort(np.concatenate([h[:shared], h[cut:]]))


def differing(a, b):
    return int(np.bitwise_count(odd_sketch.odd_sketch(a) ^ odd_sketch.odd_sketch(b)).sum())


@pytest.mark.parametrize("union", [5, 10, 60, 300, 900, 4000, 20000])
def test_sketches_of_similar_sets_stay_below_the_limit(union):
    rng = np.random.default_rng(union)
    for _ in range(2000 if union < 1000 else 200):
        a, b = drawn(rng, union, 0.8)
        assert differing(a, b) <= odd_sketch.limit(np.array([len(a) + len(b)]), 0.8)[0]


def test_estimates_are_precise_where_sets_are_alike():
    rng = np.random.default_rng(4)
    for similarity in (0.7, 0.8, 0.9, 0.95):
        pairs = [drawn(rng, 1500, similarity, even=True) for _ in range(100)]
        bits, total = np.array([differing(a, b) for a, b in pairs]), np.array([len(a) + len(b) for a, b in pairs])
        found = odd_sketch.estimate(bits, total)
        assert abs(found.mean() - similarity) < 0.01 and np.abs(found - similarity).max() < 0.08
    same = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64))
    assert differing(same, same) == 0 and differing(same[:0], same[:0]) == 0


def test_answers_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    members = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.sort(rng.choice(members, rng.integers(40, 60), replace=False)) for _ in range(120)]
    units, sizes = np.sort(rng.integers(0, 3, 120)), np.array([len(s) for s in sets])
    order = np.lexsort([sizes, units])
    sets, sizes = [sets[k] for k in order], sizes[order]
    words = np.array([odd_sketch.odd_sketch(s) for s in sets])
    asks, replies = rng.random(120) < 0.4, rng.random(120) < 0.8
    got = {(int(a), int(b)) for i, j in odd_sketch.answers(units, words, sizes, asks, replies, 0.8) for a, b in zip(i, j, strict=True)}
    pairs = [(a, b) for a in range(120) for b in range(120) if a != b and asks[a] and replies[b] and units[a] == units[b]]
    fits = odd_sketch.close(words, sizes, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 0.8)
    assert got == {p for p, ok in zip(pairs, fits, strict=True) if ok}
    alike = {p for p in pairs if 5 * len(np.intersect1d(sets[p[0]], sets[p[1]])) >= 4 * len(np.union1d(sets[p[0]], sets[p[1]]))}
    assert alike and alike <= got
