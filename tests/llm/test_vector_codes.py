import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from quillon.llm import queries, vector_codes

ROW = "vec_id long, embedding array<float>, label int, error string"


def plain_codes(rows, n_parts=4, n_entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) by whole-number Lloyd over every part and entry."""
    kept = [(v, [math.floor(1024 * x) for x in e], l) for v, e, l in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    width = -(-dims // n_parts)
    whole = np.array([e + [0] * (n_parts * width - dims) for _, e, _ in kept], np.int64).reshape(len(kept), n_parts, width)
    books = whole[:n_entries].transpose(1, 0, 2).copy()

    def nearest(k):
        far = ((whole[:, k, None, :] - books[k][None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for k in range(n_parts):
            entry = nearest(k)[0]
            for e in range(books.shape[1]):
                if (entry == e).any():
                    books[k, e] = whole[entry == e, k].sum(axis=0) // (entry == e).sum()
    found = [nearest(k) for k in range(n_parts)]
    errors, of_label = sum(f[1] for f in found).tolist(), defaultdict(int)
    for (_, _, label), error in zip(kept, errors, strict=True):
        of_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    code = ["".join(f"{f[0][i]:02x}" for f in found) for i in range(len(kept))]
    return [(v, code[i], errors[i], of_label[label], digest) for i, (v, _, label) in enumerate(kept)]


def check(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROW).repartition(3)
    got = vector_codes.compress(frame, **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = sorted(map(tuple, got.collect()), key=key)
    assert found == sorted(plain_codes(rows, **how), key=key)
    return found


def test_registered_query_on_a_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.queries()["op12_dual_tree_codes"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows))


def test_sql_on_a_given_table(sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    rows = con.sql("select vec_id, embedding, label from embeddings").fetchall()
    assert sorted(con.sql(vector_codes.sql()).fetchall()) == sorted(plain_codes(rows))


def test_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 8))
    rows = [(i, (centres[rng.integers(40)] + rng.normal(0, 0.02, 8)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(3000)]
    rows += [(4000 + i, rows[7][1], None) for i in range(1500)]  # one vector, many times
    rows += [(6000 + i, rng.integers(-2, 3, 8).astype(float).tolist(), 9) for i in range(1000)]  # a lattice: ties
    check(spark, rows)
    check(spark, rows[4000:], n_parts=2, n_entries=16, rounds=2)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).astype(np.float32).tolist(), None) for i in range(50)]
    rows += [(50, None, 1), (51, [], 1), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (53, [math.nan] * 6, 1), (54, [math.inf] * 6, 1), (55, [1.0] * 5, 1), (None, [0.5] * 6, 1), (3, rows[3][1], 2), (3, rows[3][1], 2)]
    found = check(spark, rows)
    assert len(found) == 53
    check(spark, rows, n_entries=4)
    check(spark, rows[:1])


def test_empty_table_and_too_large_components(spark):
    assert check(spark, []) == []
    frame = spark.createDataFrame([(1, [1e9] * 4, 1, "x"), (0, [1.0] * 4, 1, "x")], ROW)
    with pytest.raises(Exception, match="larger than"):
        vector_codes.compress(frame).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 31, 33, 64, 257])
def test_trees_hold_every_row_once(n):
    rng = np.random.default_rng(n)
    points = rng.integers(-50, 50, (n, 3))
    order = vector_codes.tree_order(points, 4)
    assert sorted(order.tolist()) == list(range(n))
    tree = vector_codes.Tree(points[order], 4)
    for level, edges in enumerate(tree.edges):
        assert edges[0] == 0 and edges[-1] == n and (np.diff(edges) >= 0).all()
        full = np.diff(edges) > 0
        assert tree.sums(level)[full].sum(axis=0).tolist() == points.sum(axis=0).tolist()
    entries = rng.integers(-60, 60, (20, 3))
    entries[5] = entries[2]
    expected = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert vector_codes.nearest(tree, entries).tolist() == expected.tolist()


def test_far_clusters_are_assigned_whole():
    rng = np.random.default_rng(0)
    centres = np.stack([rng.permutation(16) for _ in range(4)], axis=1) * 1000
    points = np.repeat(centres, 64, axis=0) + rng.integers(0, 5, (1024, 4))
    tree = vector_codes.Tree(points[vector_codes.tree_order(points, 32)], 32)
    entries = np.unique(centres, axis=0)
    whole = sum(np.diff(tree.edges[level])[which].sum() for level, which, _ in vector_codes.assignments(tree, entries) if level >= 0)
    assert whole > 900
