"""Vector code compression: product codes by a dual-tree Lloyd iteration on whole numbers.

Vectors become whole numbers and are cut into equal consecutive parts; every part position has a codebook of its own.

1. A task packs the rows of an Arrow batch into one row and lays a balanced tree over them for every part position: halves at the median of the
   widest component, down to ``LEAF`` parts. The packed rows are written once, in the order of their trees, and read by every round.
2. Each round lays a tree over the entries of a codebook (at most a few hundred, they travel with the tasks) and descends both trees together. A pair of
   nodes whose boxes are farther apart than the node of parts is, at most, from some other node of entries is pruned; ties are not.
   A node of parts that is left with one entry is assigned whole: its count and its cached sums are added. Leaves that are still uncertain
   compare whole-number distances to their remaining entries, ties to the lower index.
3. Tasks add up counts and sums by entry; Spark adds those of the tasks, and the driver gets one row per entry and component.

Rows whose vector is null or holds null, NaN or infinite components are dropped, and so are empty vectors and those of another length than that of the least vec_id. A length
that is no multiple of the number of parts is filled up with zeros. Rows are ordered by vec_id (nulls last), then by the vector, to take the first
entries; fewer rows than entries give a smaller codebook. Repeated rows and equal entries are kept; the lower of equal entries wins. Components that become
larger than ``LARGEST`` are refused: their squares would not fit. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 32
LARGEST = 1 << 26
PAIRS = 1 << 14
#: Whole numbers below it are exact as doubles, in which products of matrices are fast.
EXACT = 1 << 53


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Edges of the nodes of a balanced tree over ``n`` rows, level by level from the root: every node of more than ``leaf`` rows is halved."""
    edges = [np.array([0, n])]
    while len(edges[-1]) > 1 and np.diff(edges[-1]).max() > leaf:
        before = edges[-1]
        edges.append(np.append(np.stack([before[:-1], (before[:-1] + before[1:]) // 2], 1).reshape(-1), n))
    return edges


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every node of ``levels`` is a run: halves at the median of the widest component."""
    order = np.arange(len(points))
    for edges in levels(len(points), leaf)[:-1]:
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if end - start > 1:
                own = points[order[start:end]]
                widest = np.argmax(own.max(axis=0) - own.min(axis=0))
                order[start:end] = order[start:end][np.argpartition(own[:, widest], (end - start) // 2, kind="introselect")]
    return order


class Tree:
    """Boxes and sums of the nodes of every level; ``points`` are in tree order."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.edges = points, levels(len(points), leaf)
        self.low, self.high = [], []
        for edges in self.edges:
            self.low.append(np.minimum.reduceat(points, edges[:-1]))
            self.high.append(np.maximum.reduceat(points, edges[:-1]))

    def sums(self, level: int) -> np.ndarray:
        return np.add.reduceat(self.points, self.edges[level][:-1])


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    most = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * points.shape[1] < EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def bounds(tree: Tree, at: int, q: np.ndarray, other: Tree, to: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance that members of the nodes ``q`` and ``r`` may have, by their boxes."""
    least, most = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
    for k in range(0, len(q), PAIRS):
        low, high = tree.low[at][q[k : k + PAIRS]], tree.high[at][q[k : k + PAIRS]]
        e_low, e_high = other.low[to][r[k : k + PAIRS]], other.high[to][r[k : k + PAIRS]]
        gap = np.maximum(np.maximum(low - e_high, e_low - high), 0)
        far = np.maximum(high - e_low, e_high - low)
        least[k : k + PAIRS], most[k : k + PAIRS] = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
    return least, most


def assignments(tree: Tree, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, nodes, entry of each) of nodes assigned whole, and (-1, rows, entry of each) of leaves' rows."""
    kept = np.unique(entries, axis=0, return_index=True)[1]  # of equal entries, the lowest index always wins
    kept = kept[tree_order(entries[kept], 1)]
    other = Tree(entries[kept], 1)
    last, bottom = len(tree.edges) - 1, len(other.edges) - 1
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, by q
    at, to = 0, 0
    while True:
        nearest, farthest = bounds(tree, at, q, other, to, r)
        firsts = np.flatnonzero(np.diff(q, prepend=-1))
        n_of = np.diff(np.append(firsts, len(q)))
        stays = nearest <= np.repeat(np.minimum.reduceat(farthest, firsts), n_of)
        q, r = q[stays], r[stays]
        firsts = np.flatnonzero(np.diff(q, prepend=-1))
        n_of = np.diff(np.append(firsts, len(q)))
        alone = (n_of == 1) & (np.diff(other.edges[to])[r[firsts]] == 1)
        if alone.any():
            yield at, q[firsts[alone]], kept[other.edges[to][r[firsts[alone]]]]
            open_pairs = np.repeat(~alone, n_of)
            q, r = q[open_pairs], r[open_pairs]
        if not len(q):
            return
        if at == last and to == bottom:
            break
        if to < bottom:  # the entries' children; an entry alone stays as the second half of an empty first one
            q, r = np.repeat(q, 2), np.stack([2 * r, 2 * r + 1], 1).reshape(-1)
            to += 1
            full = other.edges[to][r + 1] > other.edges[to][r]
            q, r = q[full], r[full]
        if at < last:
            n_of = np.diff(np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q)))
            firsts = np.cumsum(n_of) - n_of
            twice = np.repeat(firsts, 2 * n_of) + (np.arange(2 * len(q)) - np.repeat(2 * firsts, 2 * n_of)) % np.repeat(n_of, 2 * n_of)
            half = (np.arange(2 * len(q)) - np.repeat(2 * firsts, 2 * n_of)) // np.repeat(n_of, 2 * n_of)
            q, r = 2 * q[twice] + half, r[twice]
            at += 1
            full = tree.edges[at][q + 1] > tree.edges[at][q]
            q, r = q[full], r[full]
    edges = tree.edges[at]
    for start, end in zip(f := np.flatnonzero(np.diff(q, prepend=-1)), [*f[1:], len(q)], strict=True):
        left = np.sort(kept[other.edges[to][r[start:end]]])
        rows = np.arange(edges[q[start]], edges[q[start] + 1])
        yield -1, rows, left[np.argmin(distances(tree.points[rows], entries[left]), axis=1)]


def added_up(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the parts of every entry."""
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for level, which, entry in assignments(tree, entries):
        np.add.at(counts, entry, 1 if level < 0 else np.diff(tree.edges[level])[which])
        np.add.at(sums, entry, tree.points[which] if level < 0 else tree.sums(level)[which])
    return counts, sums


def nearest(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The entry of every row, in tree order."""
    found = np.empty(len(tree.points), np.int64)
    for level, which, entry in assignments(tree, entries):
        if level < 0:
            found[which] = entry
        else:
            for node, k in zip(which.tolist(), entry.tolist(), strict=True):
                found[tree.edges[level][node] : tree.edges[level][node + 1]] = k
    return found


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.where((F.size(vector) > 0) & fine).select(F.col("vec_id").cast("long"), label.alias("label"), ints.alias("ints"))


def packed_trees(rows: DataFrame, dims: int, n_parts: int = PARTS, leaf: int = LEAF) -> DataFrame:
    """The rows (vec_id, label, ints) of every batch as one row: ids, labels, the trees' orders, and the parts in these orders."""
    padded = -(-dims // n_parts) * n_parts
    label = rows.schema["label"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ints = np.zeros((n, padded), np.int32)
            ints[:, :dims] = batch.column(2).flatten().to_numpy().reshape(n, dims)
            parts = np.split(ints, n_parts, axis=1)
            orders = [tree_order(p, leaf).astype(np.int32) for p in parts]
            whole = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(whole, batch.column(0)),
                    pa.ListArray.from_arrays(whole, batch.column(1)),
                    pa.array([np.concatenate(orders).tobytes()], pa.binary()),
                    pa.array([b"".join(p[o].tobytes() for p, o in zip(parts, orders, strict=True))], pa.binary()),
                ],
                ["vec_ids", "labels", "orders", "parts"],
            )

    return rows.mapInArrow(pack, f"vec_ids array<bigint>, labels array<{label}>, orders binary, parts binary")


def _trees(orders: bytes, parts: bytes, n_parts: int, leaf: int) -> tuple[np.ndarray, list[Tree]]:
    """The orders and trees of a packed row."""
    order = np.frombuffer(orders, np.int32).reshape(n_parts, -1)
    points = np.frombuffer(parts, np.int32).reshape(n_parts, order.shape[1], -1)
    return order, [Tree(p.astype(np.int64), leaf) for p in points]


def lloyd_round(packed: DataFrame, books: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The codebooks (part, entry, component) after one round: the means of the parts of every entry, rounded down; unused entries stay."""
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for orders, parts in zip(batch.column(0), batch.column(1), strict=True):
                for k, tree in enumerate(_trees(orders.as_py(), parts.as_py(), n_parts, leaf)[1]):
                    c, s = added_up(tree, books[k])
                    counts[k] += c
                    totals[k] += s
        used = np.flatnonzero(counts.reshape(-1))
        both = np.concatenate([counts.reshape(-1, 1), totals.reshape(-1, width)], axis=1)[used]
        cells = np.arange(width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(cells, len(used))), pa.array(both.reshape(-1))], ["entry", "cell", "total"])

    found = packed.select("orders", "parts").mapInArrow(sums, "entry long, cell long, total long").groupBy("entry", "cell").agg(F.sum("total").alias("total"))
    table = np.zeros((n_parts * n_entries, width + 1), np.int64)
    rows = found.toArrow()  # a row per entry and component, whatever the number of vectors
    table[rows["entry"].to_numpy(), rows["cell"].to_numpy()] = rows["total"].to_numpy()
    used = table[:, 0] > 0
    out = books.reshape(-1, width).copy()
    out[used] = table[used, 1:] // table[used, :1]
    return out.reshape(books.shape)


def assigned(packed: DataFrame, books: np.ndarray, leaf: int = LEAF) -> DataFrame:
    """(vec_id, label, code, error) of every packed vector."""
    n_parts = len(books)
    label = packed.schema["labels"].dataType.elementType.simpleString()
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                order, trees = _trees(batch.column(2)[at].as_py(), batch.column(3)[at].as_py(), n_parts, leaf)
                error, code = np.zeros(order.shape[1], np.int64), np.full(order.shape[1], "", digits.dtype)
                for own, tree, entries in zip(order, trees, books, strict=True):
                    entry = nearest(tree, entries)
                    of = np.empty_like(entry)
                    of[own] = entry
                    code = np.char.add(code, digits[of])
                    error[own] += ((tree.points - entries[entry]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at].values, batch.column(1)[at].values, pa.array(code.tolist()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(codes, f"vec_id bigint, label {label}, code string, error bigint")


def fit(packed: DataFrame, first: np.ndarray, n_parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds that start from the rows of ``first``."""
    padded = np.pad(first, [(0, 0), (0, -first.shape[1] % n_parts)])
    books = np.stack(np.split(padded, n_parts, axis=1))
    for _ in range(rounds):
        books = lloyd_round(packed, books)
    return books


def compress(rows: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row of ``rows`` (vec_id, embedding, label): its code, its squared error, the error of its label, and the digest of the codebooks."""
    vectors = whole_vectors(rows)
    empty = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    by_id = F.col("vec_id").asc_nulls_last(), F.col("ints")
    least = vectors.orderBy(*by_id).limit(1).collect()
    if not least:
        return rows.sparkSession.createDataFrame([], empty)
    dims = len(least[0].ints)
    vectors = vectors.where((F.size("ints") == dims) & in_range(F.col("ints")))
    first = vectors.orderBy(*by_id).limit(n_entries).collect()
    packed = materialize(packed_trees(vectors, dims, n_parts), "packed-vectors")
    books = fit(packed, np.array([r.ints for r in first], np.int64), n_parts, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = materialize(assigned(packed, books), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def in_range(ints: Column) -> Column:
    """True; an error if a component is too large for the squares to be whole numbers of 64 bits."""
    too_large = F.exists(ints, lambda x: F.abs(x) > LARGEST)
    return F.when(too_large, F.raise_error(F.lit(f"a component is larger than {LARGEST} after scaling")).cast("boolean")).otherwise(F.lit(True))


def sql(n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rows of ``compress`` over the table embeddings, whose vectors are of one length, for DuckDB: every part is held against every entry."""

    def assigned(k: int) -> str:
        return f"""a{k} as materialized (select p.vec_id, p.part, any_value(p.x) as x, min({{'d': p.xx - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c), 'e': b.e}}) as n from p join b{k} b using (part) group by p.vec_id, p.part)"""

    def moved(k: int) -> str:
        return f"""s{k} as (select part, n.e as e, pos, sum(x[pos]) as s, count(*) as cnt from (select *, unnest(range(1, len(x) + 1)) as pos from a{k}) group by all),
 b{k + 1} as materialized (select b.part, b.e, coalesce(m.c, b.c) as c from b{k} b left join (select part, e, list(floor(s / cnt) order by pos) as c from s{k} group by part, e) m using (part, e))"""

    steps = ",\n ".join(f"{assigned(k)},\n {moved(k)}" for k in range(rounds))
    return f"""with v as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x from embeddings
   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as materialized (select vec_id, label, part, y as x, list_inner_product(y, y) as xx
   from (select vec_id, label, part, list_slice(x, part * len(x) // {n_parts} + 1, (part + 1) * len(x) // {n_parts}) as y from (select *, unnest(range({n_parts})) as part from v))),
 b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p qualify row_number() over (partition by part order by vec_id) <= {n_entries}),
 {steps},
 {assigned(rounds)},
 digest as (select sha256(string_agg(c::bigint, ',' order by part, e, pos)) as h from (select part, e, unnest(c) as c, unnest(range(len(c))) as pos from b{rounds})),
 coded as (select vec_id, string_agg(printf('%02x', n.e), '' order by part) as code, sum(n.d)::bigint as error from a{rounds} group by vec_id)
 select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from coded join v using (vec_id) cross join digest"""
