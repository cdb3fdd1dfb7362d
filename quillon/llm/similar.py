"""Near-duplicates by a similarity of shingle sets, for texts whose fingerprints are too far apart to be their own index.

Two texts are linked if the Jaccard similarity of their sets of shingles (``similar_groups``: of five words, by SimHash) is 0.8 or more.
At 0.8 two fingerprints of 64 bits differ in 10 bits on average, too many for exact bit blocks. So:

1. Texts with equal shingle sets are one vertex (64-bit digest of the set). Its fingerprint is the majority of the set's hashes.
2. Buckets: a vertex stands in ``BANDS`` of them, each named by the least values of ``ROWS`` seeded hashes over its set. A
   pair of similarity s shares one with probability 1 - (1 - s^5)^24: 0.99993 at 0.8, 0.9999997 at 0.85.
3. Within a bucket some vertices ask and all answer. Fingerprints are bit planes along the sorted rows; every question runs
   over words of 64 rows with carry-save counters and leaves a word once all its rows are beyond ``RADIUS`` bits, which a
   pair of similarity 0.8 exceeds with a probability below 0.00001.
4. What is within the radius is held against the odd sketches (``odd_sketch``), which most pairs of texts that share a template, but are below the
   similarity, exceed; what is left is linked only if the sets (32 bits a shingle) have the similarity.
5. First, the vertex with the most company in its buckets asks in each bucket. Then, in each bucket that still holds several
   components, all vertices outside the largest one ask. So a large group of near copies costs about a link a member, and
      still every pair of different components that share a bucket is compared. In this second round the sets travel with the rows and only links
   that connect something new leave a task. Copies are never expanded into pairs.

A bucket larger than ``BUCKET`` is dealt out: in the first round the one who asks goes to every part, in the second those who ask and those who
answer are dealt into parts by the size of their sets, and every two parts meet. Pairs are as the square only of
bucket members that are similar enough to meet and yet stay unlinked to the bucket's largest component, and cost some machine words each.

Null texts count as empty; all texts without words are one group; texts of fewer than five words are linked if their words are
equal. Rows with one doc_id and different texts are different vertices, and the doc_id stays if it is the smallest of any of their groups. A null
doc_id stays only if its component has no other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.components import components
from quillon.llm.odd_sketch import BITS, close, odd_sketch
from quillon.llm.simhash import BUCKET, _named, majority_bits, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
RADIUS = 26
SEEDS = 5
SHINGLES = 1000
PART = 1 << 13

#: Rows (i, j) of equal unit that may be similar, of arrays sorted by unit and size: unit, fp, sketch (None: not to be looked at), size, asks, answers, similarity.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray, float], Iterator[tuple[np.ndarray, np.ndarray]]]


def seeded(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` hash functions over 64-bit values."""
    draw = np.random.default_rng(SEEDS)
    return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def band_keys(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray, rows: int = ROWS) -> list[int]:
    """The bucket names of a set of shingle hashes, none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * factors + offsets
        part ^= part >> np.uint64(31)
        least = np.minimum(least, part.min(axis=0))
    return [xxhash.xxh64_intdigest(r.tobytes(), seed=k) - (1 << 63) for k, r in enumerate(least.reshape(-1, rows))]


def marks_of(docs: DataFrame, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """(doc_id, vertex, fp, sketch, n, shingles, keys) per row of ``docs``; n is the size of the set."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = seeded(bands * ROWS)
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or "", width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in sets], pa.int64()),
                    pa.array(np.array([majority_bits(h) for h in sets], np.uint64).view(np.int64)),
                    pa.array([odd_sketch(h).tobytes() for h in sets], pa.binary()),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([np.unique(h.astype(np.uint32)).view(np.int32) for h in sets], pa.list_(pa.int32())),
                    pa.array([band_keys(h, factors, offsets) for h in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "vertex", "fp", "sketch", "n", "shingles", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(marks, "doc_id long, vertex long, fp long, sketch binary, n long, shingles array<int>, keys array<long>")


def near_answers(units: np.ndarray, fps: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of equal unit, i asking and j answering, within ``radius`` bits. ``units`` must be sorted."""
    n = len(units)
    asking = np.flatnonzero(asks)
    if not len(asking):
        return
    n_words = -(-n // 64)

    def words(bits: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(bits), 8 * n_words), np.uint8)
        part = np.packbits(bits, axis=1, bitorder="little")
        packed[:, : part.shape[1]] = part
        return packed.view(np.uint64)

    planes = words(np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T)
    open_rows = words(answers[None, :])[0]
    low = np.searchsorted(units, units[asking], "left")
    high = np.searchsorted(units, units[asking], "right") - 1
    n_of = high // 64 - low // 64 + 1
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n_of) // PART)) + 1).tolist(), len(asking)]
    full, none, one = np.uint64(2**64 - 1), np.uint64(0), np.uint64(1)
    for start, end in zip(cuts, cuts[1:], strict=False):
        count = n_of[start:end]
        which = np.repeat(np.arange(start, end), count)
        word = low[which] // 64 + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        mask = open_rows[word]
        mask &= np.where(word == low[which] // 64, full << (low[which] % 64).astype(np.uint64), full)
        mask &= np.where(word == high[which] // 64, full >> (63 - high[which] % 64).astype(np.uint64), full)
        asked = fps[asking[which]]
        over = ~mask
        counters = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]
        for k, plane in enumerate(planes):
            carry = plane[word] ^ (none - (asked >> np.uint64(k) & one))
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if k % 8 == 7:
                alive = ~over != none
                if not alive.all():
                    which, word, asked, over = which[alive], word[alive], asked[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(word):
                        break
        if len(word):
            found, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = asking[which[found]], 64 * word[found] + bit
            close = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            yield i[close], j[close]


def on_planes(units: np.ndarray, fps: np.ndarray, sketches: np.ndarray | None, sizes: np.ndarray, asks: np.ndarray, answers: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The comparison of SimHash: fingerprints on bit planes, then odd sketches."""
    for i, j in near_answers(units, fps, asks, answers):
        fits = slice(None) if sketches is None else close(sketches, sizes, i, j, similarity)
        yield i[fits], j[fits]


def whole_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by their first column, in tables that hold all rows of each of their units."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))
        if held and (cut or held[-1].column(0)[-1].as_py() != unit[0]):  # what is held ends here, or within this batch
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sketch_words(column: pa.ChunkedArray) -> np.ndarray:
    """The sketches of a column, one row of machine words each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def near_pairs(rows: DataFrame, near: Near = on_planes, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs (u, v) of vertices with different labels that meet in ``rows`` (key, vertex, fp, n, label, asks, size)."""
    parts = F.ceil(F.col("size") / bucket).cast("int")
    own = F.pmod(F.xxhash64("vertex"), parts).cast("int")
    to = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))).alias("part")
    rows = rows.select("*", own.alias("own"), to)
    unit = F.when(F.col("size") > bucket, F.xxhash64("key", "part")).otherwise(F.col("key"))
    rows = rows.select(unit.alias("unit"), "vertex", "fp", "n", "label", "asks", (F.col("own") == F.col("part")).alias("answers"))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit, vertex, fp, n, label, asks, answers = (c.to_numpy() for c in table.columns)
            for i, j in near(unit, fp.view(np.uint64), None, n, asks, answers, similarity):
                i, j = i[other := label[i] != label[j]], j[other]
                ends = [pa.array(np.maximum(vertex[i], vertex[j])), pa.array(np.minimum(vertex[i], vertex[j]))]
                yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return rows.repartition("unit").sortWithinPartitions("unit", "n").mapInArrow(pairs, "u long, v long").distinct()


def linked_within(codes: np.ndarray, starts: np.ndarray, labels: np.ndarray, marked: np.ndarray, i: np.ndarray, j: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate rows (i, j), ``i`` ascending, enough similar ones to connect all labels that the similar ones connect.

    Row k's set is ``codes[starts[k]:starts[k + 1]]``; the codes are small whole numbers, and ``marked`` has a false place for each. ``labels`` become
    those of the connected rows.
    """
    sizes = np.diff(starts)
    us, vs = [], []
    firsts = np.flatnonzero(np.diff(i, prepend=-1))
    for at, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(i)], strict=True):
        row, to = i[at], j[at:end]
        to = to[labels[to] != labels[row]]
        if not len(to):
            continue
        own = codes[starts[row] : starts[row + 1]]
        marked[own] = True
        ends = np.cumsum(sizes[to])  # sets are not empty: empty ones have no bucket
        begins = ends - sizes[to]
        members = np.repeat(starts[to] - begins, sizes[to]) + np.arange(ends[-1])
        shared = np.add.reduceat(marked[codes[members]], begins, dtype=np.int64)
        marked[own] = False
        to = to[shared * (least.numerator + least.denominator) >= (sizes[row] + sizes[to]) * least.numerator]
        for label, k in zip(*np.unique(labels[to], return_index=True), strict=True):
            us.append(row)
            vs.append(to[k])
            labels[labels == label] = labels[row]
    return np.array(us, np.int64), np.array(vs, np.int64)


def spanning_links(rows: DataFrame, sets: DataFrame, near: Near = on_planes, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all labels that similar rows of a bucket connect, of ``rows`` (key, vertex, fp, label, asks, size, n_asks).

    The sketches and sets travel with the rows and are compared in the task, so what leaves it is less than a row per row, whatever the pairs. ``size`` and
    ``n_asks`` are weights of a bucket's rows and of those that ask; both kinds are dealt out in parts, and every two parts meet.
    """
    least = Fraction(str(similarity))
    na, nb = (F.ceil(F.col(c) / bucket).cast("int") for c in ("n_asks", "size"))
    own_a, own_b = (F.pmod(F.xxhash64("vertex", F.lit(k)), n).cast("int") for k, n in enumerate((na, nb)))
    ask = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.struct(own_a.alias("a"), b.alias("b"), F.lit(True).alias("asks")))
    answer = F.transform(F.sequence(F.lit(0), na - 1), lambda a: F.struct(a.alias("a"), own_b.alias("b"), F.lit(False).alias("asks")))
    places = F.when(F.col("asks"), F.concat(ask, answer)).otherwise(answer)
    dealt = rows.select("key", "vertex", "fp", "label", F.explode(places).alias("p"))
    dealt = dealt.select(F.xxhash64("key", "p.a", "p.b").alias("unit"), "vertex", "fp", "label", "p.asks")
    dealt = dealt.join(sets, "vertex").select("unit", "vertex", "fp", "n", "label", "asks", "sketch", "shingles")

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit, vertex, fp, n, label, asks = (c.to_numpy() for c in table.columns[:6])
            lists = table.column(7).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            marked = np.zeros(int(codes.max(initial=0)) + 1, bool)
            of = np.searchsorted(unit, unit)  # a label of one unit is none of another
            names = np.unique(np.stack([of, label]), axis=1, return_inverse=True)[1].reshape(-1)
            for i, j in near(unit, fp.view(np.uint64), sketch_words(table.column(6)), n, asks, ~asks, similarity):
                u, v = linked_within(codes, starts, names, marked, i, j, least)
                if len(u):
                    ends = [pa.array(np.maximum(vertex[u], vertex[v])), pa.array(np.minimum(vertex[u], vertex[v]))]
                    yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return dealt.repartition("unit").sortWithinPartitions("unit", "n").mapInArrow(links, "u long, v long").distinct()


def close_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sketches and sizes in ``sets`` (vertex, n, sketch) allow the similarity."""

    def allowed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.concatenate([batch.column(k).to_numpy() for k in (2, 4)])
            sketches = np.concatenate([sketch_words(batch.column(k)) for k in (3, 5)])
            fits = close(sketches, sizes, np.arange(n), np.arange(n) + n, similarity)
            yield batch.select(["u", "v"]).filter(pa.array(fits))

    of = [sets.select(F.col("vertex").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "uv"]
    both = pairs.join(of[1], "v").join(of[0], "u").select("u", "v", "u_n", "u_sketch", "v_n", "v_sketch")
    return both.mapInArrow(allowed, "u long, v long")


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (u, v) whose ``sets`` (vertex, shingles) have a Jaccard similarity of at least ``similarity``."""
    least = Fraction(str(similarity))
    of_v = sets.select(F.col("vertex").alias("v"), F.col("shingles").alias("v_set"))
    of_u = sets.select(F.col("vertex").alias("u"), F.col("shingles").alias("u_set"))
    shared = F.size(F.array_intersect("u_set", "v_set"))
    sizes = F.size("u_set") + F.size("v_set")
    counted = pairs.join(of_v, "v").join(of_u, "u").select("u", "v", shared.alias("shared"), sizes.alias("sizes"))
    both = least.numerator + least.denominator
    return counted.where(F.col("shared").cast("long") * both >= F.col("sizes").cast("long") * least.numerator).select("u", "v")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the smallest doc_id reachable by links of ``similarity`` or more.

    The buckets are meant for a similarity of 0.8 or more; the smaller, the more links they miss.
    """
    marks = materialize(marks_of(docs, width), "similar-marks")
    return named_groups(marks, on_planes, similarity, bucket).select("doc_id", "component_id")


def named_groups(marks: DataFrame, near: Near, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n, component_id) per row of ``marks``, which must be a written table (see ``marks_of``)."""
    first = [F.first(c).alias(c) for c in ("fp", "n", "keys")]
    vertices = marks.groupBy("vertex").agg(F.min("doc_id").alias("first_id"), *first)
    vertices = materialize(vertices, "similar-vertices")
    rows = vertices.select("vertex", "fp", "n", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialize(rows.join(met, "key"), "similar-buckets")
    sets = marks.select("vertex", "n", "sketch", "shingles").join(rows.select("vertex"), "vertex", "left_semi")
    sets = sets.groupBy("vertex").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "shingles")])
    sets = materialize(sets, "similar-sets")

    company = rows.groupBy("vertex").agg(F.sum("size").alias("company"))
    lead = rows.join(company, "vertex").groupBy("key").agg(F.max(F.struct("company", "vertex")).alias("lead"))
    asked = rows.join(lead, "key").select("key", "vertex", "fp", "n", "size", F.col("vertex").alias("label"), (F.col("vertex") == F.col("lead.vertex")).alias("asks"))
    pairs = materialize(close_pairs(near_pairs(asked, near, similarity, bucket), sets, similarity), "similar-pairs")
    links = materialize(similar_links(pairs, sets, similarity), "similar-links")

    roots = components(links).select(F.col("node").alias("vertex"), "root")
    weight = (1 + F.col("n") / SHINGLES).alias("weight")
    rows = materialize(rows.join(roots, "vertex", "left").select("key", "vertex", "fp", weight, F.coalesce("root", "vertex").alias("label")), "similar-labels")
    held = rows.groupBy("key", "label").agg(F.sum("weight").alias("weight"))
    held = held.groupBy("key").agg(F.count("*").alias("labels"), F.sum("weight").alias("size"), F.max(F.struct("weight", "label")).alias("top")).where("labels > 1")
    rest = rows.join(held, "key").select("key", "vertex", "fp", "size", "label", (F.col("label") != F.col("top.label")).alias("asks"), (F.col("size") - F.col("top.weight")).alias("n_asks"))
    more = materialize(spanning_links(rest, sets, near, similarity, bucket), "similar-links")
    named = _named(vertices.select("vertex", "first_id"), links.union(more), "vertex")
    return marks.select("doc_id", "n", "vertex").join(named, "vertex").select("doc_id", "n", "component_id")
