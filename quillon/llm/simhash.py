"""SimHash near-duplicates, compared on vertical bit planes.

1. A 64-bit fingerprint per document; equal fingerprints are one vertex from here on, however many copies there are.
2. Fingerprints within ``radius`` bits agree in at least two of ``radius + 2`` bit blocks, so each pair of blocks is a
   table of exact candidates. A bucket with more than ``BUCKET`` fingerprints is dealt out in pairs of sub-buckets, which
   together still meet every pair.
3. A task sorts its fingerprints by bucket and stores them as 64 bit planes along the sorted rows. For a lag ``d`` the
   planes, XORed with themselves shifted by ``d``, feed carry-save counters that count 64 rows per machine word. A word is
   abandoned as soon as all its rows exceed the radius. Only a spanning set of each bucket's links leaves the task.
4. Connected components give the smallest reachable doc_id.

Null texts count as empty; documents without words have the zero fingerprint and link like any other. Repeated rows
stay; rows with one doc_id are one document. A null doc_id is never a component id unless the component has no other. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.components import components

WIDTH = 3
RADIUS = 3
SEED = 42
BUCKET = 4096
BROADCAST_ROWS = 10_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; fewer words make one shingle, none make no shingle."""
    words = text.encode().lower().split()  # both take ASCII only: A-Z, and 0x20 and 0x09 to 0x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    ends = ends[width - 1 :] or ends[-1:]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The fingerprint of a whole text: a bit is set if it is in over half of the shingles' XXH64."""
    return majority_bits(shingle_hashes(text, width))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are each set if they are in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests, "doc_id long, fp long")


def near_rows(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of equal key within ``radius`` bits, one pair of arrays per lag. ``keys`` must be sorted."""
    n = len(keys)
    if n < 2:
        return
    n_words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes = np.zeros((64, 8 * (n_words + 1)), np.uint8)
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    edges = np.flatnonzero(np.diff(keys)) + 1
    longest = int(np.diff(np.concatenate([[0], edges, [n]])).max())
    n_counters = radius.bit_length()
    none = np.uint64(0)
    for lag in range(1, longest):
        same = np.zeros(64 * n_words, bool)
        same[: n - lag] = keys[:-lag] == keys[lag:]
        mask = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(mask)
        if not len(at):
            continue
        step, turn = divmod(lag, 64)
        ahead = np.minimum(at + step, n_words)
        over = ~mask[at]
        counters = [np.zeros(len(at), np.uint64) for _ in range(n_counters)]
        for k, plane in enumerate(planes):
            other = plane[ahead] >> np.uint64(turn)
            if turn:
                other |= plane[np.minimum(ahead + 1, n_words)] << np.uint64(64 - turn)
            carry = plane[at] ^ other
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if k % 8 == 7:
                alive = ~over != none
                if not alive.all():
                    at, ahead, over = at[alive], ahead[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(at):
                        break
        if len(at):
            found = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(found)
            i = 64 * at[word] + bit
            j = i + lag
            close = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            yield i[close], j[close]


def spanning_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint pairs that connect exactly what the near pairs of each bucket connect: less than one per row."""
    root = np.arange(len(keys))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for i, j in near_rows(keys, fps, radius):
        while not np.array_equal(flat := root[root], root):
            root[:] = flat
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    while not np.array_equal(flat := root[root], root):
        root[:] = flat
    linked = np.flatnonzero(root != np.arange(len(keys)))
    return fps[linked], fps[root[linked]]


def block_tables(fp: Column, radius: int = RADIUS) -> Column:
    """The bucket keys of a fingerprint: its bits in each pair of ``radius + 2`` blocks, tagged with the pair."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = [int(np.uint64(masks[a] | masks[b]).astype(np.int64)) for a, b in combinations(range(n), 2)]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])


def near_links(vertices: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``vertices`` (fp) within ``radius`` bits."""
    rows = vertices.select("fp", F.explode(block_tables(F.col("fp"), radius)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > bucket)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part)
        pairs = F.transform(others, lambda o: F.xxhash64("key", F.least(o, part), F.greatest(o, part)))
        units = F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)
        rows = rows.select("fp", F.explode(units).alias("key"))

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def answer(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = spanning_links(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:  # the last bucket may go on in the next batch
                yield answer(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        yield answer(keys, fps)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(links, "u long, v long")


def _named(vertices: DataFrame, links: DataFrame, vertex: str) -> DataFrame:
    """(vertex, component_id): the smallest first_id of each vertex's component."""
    roots = components(links).select(F.col("node").alias(vertex), "root")
    of = vertices.join(roots, vertex, "left").select(vertex, "first_id", F.coalesce("root", vertex).alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return of.join(least, "root").select(vertex, "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprint in hex and the smallest doc_id reachable by links."""
    marks = materialize(fingerprints(docs), "fingerprints")
    vertices = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "vertices")
    named = _named(vertices, near_links(vertices, radius), "fp")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component in ``groups`` (doc_id, component_id), with all columns."""
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept"]), "left_semi")
