"""Best-fit packing with Martello-Toth dominance reduction.

Document pieces are packed into sequences of a fixed capacity. Only the histogram of piece lengths (one row per
length, so at most ``capacity`` rows) decides the plan; the pieces themselves never leave the executors.

1. Reduction: going down the lengths, a small set that holds an item and provably dominates every other set with that
   item is fixed for as many copies as there are (an item alone, an exact pair, the largest partner when only one more
   item fits, the two largest partners when at most two fit). Repeated until nothing changes.
2. What is left is packed best-fit decreasing, many equal bins at a time.
3. The plan is a bounded list of rank intervals per length; pieces get a rank within their length and join it.

Null or empty texts give one piece that holds only the end id. Repeated rows are packed separately. An empty table
gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_partitions
from quillon.llm.tokens import encode, encoder, rank_path

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_bucket long, rank_lo long, rank_hi long, base long, per_sequence long, first_offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, the first one shorter if ``n`` is no multiple."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids (end id included): place, length and checksum, no ids."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(bpe, text.as_py() or ""), end]).astype("<u4", copy=False)
                out += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def dominating_sets(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets and take them out of ``counts``; returns (copies, sizes)."""
    fixed: list[tuple[int, tuple[int, ...]]] = []
    sizes = sorted(counts)

    def take(n: int, chosen: tuple[int, ...]) -> None:
        fixed.append((n, chosen))
        for s in chosen:
            counts[s] -= n
            if not counts[s]:
                del counts[s]
                sizes.pop(bisect_left(sizes, s))

    def smallest(n: int, without: int) -> list[int]:
        """The ``n`` smallest items that remain when one item of size ``without`` is in use."""
        found: list[int] = []
        for s in sizes:
            found += [s] * min(n - len(found), counts[s] - (s == without))
            if len(found) == n:
                break
        return found

    def largest(limit: int, without: tuple[int, ...]) -> int:
        """The largest remaining item of at most ``limit``, or 0."""
        for s in reversed(sizes[: bisect_left(sizes, limit + 1)]):
            if counts[s] > without.count(s):
                return s
        return 0

    def copies(chosen: tuple[int, ...]) -> int:
        if len(chosen) < 3:
            return min(counts[s] // chosen.count(s) for s in chosen)
        # The test of a triple sees no difference between counts of four and more: as many copies as keep that.
        return max(1, min((counts[s] - 4) // chosen.count(s) + 1 for s in chosen))

    def dominating(s: int) -> tuple[int, ...]:
        room, low = capacity - s, smallest(3, s)
        partner = largest(room, (s,))
        if not partner:
            return (s,)
        if partner == room or sum(low[:2]) > room or len(low) == 1:
            return (s, partner)
        if len(low) == 2 or sum(low) > room:  # at most two more items fit
            second = largest(min(room // 2, partner), (s,))
            mate = largest(room - partner, (s, partner))
            if mate and mate >= second:
                return (s, partner, mate)
        return ()

    changed = True
    while changed:
        changed = False
        for s in reversed(list(sizes)):
            while s in counts and (chosen := dominating(s)):
                take(copies(chosen), chosen)
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram; equal bins are one entry (copies, sizes)."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, sizes: tuple[int, ...]) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((n, sizes))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in rooms[bisect_left(rooms, s) :]:
            if not left:
                break
            each, kept = room // s, []
            for n, sizes in open_bins[room]:
                full = min(n, left // each)
                put(room - each * s, full, sizes + (s,) * each)
                left, n = left - full * each, n - full
                if n and left:  # fewer than ``each`` are left
                    put(room - left * s, 1, sizes + (s,) * left)
                    left, n = 0, n - 1
                if n:
                    kept.append((n, sizes))
            open_bins[room] = kept
            if not kept:
                del open_bins[room]
                rooms.pop(bisect_left(rooms, room))
        each = capacity // s
        put(capacity - each * s, left // each, (s,) * each)
        put(capacity - left % each * s, bool(left % each), (s,) * (left % each))
    return [x for bins in open_bins.values() for x in bins]


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Rank intervals: the pieces of ``length`` with ranks in [lo, hi) go to sequences from ``base`` on."""
    counts = {s: n for s, n in histogram.items() if n}
    n_sizes = len(counts)
    bins = dominating_sets(counts, capacity)
    # A set empties a size or brings one below four, or takes one of the last three of a size.
    assert len(bins) <= 5 * n_sizes
    bins += best_fit(counts, capacity)
    # A size splits one entry into three at most and opens two.
    assert len(bins) <= 9 * n_sizes
    plan, base, used = [], 0, dict.fromkeys(histogram, 0)
    for n, sizes in bins:
        offset = 0
        for s in dict.fromkeys(sizes):
            each = sizes.count(s)
            plan.append((s, used[s], used[s] + n * each, base, each, offset))
            used[s] += n * each
            offset += s * each
        base += n
    return plan


def by_rank_bucket(plan: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """The plan with each interval repeated per bucket of ranks that it touches, and (length, width) of the buckets.

    A length has as many buckets as intervals, so that the plan at most doubles and a piece meets two intervals on average.
    """
    n, end = Counter(row[0] for row in plan), Counter()
    for s, _, hi, *_ in plan:
        end[s] = max(end[s], hi)
    width = {s: -(-end[s] // n[s]) for s in n}
    rows = [(s, k, lo, hi, *rest) for s, lo, hi, *rest in plan for k in range(lo // width[s], (hi - 1) // width[s] + 1)]
    return rows, list(width.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Pieces of one length are ranked in hashed buckets whose starts come from their counts, so that a length that holds
    most pieces is spread over tasks. The plan has at most nine kinds of sequence per length, whatever the input, and is broadcast.
    """
    spark = pieces.sparkSession
    n_buckets = max(64, shuffle_partitions(spark))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    sizes = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, widths = by_rank_bucket(packing_plan(histogram, capacity))
    plan = spark.createDataFrame(rows, PLAN)
    starts = starts.join(F.broadcast(spark.createDataFrame(widths, "length long, _width long")), "length")
    place = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rn", F.row_number().over(place)).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_rn") - 1)
    ranked = ranked.withColumn("rank_bucket", F.floor(F.col("_rank") / F.col("_width")))
    rel = F.col("_rank") - F.col("rank_lo")
    return (
        ranked.join(F.broadcast(plan), ["length", "rank_bucket"])
        .where("_rank >= rank_lo and _rank < rank_hi")
        .withColumn("sequence_id", F.col("base") + F.floor(rel / F.col("per_sequence")))
        .withColumn("offset", F.col("first_offset") + rel % F.col("per_sequence") * F.col("length"))
        .drop("_bucket", "_rn", "_start", "_rank", "_width", "rank_bucket", "rank_lo", "rank_hi", "base", "per_sequence", "first_offset")
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text); one row per piece."""
    pieces = materialize(token_pieces(docs, path or rank_path(), capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
