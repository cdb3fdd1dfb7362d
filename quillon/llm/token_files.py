"""Token-id files with directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of 8 bits: level 0 has the low chunk of
every id; a bitmap beside it says which ids go on; level 1 has the next chunk of just those, and so on until no id goes
on. A rank directory counts the set bits before each 512-bit block of a bitmap, so any single token is reached by one
rank query per level, without decoding a block, and any run of tokens by two.

A segment is one row of a Parquet table, so the files live wherever Spark can write: (shard, segment, n_tokens,
doc_ids, doc_starts, levels, bitmaps, ranks).

Null or empty texts give only the end id. Repeated rows stay separate. Null ids sort first. An empty table gives no
segment and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import scratch_dir, shuffle_partitions
from quillon.llm.tokens import encode, encoder, rank_path

END_ID = 0
SEGMENT_TOKENS = 1 << 18
BLOCK = 512
SEGMENT = (
    "shard int, segment int, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)
ARROW_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_starts", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary())),
])
DOCS = "shard int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of ``ids``."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
        rest = rest[more]
        if not len(rest):
            return levels, bitmaps, ranks


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bits = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.bitmaps = bitmaps
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def rank(self, k: int, at: int) -> int:
        """Set bits of bitmap ``k`` before place ``at``: the directory's count, and the bits of one block."""
        block = at // BLOCK
        span = int.from_bytes(self.bitmaps[k][block * BLOCK // 8 : (at + 7) >> 3], "little")
        return int(self.ranks[k][block]) + (span & ((1 << (at - block * BLOCK)) - 1)).bit_count()

    def token(self, at: int) -> int:
        """The id at one place: a byte and a bit per level, the next level's place by rank."""
        value = int(self.levels[0][at])
        for k in range(1, len(self.levels)):
            if not self.bits[k - 1][at >> 3] >> (at & 7) & 1:
                break
            at = self.rank(k - 1, at)
            value |= int(self.levels[k][at]) << 8 * k
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at places ``a`` to ``b``; a level's part begins and ends at the ranks of the places above, nothing else is read."""
        out = self.levels[0][a:b].astype(np.uint32)
        at = np.arange(len(out))
        for k in range(1, len(self.levels)):
            if a == b:
                break
            more = np.unpackbits(self.bits[k - 1][a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + len(at)]
            at = at[more.astype(bool)]
            a, b = self.rank(k - 1, a), self.rank(k - 1, b)
            out[at] |= self.levels[k][a:b].astype(np.uint32) << np.uint32(8 * k)
        return out


def write_token_files(docs: DataFrame, out: str, path: str | None = None, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write segments in ascending order of doc_id below ``out``.

    One range shuffle of the texts by id and, for rows of one id, by text hash; each shard is a range of them.
    """
    path = path or rank_path()

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, shard = encoder(path), np.array([END_ID], np.uint32), TaskContext.get().partitionId()
        segment, n, doc_ids, starts, parts = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            row = [shard, segment, n, doc_ids, starts, *pack_codes(np.concatenate(parts))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW_SEGMENT, strict=True)], schema=ARROW_SEGMENT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(bpe, text.as_py() or "")
                doc_ids.append(doc_id)
                starts.append(n)
                parts += [ids, end]
                n += len(ids) + 1
                if n >= segment_tokens:
                    yield close()
                    segment, n, doc_ids, starts, parts = segment + 1, 0, [], [], []
        if doc_ids:
            yield close()

    n_shards = shuffle_partitions(docs.sparkSession)
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_hash"))
        .repartitionByRange(n_shards, "doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .drop("_hash")
        .mapInArrow(segments, SEGMENT)
        .write.parquet(out)
    )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Every document is addressed by its own places in the segment, through the rank directories.
    """

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["bitmaps"], row["ranks"])
                starts = [*row["doc_starts"], row["n_tokens"]]
                sizes = np.diff(starts)
                sums = [zlib.crc32(codes.tokens(a, b).astype("<u4", copy=False)) for a, b in zip(starts, starts[1:], strict=False)]
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_starts"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["shard", "segment", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(out)
    # Shard totals (one row per shard) are summed over all shards, then segments within their own shard.
    sizes = files.select("shard", "segment", "n_tokens")
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_segment_start"))
    starts = starts.join(shards, "shard").select("shard", "segment", (F.col("_shard_start") + F.col("_segment_start")).alias("_before"))
    return (
        files.mapInArrow(documents, DOCS)
        .join(starts, ["shard", "segment"])
        .select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    out = f"{scratch_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, out)
    return read_token_files(docs.sparkSession, out)
