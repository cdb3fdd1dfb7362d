"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes of a text cuts it where its content says so, so passages that documents share give the
same chunks whatever stands around them. A chunk is encoded once and its ids are looked up afterwards. What a cut
disturbs is the pre-token on either side of it, so every join is repaired: the text around it is encoded again, from some
words within the left chunk to some within the right one, until the new ids agree exactly with those of both chunks on these words;
while they do not, the stretch grows, at most to both chunks whole (and then the text is encoded whole). The words end where a space follows a visible ASCII character: no
pre-token holds such a pair inside, so ids that agree there are those of the whole text. A chunk without two such
places is part of the repaired stretch.

Texts are first dealt out by the least hash of their lines, so that copies and near copies, and the chunks they share,
meet in the same task; AQE splits a large group of copies (each task then encodes its chunks once). A text with the
special token's string or with a very long run of white space is encoded whole.

Null texts count as empty: no ids, and the digests of the empty string. Repeated rows stay separate. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import encode, encoder, is_plain, rank_path

CHUNK_BITS = 10
CACHE_BYTES = 32 << 20
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places after which a chunk ends: where the hash of the last 16 bytes has ``bits`` zero bits on top."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1


class ChunkEncoder:
    """Encodes texts by chunks; remembers up to about two times ``limit`` bytes of chunks."""

    def __init__(self, bpe: tiktoken.Encoding, bits: int = CHUNK_BITS, limit: int = CACHE_BYTES):
        self.bpe, self.bits, self.limit = bpe, bits, limit
        self.sizes = [len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)]
        self.new: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}
        self.held = self.encoded = self.reused = self.widened = 0

    def _core(self, chunk: bytes) -> list[int]:
        ids = self.new.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                ids = self.bpe.encode_ordinary(chunk.decode())
                self.encoded += 1
            else:
                self.reused += 1
            if self.held > self.limit:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[chunk] = ids
            self.held += 9 * len(chunk)
        else:
            self.reused += 1
        return ids

    def encode(self, text: str) -> list[int]:
        if not is_plain(text):
            return encode(self.bpe, text).tolist()
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        cuts = cut_points(data, self.bits) if len(data) > 1 else []
        if not len(cuts):
            return self.bpe.encode_ordinary(text)
        visible = (data > 0x20) & (data < 0x7F)
        words = np.flatnonzero(visible[:-1] & (data[1:] == 0x20)) + 1  # a pre-token starts here in any surroundings
        edges = np.concatenate([[0], cuts, [len(data)]])
        # The words of a chunk lie strictly inside it: both bytes of their borders belong to the chunk.
        first = np.searchsorted(words, edges[:-1], "right").tolist()
        last = (np.searchsorted(words, edges[1:], "left") - 1).tolist()
        words = words.tolist()
        ids: list[int] = []
        left = Stretch([0], [])
        for a, b in zip(first, last, strict=True):
            if a < b:
                right = Stretch(words[a : b + 1], self._core(raw[words[a] : words[b]]))
                between = self.joined(raw, left, right)
                if between is None:
                    return self.bpe.encode_ordinary(text)
                ids += between
                ids += right.ids
                left = right
        between = self.joined(raw, left, Stretch([len(raw)], []))
        return self.bpe.encode_ordinary(text) if between is None else ids + between

    def joined(self, raw: bytes, left: Stretch, right: Stretch) -> list[int] | None:
        """Ids between two stretches, from texts that reach ever further into both until their ids agree with both."""
        reach = 1
        while True:
            start, stop = left.words[max(-1 - reach, -len(left.words))], right.words[min(reach, len(right.words) - 1)]
            ids = self.bpe.encode_ordinary(raw[start:stop].decode())
            head, tail = self.covering(ids, left.words[-1] - start), self.covering(ids[::-1], stop - right.words[0])
            if head is not None and tail is not None and ids[:head] == left.ids[len(left.ids) - head :] and ids[len(ids) - tail :] == right.ids[:tail]:
                return ids[head : len(ids) - tail]
            if reach >= len(left.words) and reach >= len(right.words):
                return None
            self.widened += 1
            reach *= 2

    def covering(self, ids: list[int], size: int) -> int | None:
        """How many of the ids, from the first on, make up exactly ``size`` bytes."""
        n = 0
        while size > 0 and n < len(ids):
            size -= self.sizes[ids[n]]
            n += 1
        return n if size == 0 else None


@dataclass(frozen=True)
class Stretch:
    """A chunk from its first to its last word border: the borders' places in the text, and the ids between."""

    words: list[int]
    ids: list[int]


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the number of ids, and digests of the ids and of the decoded text."""
    path = path or rank_path()

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        chunks = ChunkEncoder(bpe)
        names = [str(i) for i in range(bpe.n_vocab)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = chunks.encode(text.as_py() or "")
                back = bpe.decode_bytes(ids).decode("utf-8", "replace")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    least = F.array_min(F.transform(F.split("text", "\n"), lambda line: F.xxhash64(line)))
    return rows.withColumn("_near", least).hint("rebalance", "_near").drop("_near").mapInArrow(digests, ENCODED)
