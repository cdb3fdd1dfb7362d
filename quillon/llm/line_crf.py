"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets a few shape features (letters, capitals, digits, symbols, word lengths, repeated words, ...) and
those of the lines before and after it. The chain labels lines good or bad; forward-backward marginals, weighted by
line length, give the document's quality between 0 and 1.

Labels are known of documents only, so the labels of lines are latent: a document's label is taken as a reading of each of its lines'
labels that errs with probability ``NOISE``. Training climbs the likelihood of these readings; its gradient is the difference of
two forward-backward passes, one with the readings and one without. A good document may thus have bad lines and the other way round, and
the chain learns how likely a change is.

The model is fitted on the driver from at most ``max_train`` labelled documents (those with the least hash of doc_id) and at
most ``MAX_LINES`` lines of each, one run of lines from a place that the text's checksum names; of rows with one doc_id, the one with the least text hash.
Rows whose crc32(doc_id as text) mod 4 is 2 are held out. Only features of the text are inputs.

Null and empty texts are one empty line. Repeated rows each get a score. Without labels, or with one label only, every
score is the share of label 1 (0.5 without any). An empty table gives no rows. Extra columns are ignored (and kept by ``keep``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hashed_sample

MAX_TRAIN = 3000
MAX_LINES = 500
NOISE = 0.1
STEPS = 120
THRESHOLD = 0.7
N_FEATURES = 15

_code = np.arange(256)
SPACE = np.isin(_code, [0x20, 0x09, 0x0B, 0x0C, 0x0D, 0x0A])
CAPITAL = (_code >= 0x41) & (_code <= 0x5A)
SMALL = (_code >= 0x61) & (_code <= 0x7A) | (_code >= 0xC2)
DIGIT = (_code >= 0x30) & (_code <= 0x39)
STOP = np.isin(_code, list(b".!?;:,"))
LOUD = _code == ord("!")
SYMBOL = (_code > 0x20) & (_code < 0x7F) & ~CAPITAL & ~SMALL & ~DIGIT & ~STOP & ~np.isin(_code, list(b"'\"-()"))
CLASSES = np.stack([SPACE, CAPITAL, SMALL, DIGIT, STOP, LOUD, SYMBOL], axis=1).astype(np.float32)
MIX = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    raws = [t.encode() for t in texts]
    n_lines = np.array([r.count(b"\n") + 1 for r in raws])
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)

    def per_line(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, np.concatenate([starts, [len(data)]]))).astype(np.float64)

    def count(kind: np.ndarray) -> np.ndarray:
        return per_line(np.flatnonzero(kind[data]))

    capitals = count(CAPITAL)
    latin = np.flatnonzero(data == 0xC3)
    capitals += per_line(latin[(data[latin + 1] >= 0x80) & (data[latin + 1] <= 0x9E)])
    small, digits, stops, loud, symbols = (count(k) for k in (SMALL, DIGIT, STOP, LOUD, SYMBOL))

    space = SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    n_words = per_line(first)
    words = np.maximum(n_words, 1)
    repeats = lone = tail = np.zeros(len(starts))
    if len(first):
        last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
        at = np.arange(len(data), dtype=np.uint64)
        begin = np.zeros(len(data), np.uint64)
        begin[first] = first
        inside = at - np.maximum.accumulate(begin)
        mixed = np.where(space, np.uint64(0), MIX[data] * (np.uint64(2) * inside + np.uint64(1)))  # place and byte
        names = np.add.reduceat(mixed, first)
        same = np.flatnonzero(names[1:] == names[:-1]) + 1
        repeats = per_line(first[same])
        lone = per_line(first[(first == last) & SYMBOL[data[first]]])
        tail = per_line(first[SYMBOL[data[last]] & (first != last)])
    full = np.maximum(size, 1)
    x = np.stack([
        np.log1p(size) / 5, np.log1p(n_words) / 4, capitals / full, small / full, digits / full, stops / full, loud / words,
        symbols / full, repeats / words, lone / words, tail / words, np.minimum(size / words / 10, 3),
        capitals / np.maximum(capitals + small, 1), (n_words == 0).astype(float), np.minimum(words / 50, 3),
    ], axis=1)
    return x.astype(np.float32), size + 1, n_lines


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, and a one; zeros beyond the ends of a document."""
    ends = np.cumsum(n_lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - n_lines] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1)


def groups(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about ``limit`` characters (a longer text is a run of its own), which bounds the arrays of a step."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


@dataclass(frozen=True)
class Model:
    """``emit``: weights of label good against bad; ``move``: log potentials of label pairs (0 bad, 1 good)."""

    mean: np.ndarray
    scale: np.ndarray
    emit: np.ndarray
    move: np.ndarray
    constant: float | None = None

    def inputs(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, n_lines).astype(np.float64)


def forward_backward(score: np.ndarray, n_lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label good per line, and expected label pairs summed over all lines.

    ``score`` is each line's log potential of good against bad. Documents go side by side, the longest first, so that
    step ``t`` works on all that have more than ``t`` lines.
    """
    order = np.argsort(-n_lines, kind="stable")
    starts = (np.cumsum(n_lines) - n_lines)[order]
    lengths = n_lines[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    own = np.stack([np.zeros_like(score), score], axis=1)
    alpha[starts] = own[starts]
    for t in range(1, lengths[0]):
        at = starts[: alive[t]] + t
        prev = alpha[at - 1]
        alpha[at] = own[at] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
    for t in range(lengths[0] - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = own[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(score), bool)
    inner[np.cumsum(n_lines) - n_lines] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + move + (own[at] + beta[at])[:, None, :]
    pair -= np.logaddexp(both[at, 0], both[at, 1])[:, None, None]
    return good, np.exp(pair).sum(axis=0)


def fit(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = 1e-3, noise: float = NOISE) -> Model:
    """Maximum likelihood of the documents' labels as noisy readings of latent line labels, by Adam."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), share)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = Model(mean, scale, np.zeros(0), np.zeros((2, 2))).inputs(x, n_lines)
    reading = math.log((1 - noise) / noise) * np.repeat(2.0 * labels - 1, n_lines)
    w = np.zeros(3 * N_FEATURES + 5)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        emit, move = w[:-4], w[-4:].reshape(2, 2)
        score = z @ emit
        good, pairs = forward_backward(score, n_lines, move)
        read, seen = forward_backward(score + reading, n_lines, move)
        g = np.concatenate([z.T @ (read - good), (seen - pairs).ravel()]) / len(z) - ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w[:-4], w[-4:].reshape(2, 2))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Length-weighted marginals of label good."""
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant or 0.0)
    found = []
    for run in groups(texts):
        x, size, n_lines = line_features(run)
        good, _ = forward_backward(model.inputs(x, n_lines) @ model.emit, n_lines, model.move)
        at = np.cumsum(n_lines) - n_lines
        found.append(np.add.reduceat(good * size, at) / np.add.reduceat(size, at))
    return np.clip(np.concatenate(found), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled documents that are not held out, ``max_train`` at most."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = hashed_sample(rows, "doc_id", max_train)
    chosen = chosen.select(F.col("doc_id").alias("_labelled"), (F.col("quality") == 1).cast("int").alias("_y"))
    texts = docs.select("text", F.col("doc_id").alias("_of")).join(F.broadcast(chosen), F.col("_of") == F.col("_labelled"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = texts.groupBy(F.col("_of").cast("long").alias("doc_id")).agg(F.min_by(text, F.xxhash64(text)).alias("text"), F.max("_y").alias("_y"))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for run in groups([t.as_py() for t in batch.column(1)]):
                x, _, n_lines = line_features(run)
                ends = np.cumsum(n_lines).tolist()
                for text, n, end in zip(run, n_lines.tolist(), ends, strict=True):
                    at = end - n + (zlib.crc32(text.encode()) % (n - MAX_LINES + 1) if n > MAX_LINES else 0)
                    found.append(x[at : min(at + MAX_LINES, end)].tobytes())
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    found = texts.mapInArrow(features, "doc_id long, y int, x binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES))
    return fit(x, np.array([len(v) for v in xs], int), np.array([r["y"] for r in rows], int))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, in place of any column of that name."""
    rows = docs.select(*[c for c in docs.columns if c != name])
    at = rows.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(model, [t.as_py() or "" for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(scores, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, max_train))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` predicted good, with their columns."""
    rows = scored(docs, train(docs, labels, max_train), "_line_crf_score")
    return rows.where(F.col("_line_crf_score") >= THRESHOLD).select(*docs.columns)
