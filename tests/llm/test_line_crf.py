import itertools
import math
import random
import zlib

import numpy as np
from quillon.llm import line_crf


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(5)
    n_lines = np.array([1, 4, 2, 6])
    score, move = rng.normal(size=13), rng.normal(size=(2, 2))
    good, pairs = line_crf.forward_backward(score, n_lines, move)
    at, expected = 0, np.zeros((2, 2))
    for n in n_lines:
        s = score[at : at + n]
        total, marginal, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(s[i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            total += p
            marginal += p * np.array(y)
            for a, b in itertools.pairwise(y):
                moved[a, b] += p
        assert np.allclose(good[at : at + n], marginal / total)
        expected += moved / total
        at += n
    assert np.allclose(pairs, expected)


def plain_chain(score, move):
    """Sum over all labelings, and marginals of label good."""
    total, marginal = 0.0, np.zeros(len(score))
    for y in itertools.product((0, 1), repeat=len(score)):
        p = math.exp(sum(s * v for s, v in zip(score, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        total += p
        marginal += p * np.array(y)
    return total, marginal / total


def test_training_climbs_the_likelihood_of_readings():
    """The gradient of the first step is that of log P(readings), by differences over all labelings."""
    rng = np.random.default_rng(2)
    n_lines, labels = np.array([3, 1, 4]), np.array([1, 0, 0])
    x = rng.normal(size=(8, line_crf.N_FEATURES)).astype(np.float32)
    noise, step = 0.1, 1e-6
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = line_crf.Model(mean, scale, np.zeros(0), np.zeros((2, 2))).inputs(x, n_lines)
    reading = math.log((1 - noise) / noise) * np.repeat(2.0 * labels - 1, n_lines)

    def likelihood(w):
        at, value = 0, 0.0
        for n in n_lines:
            s = z[at : at + n] @ w[:-4]
            value += math.log(plain_chain(s + reading[at : at + n], w[-4:].reshape(2, 2))[0] / plain_chain(s, w[-4:].reshape(2, 2))[0])
            at += n
        return value

    w = rng.normal(size=3 * line_crf.N_FEATURES + 5) * 0.1
    score, move = z @ w[:-4], w[-4:].reshape(2, 2)
    good, pairs = line_crf.forward_backward(score, n_lines, move)
    read, seen = line_crf.forward_backward(score + reading, n_lines, move)
    g = np.concatenate([z.T @ (read - good), (seen - pairs).ravel()])
    for k in (0, 7, 30, len(w) - 4, len(w) - 3, len(w) - 1):
        d = np.zeros_like(w)
        d[k] = step
        assert abs((likelihood(w + d) - likelihood(w - d)) / (2 * step) - g[k]) < 1e-5
    model = line_crf.fit(x, n_lines, labels)
    assert likelihood(np.concatenate([model.emit, model.move.ravel()])) > likelihood(np.zeros_like(w))


def test_query_against_all_labelings(spark, docs):
    """Scores of ``classify`` are the length-weighted marginals of the fitted chain, summed over all labelings."""
    texts = [(i, t) for i, t in rows(160) if t.count("\n") < 8] + [(500, None), (501, "\n"), (502, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i, _ in texts if i % 3 and i < 500], "doc_id long, quality int, toxic int")
    given = docs(texts)
    model = line_crf.train(given, labels)
    assert model.move[0, 1] != 0 != model.move[1, 0]
    got = {r.doc_id: r.score for r in line_crf.classify(given, labels).collect()}
    for i, text in texts:
        x, size, n_lines = line_crf.line_features([text or ""])
        _, good = plain_chain(model.inputs(x, n_lines) @ model.emit, model.move)
        assert abs(got[i] - (good * size).sum() / size.sum()) < 1e-9


def test_training_rows_are_bounded(spark, docs):
    """One row per doc_id and a bounded run of its lines reach the driver, however often a row repeats and however long it is."""
    text = "\n".join(f"line {k} of a long text." for k in range(5000))
    given = docs([(1, text)] * 50 + [(1, "other")] + [(3, "BAD!! ### | |")] * 50)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    sizes = []
    fit = line_crf.fit
    try:
        line_crf.fit = lambda x, n, y, **k: (sizes.extend(n.tolist()), fit(x, n, y, **k))[1]
        line_crf.train(given, labels)
    finally:
        line_crf.fit = fit
    assert len(sizes) <= 2 and max(sizes) <= line_crf.MAX_LINES


def test_features_are_those_of_each_line_alone():
    texts = ["One Two two!! ###\n\nÉté 12 | x", "", "  \t ", "last line é"]
    x, size, n_lines = line_crf.line_features(texts)
    assert n_lines.tolist() == [3, 1, 1, 1]
    alone = [line_crf.line_features([line]) for t in texts for line in t.split("\n")]
    assert np.allclose(x, np.concatenate([a[0] for a in alone])) and size.tolist() == [a[1][0] for a in alone]
    assert x[0, 8] == 0 and line_crf.line_features(["Two Two two"])[0][0, 8] > 0


def rows(n=400):
    rng = random.Random(6)
    clean = [f"w{rng.randrange(99)}ord" for _ in range(99)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(clean) for _ in range(rng.randrange(3, 30))) + "." for _ in range(rng.randrange(1, 9))]
        if i % 4 == 1:
            lines = [x.upper().replace(" ", "!! ") if i % 8 == 1 else x.replace(" ", " | ") for x in lines]
        out.append((i, "\n".join(lines)))
    return out


def test_held_out_accuracy_and_edges(spark, docs):
    texts = rows()
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i, _ in texts if i % 3], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (None, "some words here"), (1002, "long words " * 50_000), (1002, "long words " * 50_000), (1003, "\n" * 500)]
    got = line_crf.classify(docs(texts + extra, "'x' as score"), labels).collect()
    assert len(got) == len(texts) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 != 1) for r in held) / len(held) > 0.95
    kept = line_crf.keep(docs(texts, "'x' as score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert kept.count() == sum(r.predicted for r in got if r.doc_id is not None and r.doc_id < 400)
    assert {r.score for r in kept.collect()} == {"x"}


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    texts = rows(120)
    schema = "doc_id long, quality int, toxic int"
    a = [(i, int(i % 4 != 1), 0) for i, _ in texts]
    b = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in a]
    one, two = (sorted(map(tuple, line_crf.classify(docs(texts), spark.createDataFrame(x, schema)).collect())) for x in (a, b))
    assert one == two


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in line_crf.classify(docs(["a", None]), none).collect()] == [0.5, 0.5]
    assert line_crf.classify(docs([]), none).count() == 0
