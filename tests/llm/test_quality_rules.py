import math
import random
import re

import xxhash
from quillon.llm import quality_rules as qr


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h_bytes(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def grams(ws):
    hs = [h_bytes(w.encode()) for w in ws]
    out = [signed(h) % qr.BUCKETS for h in hs]
    for k, a in enumerate(hs):
        h = h_bytes(a.to_bytes(8, "little"))
        if k + 1 < len(hs):
            h = h_bytes(hs[k + 1].to_bytes(8, "little"), seed=h)
        out.append(signed(h) % qr.BUCKETS)
    return out


def plain(rows, good):
    """doc -> counts, score and verdict."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    raw, target = [0] * qr.BUCKETS, [0] * qr.BUCKETS
    for (d, _), ws in zip(rows, words, strict=True):
        for g in grams(ws):
            raw[g] += 1
            target[g] += d in good
    w = [math.log((t + 1) / (sum(target) + qr.BUCKETS)) - math.log((r + 1) / (sum(raw) + qr.BUCKETS)) if sum(target) else 0.0 for t, r in zip(target, raw, strict=True)]
    out = []
    for (d, t), ws in zip(rows, words, strict=True):
        t = t or ""
        windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        again = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
        covered = {i + k for i, x in enumerate(windows) if x in again for k in range(8)}
        lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        gs = grams(ws)
        llr = sum(w[g] for g in gs) / len(gs) if gs else 0.0
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        counts = (len(ws), sum(map(len, ws)), sum(c in qr.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))
        out.append((d, *counts, failed, not failed and llr >= qr.MIN_LLR, llr))
    return out


def corpus():
    rng = random.Random(4)
    good = [f"good{rng.randrange(300)}" for _ in range(900)]
    texts = [None, "", " \t\n ", "few words only", "é漢字 🎉 x\x1cy z " * 9, "same line\nsame line\n \n \nother | line # * <x> & %\nsame line", "a b c d e f g h i " * 40]
    texts += ["a b c d e f g h " + " ".join(rng.sample(good, 60)) + " a b c d e f g h", "\x0b\x0ctab\tword" * 30]
    for k in range(30):
        part = [rng.choice(good) for _ in range(rng.randrange(15, 90))]
        if k % 3 == 0:
            part = [x + rng.choice(["###", "&&&"]) for x in part]
        if k % 5 == 0:
            part += part[:20]
        texts.append((" " if k % 2 else "\n").join(part))
    return texts


def test_query_against_plain(spark, docs):
    texts = corpus()
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(9, len(texts)) if i % 4] + [(10, 0, 1), (None, 1, 0), (999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = list(enumerate(texts))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    expected = plain(rows, good)
    got = {r.doc_id: r for r in qr.judge(docs(texts, "1 as kept"), labels).collect()}
    for d, *counts, failed, kept, llr in expected:
        r = got[d]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts, texts[d]
        assert (r.base_failed, r.kept) == (failed, kept) and abs(r.llr - llr) < 1e-9
    assert 0 < sum(r.kept for r in got.values()) < len(got)
    kept = qr.keep(docs(texts, "1 as kept"), labels)
    assert sorted(r.doc_id for r in kept.collect()) == [e[0] for e in expected if e[-2]]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qr.judge(docs([]), none).count() == 0
    rows = qr.judge(docs([(1, "w " * 30), (1, "w " * 30), (None, " ".join(map(str, range(40))))]), none).collect()
    assert [r.llr for r in rows] == [0.0] * 3 and sorted(r.kept for r in rows) == [False, False, True]
    long = " ".join(str(i % 50_000) for i in range(120_000))
    assert qr.judge(docs([(1, long)]), none).first().n_repeat_words == 120_000
