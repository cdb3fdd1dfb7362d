import random
import re

import numpy as np
import pytest
from quillon.llm import similar


def plain_set(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def plain_groups(docs, width=5):
    """doc_id -> smallest doc_id reachable over all pairs of similarity 0.8 or more."""
    sets = {d: plain_set(t, width) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in docs}


def corpus(seed=3):
    """Texts with copies from clearly above to clearly below the similarity, chains of copies and a passage that all of some share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d f", "x " * 20_000]
    for k in range(40):
        base = [word() for _ in range(rng.randrange(20, 400))]
        texts.append(" ".join(base) + (" " + passage if k % 3 == 0 else ""))
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 3 + len(base) // 40)):
                base[rng.randrange(len(base))] = word()
            texts.append("\n".join(base).upper() if rng.random() < 0.3 else " ".join(base))
    return texts


@pytest.mark.parametrize("bucket", [3, 4096])
def test_groups_against_all_pairs(docs, bucket):
    texts = corpus()
    expected = plain_groups(dict(enumerate(texts)))
    rows = similar.similar_groups(docs(texts, "7L as vertex"), bucket=bucket).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected and len(rows) == len(texts)
    assert 40 < len(set(expected.values())) < len(texts) - 30


def test_copies_of_a_base_that_are_not_similar_to_each_other(docs):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    texts = [" ".join(base)]
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(10, 190), 4):
            copy[at] = f"c{k}_{at}"
        texts.append(" ".join(copy))
    texts = texts[1:] + texts[:1]
    rows = similar.similar_groups(docs(texts), bucket=50).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(dict(enumerate(texts)))


def test_empty_table_null_ids_and_repeated_rows(docs):
    assert similar.similar_groups(docs([])).count() == 0
    rows = similar.similar_groups(docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "q r s t")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 4), (2, 2), (4, 4), (4, 4)]


def test_bit_planes_match_popcount():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 500):
        fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        units = np.sort(rng.integers(0, 4, n))
        asks, answers = rng.random(n) < 0.4, rng.random(n) < 0.8
        got = [(int(a), int(b)) for i, j in similar.near_answers(units, fps, asks, answers) for a, b in zip(i, j, strict=True)]
        near = lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= similar.RADIUS
        assert sorted(got) == [(a, b) for a in range(n) if asks[a] for b in range(n) if answers[b] and units[a] == units[b] and near(a, b)]
