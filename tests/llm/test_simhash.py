import random
import re

import numpy as np
import pytest
import xxhash
from quillon.llm import components, simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks):
    """doc_id -> smallest doc_id reachable, from all pairs."""
    root = {d: d for d, _ in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in marks:
        for b, y in marks:
            if a < b and (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in marks}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [None, "", "one", "Two  words", "ÄÖ É straße nbsp x y", "\x1c\x85 odd\x0bspaces here\x0c", "a b c d" * 3000]
    for _ in range(n):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = "Edited"
            texts.append("\n".join(base))
    return texts


def test_query_against_all_pairs(docs):
    texts = corpus()
    marks = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    expected = plain_components(marks)
    rows = simhash.near_duplicates(docs(texts, "7L as fp")).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in marks}
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert len(set(expected.values())) < len(texts) - 10
    kept = simhash.one_of_each(docs(texts), simhash.near_duplicates(docs(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table_null_ids_and_repeated_rows(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    rows = simhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "q r s t")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 4), (2, 2), (4, 4), (4, 4)]


@pytest.mark.parametrize("bucket", [7, 4096])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(30)):
            x ^= 1 << rng.randrange(64)
            fps.add(x if rng.random() < 0.7 else x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, bucket)
    expected = plain_components(list(enumerate(fps)))
    got = {r.node: r.root for r in components.components(links).collect()}
    place = {x: i for i, x in enumerate(signed)}
    groups = {}
    for i, r in expected.items():
        groups.setdefault(r, set()).add(i)
    found = {}
    for x in signed:
        found.setdefault(got.get(x, x), set()).add(place[x])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_bit_planes_match_popcount():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 500):
        base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        fps = base[rng.integers(0, 6, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        keys = np.sort(rng.integers(0, 4, n))
        got = {(int(a), int(b)) for i, j in simhash.near_rows(keys, fps) for a, b in zip(i, j, strict=True)}
        assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= 3}


def test_components_of_chains_hubs_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 400)] + [(1000, 1001), (1001, 1002), (1002, 1000), (3, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 5 for k in [5, *range(200, 400)]} | {k: 1000 for k in range(1000, 1003)}
