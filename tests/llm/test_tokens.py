import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quillon.llm import chunk_bpe, packing, token_files, tokens
from tokenizers import Tokenizer

TEXTS = [
    "plain words, and more. " * 400, None, "", " ", "a", "same text\nline two", "same text\nline two",
    "x" * 9000, "\n\n\t  tabs   and runs   of space here " * 60, "éèü ñ 漢字 🎉👩‍👩‍👧 " * 200,
    "before <|endoftext|> after", "<|endoftext|>" * 3, "nul\x00byte", "it's they'll WE'VE 1234567890" * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_library_for_every_code_point(library):
    bpe = tokens.encoder(tokens.rank_path())
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?\n{chr(c)}  " for c in [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        expected = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [tokens.encode(bpe, t).tolist() for t in part] == expected
    for text in TEXTS:
        assert tokens.encode(bpe, text or "").tolist() == ids_of(library, text)


def test_long_runs_of_white_space(library):
    bpe = tokens.encoder(tokens.rank_path())
    n, stop = 2_000_000, tokens.SPECIAL
    texts = [" " * n, "\t" * n, "\n" * n, "a b" + " \t\n" * (n // 3) + "x y", "one" + " " * n + "two", "one" + "\n" * n + "two's", "\r\n" * 20_000 + "7",
             "a" + " " * 20_000 + stop + " " * 20_000 + "b" + stop, "x" + " " * 10_000 + "y" + "\n" * 9_999 + "z" + "\n" * 10_001 + "'s"]
    texts += ["q" + "".join(map(chr, spaces)) * 6_000 + "w" for spaces in ([0x85, 0xA0], [0x1680, 0x2000, 0x200A], [0x2028, 0x2029, 0x202F, 0x205F, 0x3000], [0x1C, 0x20], [0x200B, 0x20])]
    chunks = chunk_bpe.ChunkEncoder(bpe)
    for text in texts:
        expected = ids_of(library, text)
        assert tokens.encode(bpe, text).tolist() == expected
        assert chunks.encode(text) == expected


@pytest.mark.parametrize("n", [2, 3, 39, 40, 41, 64, 100, 1000, 9999])
def test_time_of_white_space_does_not_grow_with_its_runs(library, n):
    bpe = tokens.encoder(tokens.rank_path())
    chunks = chunk_bpe.ChunkEncoder(bpe)
    for c in " \n\t\u3000":
        text = (c * n + "x") * (400_000 // (n + 1))
        expected = ids_of(library, text)
        began = time.perf_counter()
        assert tokens.encode(bpe, text).tolist() == expected
        assert chunks.encode(text) == expected
        assert time.perf_counter() - began < 4


def test_operators_take_long_runs_of_white_space(docs, library):
    texts = ["some words " * 300 + " " * 1_500_000 + "end", "\n" * 1_500_000]
    ids = {i: ids_of(library, t) for i, t in enumerate(texts)}
    for r in chunk_bpe.encode_and_decode(docs(texts)).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in token_files.round_trip(docs(texts)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0], "<u4").tobytes())
    assert {r.doc_id: r.n for r in packing.pack_documents(docs(texts)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(x) + 1 for i, x in ids.items()}


def test_joins_grow_until_ids_agree(library):
    """A chunk whose remembered ids are another encoding of its last words: the join reaches past them."""
    bpe = tokens.encoder(tokens.rank_path())
    text = " ".join(f"river{k} stone lantern" for k in range(3000))
    chunks = chunk_bpe.ChunkEncoder(bpe, 8)
    expected = chunks.encode(text)
    assert expected == ids_of(library, text) and chunks.widened == 0
    raw = text.encode()
    words = [i for i in range(1, 200) if raw[i : i + 1] == b" "]
    left = chunk_bpe.Stretch(words[:8], bpe.encode_ordinary(raw[words[0] : words[7]].decode()))
    right = chunk_bpe.Stretch(words[10:14], bpe.encode_ordinary(raw[words[10] : words[13]].decode()))
    between = bpe.encode_ordinary(raw[words[7] : words[10]].decode())
    assert chunks.joined(raw, left, right) == between
    wrong = chunk_bpe.Stretch(left.words, [*left.ids[:-1], 0])
    assert chunks.joined(raw, wrong, right) is None and chunks.widened > 0


def test_chunked_encoding_is_exact_and_reuses(library):
    bpe = tokens.encoder(tokens.rank_path())
    rng = random.Random(5)
    alphabet = ["the", "The", "a1", "é", "漢", "🎉", "\n", "\t", "  ", "'s", "!!", "12", " ", "x" * 40]
    for bits in (3, 6, 10):
        chunks = chunk_bpe.ChunkEncoder(bpe, bits, limit=4000)
        for _ in range(60):
            text = "".join(rng.choice(alphabet) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(400)))
            assert chunks.encode(text) == ids_of(library, text)
    chunks = chunk_bpe.ChunkEncoder(bpe, 6)
    passage = " ".join(rng.choice(["river", "stone", "lantern", "cloud", "seven"]) + str(k) for k in range(2000))
    chunks.encode("one beginning " + passage)
    before = chunks.encoded
    chunks.encode("quite another start of it " + passage + " and end")
    assert chunks.encoded - before <= 3 < chunks.reused


def test_encode_and_decode_query(docs, library):
    rows = {r.doc_id: r for r in chunk_bpe.encode_and_decode(docs(TEXTS, "1 as n_tokens")).collect()}
    for i, text in enumerate(TEXTS):
        ids = ids_of(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert chunk_bpe.encode_and_decode(docs([])).count() == 0


def test_addressable_codes():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50257, 5000), rng.integers(0, 200, 700), np.array([2**24 + 5, 0, 255, 256, 65536]), np.array([7])):
        levels, bitmaps, ranks = token_files.pack_codes(ids)
        codes = token_files.Codes(levels, bitmaps, ranks)
        assert codes.tokens(0, len(ids)).tolist() == ids.tolist()
        for at in range(0, len(ids), max(1, len(ids) // 300)):
            assert codes.token(at) == ids[at]
            end = int(rng.integers(at, len(ids) + 1))
            assert codes.tokens(at, end).tolist() == ids[at:end].tolist()


def test_token_files_round_trip(spark, docs, library, tmp_path):
    rows = [(97 - 3 * i, t) for i, t in enumerate(TEXTS)]
    out = f"file://{tmp_path}/files"
    token_files.write_token_files(docs(rows, "5 as shard"), out, segment_tokens=500)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, out).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = [*ids_of(library, text), 0]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.round_trip(docs([])).count() == 0
    assert sorted(r.start for r in token_files.round_trip(docs([(1, "a b"), (1, "a b")])).collect()) == [0, 3]


def bins_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return by


def test_packing_query(docs, library):
    rows = packing.pack_documents(docs([*TEXTS, "long words of text " * 3000], "2 as length")).collect()
    by = bins_of(rows)
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in enumerate(TEXTS):
        ids = [*ids_of(library, text), 2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids) and (len(ids) > 1024 or len(mine) == 1)
        assert all(r.length == 1024 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    assert packing.pack_documents(docs([])).count() == 0


def best(sizes, capacity):
    """The least number of bins, by search."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def place(k, bins):
        if len(bins) >= found[0]:
            return
        if k == len(sizes):
            found[0] = len(bins)
            return
        for room in dict.fromkeys(bins):
            if room >= sizes[k]:
                rest = list(bins)
                rest[rest.index(room)] -= sizes[k]
                place(k + 1, rest)
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return found[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(11)
    for _ in range(300):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed = packing.dominating_sets(counts, capacity)
        rest = [s for s, n in counts.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + best(rest, capacity) == best(sizes, capacity)
        assert all(sum(s) <= capacity for _, s in fixed)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(40):
        histogram = {s: rng.randint(1, 500) for s in rng.sample(range(1, 1025), rng.randint(1, 300))}
        plan = packing.packing_plan(histogram, 1024)
        seen, bins = {}, {}
        for length, lo, hi, base, each, first in plan:
            for rank in range(lo, hi):
                assert seen.setdefault((length, rank), True) is True
                bins.setdefault(base + (rank - lo) // each, []).append((first + (rank - lo) % each * length, length))
        assert len(seen) == sum(histogram.values()) == sum(hi - lo for _, lo, hi, *_ in plan)
        for spans in bins.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(s * n for s, n in histogram.items())
        plain = sum(n for n, _ in packing.best_fit(dict(histogram), 1024))
        assert -(-total // 1024) <= len(bins) <= plain * 1.01 + 1


def volume_bound(histogram, capacity):
    """The least number of bins that sizes alone allow, over all splits into large, middle and small items."""
    best = 0
    for small in range(capacity // 2 + 1):
        alone = sum(n for s, n in histogram.items() if s > capacity - small)
        middle = [(s, n) for s, n in histogram.items() if capacity / 2 < s <= capacity - small]
        rest = sum(s * n for s, n in histogram.items() if small <= s <= capacity / 2)
        bins = sum(n for _, n in middle)
        rest -= bins * capacity - sum(s * n for s, n in middle)
        best = max(best, alone + bins + max(0, -(-rest // capacity)))
    return best


def test_plan_is_close_to_the_bound():
    rng = random.Random(4)
    histogram = {s: rng.randint(1, 90) for s in range(1, 1025)}
    used = {base + k for _, lo, hi, base, each, _ in packing.packing_plan(histogram, 1024) for k in range(-(-(hi - lo) // each))}
    assert len(used) <= volume_bound(histogram, 1024) * 1.004
