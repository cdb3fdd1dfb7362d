"""the sources of negative controls are put in order within tasks; every pair of a claim and a source was shuffled with both texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from quillon.operators import agreement
from test_pages_in_rows import shuffled

DEPTH = 6


@pytest.fixture(scope="module")
def tables(spark):
    """Claims and sources of 300 questions; the first claim's words are in most sources, one claim has none, a question has a source twice."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    claims = [(q, [f"s{q % 5}"], words[:2] if q == 0 else [] if q == 1 else sorted(rng.sample(words, 4)), f"claim {q}") for q in range(12)]
    sources = [(q, [f"s{(q + k) % 5}"], words[:4] if q % 50 else words[4:8], f"source {q} {k}") for q in range(300) for k in range(q % 3 + 1)] + [(7, ["s2"], words[:4], "source 7 0")]
    given = spark.createDataFrame(claims, "question_id long, sections array<string>, words array<string>, claim string")
    return claims, sources, given, spark.createDataFrame(sources, "source_question long, source_sections array<string>, source_words array<string>, source string")


def expected_of(claims, sources):
    rows = set()
    for q, sections, words, claim in claims:
        first = {}
        for b, others, found, text in sources:
            share = len(set(words) & set(found)) / len(words) if words else 0.0
            if b != q and not set(sections) & set(others) and share <= 0.3:
                k = hashlib.sha256("\x1f".join(["5", f"control-sources:{q}|{claim}", f"{b}|{text}"]).encode()).hexdigest()
                first[b] = min(first.get(b, (k, text, share)), (k, text, share))
        ranked = sorted((k, b, text, share) for b, (k, text, share) in first.items())[:DEPTH]
        rows |= {(f"{q}|{claim}", place, b, text, share) for place, (_, b, text, share) in enumerate(ranked, 1)}
    return rows


@pytest.mark.parametrize("sampled", [1, 8, 64, 100000])
def test_bounds_change_no_place(tables, sampled, monkeypatch):
    claims, sources, given, pool = tables
    bounds, pairs = [], agreement.fitting_pairs

    def spy(donors, own, *rest):
        bounds.append(len(own))
        return pairs(donors, own, *rest)

    monkeypatch.setattr(agreement, "SAMPLED", sampled)
    monkeypatch.setattr(agreement, "fitting_pairs", spy)
    queue = agreement.control_donors(given, 5)
    found = agreement.fitting_sources(queue.collect(), queue, pool, 5, 0.3, DEPTH)
    expected = expected_of(claims, sources)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 30
    assert bounds[0] == 0 and {1: bounds[1] > 5, 8: 0 < bounds[1] < len(claims), 64: bounds[1] < len(claims), 100000: bounds[1] == 0}[sampled]


def test_no_text_of_a_pair_is_shuffled(tables):
    _, _, given, pool = tables
    queue = agreement.control_donors(given, 5)
    inputs = shuffled(agreement.fitting_sources(queue.collect(), queue, pool, 5, 0.3, DEPTH))
    assert inputs and not [x for x in inputs if re.search("source_name#|source_words#|donor#", x)]
