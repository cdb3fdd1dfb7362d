"""Association rules of URLs against plain counting; long templated paths."""

import itertools
import math
import random
import re
import time

import pytest
from quillon.llm import urls


def plain_rules(rows, min_support, min_confidence):
    """All rules of at most three tokens over (tokens, verdict) rows, without those that a part makes redundant."""
    least = max(1, math.ceil(min_support * len(rows)))
    together, alone = {}, {}
    for tokens, verdict in rows:
        for k in (1, 2, 3):
            for s in itertools.combinations(sorted(set(tokens)), k):
                alone[s] = alone.get(s, 0) + 1
                together[s, verdict] = together.get((s, verdict), 0) + 1
    found = {(s, v): (n / alone[s], n / len(rows)) for (s, v), n in together.items() if n >= least}
    out = {}
    for (s, v), (c, p) in found.items():
        parts = [x for k in range(1, len(s)) for x in itertools.combinations(s, k)]
        if c >= min_confidence and all(found.get((x, v), (0,))[0] < c for x in parts):
            out[s, v] = (c, p)
    return out


def plain_verdict(tokens, rules):
    fired = [(c, p, -len(s), v == "block", v) for (s, v), (c, p) in rules.items() if set(s) <= set(tokens)]
    return max(fired)[-1] if fired else "allow"


def plain_tokens(host, path):
    path = re.sub("[A-Z]", lambda c: c[0].lower(), path)
    found = [f"h:{w}" for w in re.split("[.:]", host)] + ["p:" + re.sub("[0-9]+", "0", w) for w in re.split("[/._~-]+", path)]
    return sorted({t for t in found if len(t) > 2})


def mined(spark, rows, *args):
    """Rules over all members of their items."""
    rules, members = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), *args)
    of = {}
    for r in members.collect():
        of.setdefault(r["item"], []).append(r["token"])
    return {(tuple(sorted(s)), r.verdict): (r.confidence, r.support) for r in rules.collect() for s in itertools.product(*[of[i] for i in r["items"]])}


def test_every_rule_that_passes_is_kept(spark):
    """More frequent tokens than any cap held; those of the least confidence and support are there as well."""
    rows = [([f"t{k:04d}"], "allow") for k in range(2100) for _ in range(2)] + [(["bad"], "block")] * 19 + [(["bad"], "allow")]
    found = mined(spark, rows, 0.0001, 0.9)
    assert {s[0] for s, v in found if v == "allow"} == {f"t{k:04d}" for k in range(2100)}
    assert [(s, c) for (s, v), (c, _) in found.items() if v == "block"] == [(("bad",), 0.95)]
    assert len(found) == 2101


@pytest.mark.parametrize("max_width", [12, 4])
def test_rules_against_counts(spark, max_width):
    """With and without blocks; two tokens that always stand together, and repeated rows."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        t = sorted({rng.choice("abcdefgh") for _ in range(5)})
        verdict = "block" if {"a", "b"} <= set(t) or {"c", "d", "e"} <= set(t) and rng.random() < 0.95 else "allow"
        rows += [(t + ["a2"] if "a" in t else t, verdict)] * rng.choice([1, 1, 3])
    expected = plain_rules(rows, 0.02, 0.9)
    assert (("a", "b"), "block") in expected and (("a2", "b"), "block") in expected and any(len(s) == 3 for s, _ in expected)
    found = mined(spark, rows, 0.02, 0.9, max_width)
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in expected)


def test_query_against_plain_mining(spark):
    """Verdicts of the method, ties between rules included, over whole URLs."""
    rng = random.Random(4)
    words = ["shop", "news", "blog", "win", "casino", "free", "archive", "2024"]
    hosts = ["a.com", "b.com", "example.com", "www.example.com", "x.net", "y.net", "spam.org", "good.org", "b.org"]
    found = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'es', 'de'])}/{'/'.join(rng.sample(words, rng.randrange(4)))}" for _ in range(500)]
    found += [None, "", "http://tie.org/en", found[0]]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    rows = urls.judge(pages, min_support=0.01, min_confidence=0.75).collect()
    labelled = [(plain_tokens(r["host"], r.path), r.verdict) for r in rows if r.rule]
    rules = plain_rules(labelled, 0.01, 0.75)
    verdicts = [(r.verdict, plain_verdict(plain_tokens(r["host"], r.path), rules)) for r in rows if not r.rule]
    assert all(a == b for a, b in verdicts) and {a for a, _ in verdicts} == {"allow", "block"}


@pytest.mark.parametrize("kind", ["fixed", "depth"])
def test_long_paths(spark, kind):
    """Twenty segments on 10,000 URLs: templates, and templates cut at any depth."""
    rng = random.Random(5)
    found = []
    for k in range(10_000):
        segments = [f"seg{chr(97 + i)}" for i in range(20 if kind == "fixed" else rng.randint(1, 20))]
        found.append((k, f"http://{rng.choice(['example.com', 'x.net', 'www.example.com', 'other.org'])}/{rng.choice(['en', 'fr'])}/" + "/".join(segments)))
    pages = spark.createDataFrame(found, "page_id long, url string")
    began = time.time()
    assert urls.judge(pages).count() == 10_000
    assert time.time() - began < 60
