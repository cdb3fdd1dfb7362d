"""The packing plan stays small on many pieces of middle length."""

import random
import time

from pyspark.sql import functions as F
from quillon.llm import packing


def test_plan_of_middle_lengths_is_bounded():
    rng = random.Random(4)
    histogram = {s: rng.randrange(5_000, 10_000) for s in range(300, 341)}
    began = time.monotonic()
    plan = packing.packing_plan(dict(histogram), 1024)
    assert len(plan) <= 27 * len(histogram) and time.monotonic() - began < 20
    for s, n in histogram.items():
        ranges = sorted((lo, hi) for length, lo, hi, *_ in plan if length == s)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    rows, widths = packing.by_rank_bucket(plan)
    assert len(rows) <= 2 * len(plan) and len(widths) == len(histogram)


def test_triples_are_those_of_single_copies():
    """Many copies at once give the sets that one copy at a time gives, in the same order."""

    def expanded(bins):
        return [chosen for n, chosen in bins for _ in range(n)]

    rng = random.Random(5)
    for _ in range(200):
        low = rng.randrange(20, 400)
        counts = {s: rng.randrange(1, 40) for s in rng.sample(range(low, min(low + 60, 700)), rng.randrange(1, 12))}
        many = packing.dominating_sets(a := dict(counts), 1024)
        one = one_at_a_time(b := dict(counts), 1024)
        assert expanded(many) == expanded(one) and a == b


def one_at_a_time(counts, capacity):
    fixed, changed = [], True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while s in counts and (chosen := chosen_set(counts, capacity, s)):
                n = min(counts[x] // chosen.count(x) for x in chosen) if len(chosen) < 3 else 1
                fixed.append((n, chosen))
                for x in chosen:
                    counts[x] -= n
                    if not counts[x]:
                        del counts[x]
                changed = True
    return fixed


def chosen_set(counts, capacity, s):
    items = sorted(x for x, n in counts.items() for _ in range(min(n, 5)))
    items.remove(s)
    room = capacity - s
    fitting = [x for x in items if x <= room]
    if not fitting:
        return (s,)
    partner = fitting[-1]
    if partner == room or sum(items[:2]) > room or len(items) == 1:
        return (s, partner)
    if len(items) == 2 or sum(items[:3]) > room:
        second = max((x for x in items if x <= min(room // 2, partner)), default=0)
        items.remove(partner)
        mate = max((x for x in items if x <= room - partner), default=0)
        if mate and mate >= second:
            return (s, partner, mate)
    return ()


def test_middle_lengths_fill_each_sequence_once(spark):
    pieces = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (300 + F.col("id") % 41).alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(used) == list(range(len(used))) and len(used) <= 2001
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 1024
