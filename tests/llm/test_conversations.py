import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from quillon.llm import conversations, queries

ROW = "conv_id long, turn long, role string, text string, key string"


def plain_edits(rows):
    """Least (cost, audit, lines) over all edits, by comparing whole texts of edits; rows are (role, text, must, truncated)."""
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    given = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
    best = [(0, "", ()), None, None, (0, "", ())]
    for k in range(len(rows), -1, -1):
        here = [None] * 4 if k < len(rows) else best
        for _ in range(4):
            for s in range(4):
                found = [here[s]] if here[s] else []
                if here[given[s][1]]:
                    c, a, t = here[given[s][1]]
                    found.append((c + 5, "I" + a, (given[s][0] + ":", *t)))
                if k < len(rows):
                    role, text, must, truncated = rows[k]
                    if best[s]:
                        found.append((best[s][0] + 2, "D" + best[s][1], best[s][2]))
                    extra = 5 if truncated else 0
                    to = follows.get((s, role[:1]))
                    if not must and to is not None and best[to]:
                        found.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}", *best[to][2])))
                    if not must and best[given[s][1]]:
                        c, a, t = best[given[s][1]]
                        found.append((c + 1 + extra, "R" + a, (f"{given[s][0]}:{text}", *t)))
                here[s] = min(found) if found else None
        best = here
    return best[0]


def plain_repair(table):
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, [])
        told = " " if conv is None else str(conv), " " if turn is None else str(turn)
        kind = zlib.crc32(":".join(told).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, lattice = set(), [], []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            lattice.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, lines = plain_edits(lattice)
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def table(seed, n_convs, longest):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "unknown"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Ends?  ", "a.b", " ", "x" * 50 + "."]
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, longest)):
            natural = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if natural else rng.choice(roles)
            text = f"text {rng.randrange(10**6)}." if natural else rng.choice(texts)
            rows.append((conv, turn if rng.random() < 0.95 else rng.choice([None, 3]), role, text))
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None), (n_convs, 0, "assistant", "a.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], ROW).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_conversations_against_whole_texts(spark, seed):
    rows = table(seed, 150, 40)
    found = got(conversations.repair(frame(spark, rows)))
    assert found == plain_repair(rows)
    assert {c for r in found for c in r[7]} == set("DKR")  # at these costs an insert never pays


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_long_conversations_in_segments(spark, segment):
    rows = table(5, 12, 60) + [(3, 9, "user", "Same.")] * 30 + [(3, 11, "assistant", "")] * 20 + [(4, k, "user", "Same.") for k in range(40)]
    assert got(conversations.repair(frame(spark, rows), longest=20, segment=segment)) == plain_repair(rows)


def test_registered_query_on_a_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.queries()["op13_auction_repair"](spark, sf_dir)) == plain_repair(rows)


def test_sql_against_whole_texts():
    rows = table(9, 80, 30)
    columns = list(zip(*rows, strict=True))
    conversations_table = pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})
    con = duckdb.connect()
    con.register("conversations", conversations_table)
    assert sorted(con.sql(conversations.sql()).fetchall(), key=repr) == plain_repair(rows)


def test_empty_table_and_dropped_conversations(spark):
    assert got(conversations.repair(frame(spark, []))) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    expected = [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(conversations.repair(frame(spark, [(gone, 0, "user", "Hi.")]))) == expected
    assert got(conversations.repair(frame(spark, [(gone, 0, "user", "Hi.")] * 3), longest=2)) == expected


def test_prices_are_lower_bounds_and_traced_arcs_are_tight():
    rng = random.Random(0)
    for _ in range(200):
        rows = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.2, 1) for _ in range(rng.randrange(1, 60))]
        grid = conversations.Lattice(rows, conversations.AT_END)
        for k, of_row in enumerate(grid.arcs):
            for state, arcs in enumerate(of_row):
                assert all(grid.price[k][state] <= cost + grid.price[k + step][to] for _, cost, step, to in arcs)
        edits, state = grid.trace(0)
        must = [("user" if r[0] == "u" else "assistant" if r[0] == "a" else "system" if r[0] == "s" else "", "t", r[1], r[2]) for r in rows]
        cost, audit, _ = plain_edits(must)
        assert grid.price[0][0] == cost and "".join(label for label, _ in edits + conversations.tail(state)) == audit
