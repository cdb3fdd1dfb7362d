"""Conversation repair by an auction over the lattice of edits.

A row of a conversation is kept, given another role or deleted, and rows are inserted, at whole-number costs, until the role initials read
``(s?(ua)+)?``. Nodes of the lattice are the rows already passed and one of four states of that expression; arcs are the edits.

1. Auction: every node has a price, at first a lower bound of what the rest costs. A path grows from its end along the arc of least cost plus price; where
   the end's price is below that, the price rises to it and the path contracts by one node. A path that reaches the end of the lattice proves its prices.
   The lattice is worked off in blocks of ``BLOCK`` rows from the last to the first, each with the proven prices at its end, so a path never contracts beyond a block.
2. Prices stay below cost plus price of every arc, so exactly the cheapest edits consist of tight arcs. They are traced from the start, the least initial
   first (Delete, Insert, Keep, Rerole); a node from which no tight arc leads on is left again.

Conversations of at most ``LONGEST`` rows are each repaired within a task. Longer ones are spread: equal rows are counted once, rows are dealt out in
ranges of (turn, role, text) and cut into segments; each segment tells its costs from state to state; one small row a segment gives the prices at
all borders; segments trace their edits for every state that they may be entered in, and one more pass over the small rows says which holds.
Only the digest of the repaired text, which is sequential by definition, streams through one task a conversation.

Nulls count as one space (a null conv_id is one conversation, and stays null). Rows are ordered by turn (nulls first), role and text; repeated rows are
repeated turns. Roles are known by their first character; others than s, u and a can't be kept. A conversation without rows left has zeros and empty
texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLOCK = 8
LONGEST = 4096
SEGMENT = 2048
NEVER = 1 << 60
#: Nothing yet, a system row, a user row, an assistant row.
STATES = 4
#: The role that may be inserted, or given to a row, in each state, and the state that follows.
GIVEN = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What is left to pay after the last row: inserted rows until an assistant has the last word.
AT_END = [0, 2 * INSERT, INSERT, 0]

Row = tuple[str, bool, bool, int]  #: initial, whether it must go, whether it is truncated, how many times it stands here (more than once: must go)
Arc = tuple[str, int, int, int]  #: label, cost, rows passed, state after


def arcs_of(initial: str, must: bool, truncated: bool, times: int) -> list[list[Arc]]:
    """The arcs of a row by state, in the order of their labels."""
    extra = TRUNCATED if truncated else 0
    found: list[list[Arc]] = []
    for state, (_, given) in enumerate(GIVEN):
        arcs: list[Arc] = [("D" * times, DELETE * times, 1, state), ("I", INSERT, 0, given)]
        if not must:
            if (state, initial) in FOLLOWS:
                arcs.append(("K", extra, 1, FOLLOWS[state, initial]))
            arcs.append(("R", REROLE + extra, 1, given))
        found.append(arcs)
    return found


class Lattice:
    """Prices of the nodes of a run of rows, given what each state costs after it."""

    KNOWN: dict[Row, list[list[Arc]]] = {}

    def __init__(self, rows: list[Row], ends: list[int]) -> None:
        self.arcs = []
        for row in rows:
            if row not in self.KNOWN and row[3] == 1:
                self.KNOWN[row] = arcs_of(*row)
            self.arcs.append(self.KNOWN[row] if row[3] == 1 else arcs_of(*row))
        self.price = [[0] * STATES for _ in rows] + [list(ends)]
        for start in range((len(rows) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            self.settle(start, min(start + BLOCK, len(rows)))

    def settle(self, start: int, end: int) -> None:
        """Prove the prices at ``start`` by paths to ``end``, whose prices are proven."""
        price, arcs = self.price, self.arcs
        least = min(price[end])
        for k in range(end - 1, start - 1, -1):  # nodes from which no price leads on are out
            after, here = price[k + 1], [NEVER] * STATES
            for _ in range(3):  # inserts within a row's nodes
                for state in range(STATES):
                    if here[state] == NEVER and any((after if step else here)[to] < NEVER for _, _, step, to in arcs[k][state]):
                        here[state] = least
            price[k] = here
        for source in range(STATES):
            if price[start][source] == NEVER:
                continue
            path = [(start, source)]
            while path[-1][0] < end:
                k, state = path[-1]
                best, following = NEVER, path[-1]
                for _, cost, step, to in arcs[k][state]:
                    if cost + price[k + step][to] < best:
                        best, following = cost + price[k + step][to], (k + step, to)
                if price[k][state] < best:
                    price[k][state] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(following)

    def trace(self, state: int) -> tuple[list[tuple[str, int]], int]:
        """The tight arcs from the first row's ``state``, least labels first: (label, state before) of each, and the state at the end."""
        price, arcs, last = self.price, self.arcs, len(self.arcs)
        dead, path, at = set(), [], (0, state)
        while at[0] < last:
            k, s = at
            for label, cost, step, to in arcs[k][s]:
                if price[k][s] == cost + price[k + step][to] and (k + step, to) not in dead:
                    path.append((at, label))
                    at = (k + step, to)
                    break
            else:
                dead.add(at)
                at = path.pop()[0]
        return [(label, s) for (_, s), label in path], at[1]


def tail(state: int) -> list[tuple[str, int]]:
    """The inserts after the last row, as (label, state before)."""
    return [[], [("I", 1), ("I", 2)], [("I", 2)], []][state]


def lines(edits: list[tuple[str, int]], rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired lines ``role:text`` of (role, text) rows; edits without rows are inserts."""
    at = 0
    for label, state in edits:
        if label == "I":
            yield GIVEN[state][0] + ":"
            continue
        if label == "K":
            yield f"{rows[at][0]}:{rows[at][1]}"
        elif label == "R":
            yield f"{GIVEN[state][0]}:{rows[at][1]}"
        at += 1


def damaged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, times, blank, truncated) per row: the damage of the contract; times is 0 for a dropped row and 2 for a repeated one."""

    def told(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(kind == 4, "user").otherwise(told("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    out = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return out.select("*", blank.alias("blank"), (~blank & ~ended).alias("truncated"))


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair_one(key: str, rows: list[tuple]) -> dict:
    """The result of a conversation of rows (turn, role, text, times, blank, truncated) in their order."""
    seen, lattice, texts, initials, turns = set(), [], [], [], set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text, times, blank, truncated in rows:
        for _ in range(times):
            again = (role, text) in seen
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            turns.add(turn)
            initials.append(role[:1])
            lattice.append((role[:1] if role[:1] in ("s", "u", "a") else "", blank or again, fault == "truncated", 1))
            texts.append((role, text))
    grid = Lattice(lattice, AT_END)
    edits, state = grid.trace(0)
    edits += tail(state)
    turns.discard(None)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines(edits, texts)).encode()).hexdigest()
    audit = "".join(label for label, _ in edits)
    return {"key": key, "gaps": gaps, **counts, "illegal": illegal_pairs(initials), "cost": grid.price[0][0], "audit": audit, "repaired_sha256": digest}


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows sorted by their first ``keys`` columns; a row comes without them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row[keys:])
    if key is not None:
        yield key, rows


def in_batches(found: Iterable[dict], schema: pa.Schema, n: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


RESULT_ARROW = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
ORDER = ["turn", "role", "text"]  # ascending: nulls come first


def repair_short(rows: DataFrame) -> DataFrame:
    """Results of conversations that each fit a task: rows as of ``damaged``."""

    def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((repair_one(key[0], own) for key, own in runs(batches, 1)), RESULT_ARROW)

    return rows.repartition("key").sortWithinPartitions("key", *ORDER).mapInArrow(repaired, RESULT)


def long_rows(rows: DataFrame, segment: int) -> DataFrame:
    """Distinct rows of long conversations in their order: (key, segment, at, turn, role, text, times, blank, again, truncated)."""
    rows = rows.where("times > 0").groupBy("key", *ORDER, "blank", "truncated").agg(F.sum("times").alias("times"))
    rows = materialize(rows.withColumn("digest", F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))), "long-conversations")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy("key", "digest").agg(F.min(order).alias("first"))
    flagged = rows.join(first, ["key", "digest"]).withColumn("again", order != F.col("first")).drop("digest", "first")
    ranged = flagged.repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER).withColumn("at", F.monotonically_increasing_id())
    number = F.col("at") - F.pmod(F.col("at"), F.lit(1 << 33)) + F.floor(F.pmod(F.col("at"), F.lit(1 << 33)) / segment)
    return materialize(ranged.select("key", number.alias("segment"), "at", *ORDER, "times", "blank", "again", "truncated"), "segments")


def nodes(role: str, times: int, blank: bool, again: bool, truncated: bool) -> list[Row]:
    """The lattice's rows of a counted row: itself, and its copies, which must go."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    if blank or again:
        return [(initial, True, False, times)]
    return [(initial, False, truncated, 1)] + [(initial, True, False, times - 1)] * (times > 1)


def segment_costs(rows: DataFrame) -> DataFrame:
    """(key, segment, costs, first, last, illegal): costs from each state to each, and what the illegal pairs need."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(key: tuple, own: list[tuple]) -> dict:
            lattice = [n for _, role, times, *flags in own for n in nodes(role, times, *flags)]
            costs = [Lattice(lattice, [0 if s == end else NEVER for s in range(STATES)]).price[0] for end in range(STATES)]
            initials = [role[:1] for _, role, *_ in own]
            copies = sum((times - 1) * (role[:1] * 2 not in LEGAL) for _, role, times, *_ in own)
            return {"key": key[0], "segment": key[1], "costs": [costs[b][a] for a in range(STATES) for b in range(STATES)], "first": initials[0], "last": initials[-1], "illegal": illegal_pairs(initials) + copies}

        schema = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
        return in_batches((of(key, own) for key, own in runs(batches, 2)), schema)

    lean = rows.select("key", "segment", "at", "role", "times", "blank", "again", "truncated")
    lean = lean.repartition("key", "segment").sortWithinPartitions("key", "segment", "at")
    return lean.mapInArrow(summed, "key string, segment long, costs array<long>, first string, last string, illegal long")


def border_prices(own: pd.DataFrame) -> pd.DataFrame:
    """Per segment of a conversation: the price of each state at its end; per conversation: its cost and illegal pairs."""
    own = own.sort_values("segment")
    price, found = AT_END, []
    for costs in own["costs"].iloc[::-1]:
        found.append(list(price))
        price = [min(int(costs[STATES * a + b]) + price[b] for b in range(STATES)) for a in range(STATES)]
    across = sum(a + b not in LEGAL for a, b in zip(own["last"], own["first"].iloc[1:], strict=False))
    return pd.DataFrame({"key": own["key"], "segment": own["segment"], "ends": found[::-1], "total": price[0], "wrong": int(own["illegal"].sum()) + across})


def segment_traces(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """(key, segment, exits, audits): for each state a segment may be entered in, the state it ends in and its edits."""

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(key: tuple, own: list[tuple]) -> dict:
            grid = Lattice([n for _, role, times, blank, again, truncated, _ in own for n in nodes(role, times, blank, again, truncated)], own[0][-1])
            found = [grid.trace(s) if grid.price[0][s] < NEVER else ([], 0) for s in range(STATES)]
            return {"key": key[0], "segment": key[1], "exits": [end for _, end in found], "audits": [",".join(f"{label}{s}" for label, s in edits) for edits, _ in found]}

        schema = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("exits", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
        return in_batches((of(key, own) for key, own in runs(batches, 2)), schema)

    lean = rows.select("key", "segment", "at", "role", "times", "blank", "again", "truncated").join(borders.select("key", "segment", "ends"), ["key", "segment"])
    lean = lean.repartition("key", "segment").sortWithinPartitions("key", "segment", "at")
    return lean.mapInArrow(traced, "key string, segment long, exits array<long>, audits array<string>")


def entered(own: pd.DataFrame) -> pd.DataFrame:
    """Per segment of a conversation: the state in which it is entered, the state in which it ends, and whether it is the last."""
    own = own.sort_values("segment")
    state, states = 0, []
    for exits in own["exits"]:
        states.append((state, state := int(exits[state])))
    return pd.DataFrame({"key": own["key"], "segment": own["segment"], "state": [a for a, _ in states], "exit": [b for _, b in states], "final": [False] * (len(own) - 1) + [True]})


def repair_long(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Results of conversations of any length: rows as of ``damaged``."""
    parts = long_rows(rows, segment)
    costs = segment_costs(parts)
    borders = materialize(costs.groupBy("key").applyInPandas(border_prices, "key string, segment long, ends array<long>, total long, wrong long"), "borders")
    traces = materialize(segment_traces(parts, borders), "traces")
    places = traces.select("key", "segment", "exits").groupBy("key").applyInPandas(entered, "key string, segment long, state int, exit int, final boolean")
    chosen = traces.join(places, ["key", "segment"]).select("key", "segment", F.element_at("audits", F.col("state") + 1).alias("edits"), "exit", "final")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(key: tuple, own: list[tuple]) -> dict:
            edits = [(e[:-1], int(e[-1])) for e in own[0][-3].split(",") if e]
            edits += tail(own[0][-2]) if own[0][-1] else []
            texts = []
            for _, role, text, times, blank, again, *_ in own:
                texts += [(role, text)] * (1 if blank or again or times == 1 else 2)
            repaired = list(lines([(label[:1], s) for label, s in edits], texts))
            return {"key": key[0], "segment": key[1], "audit": "".join(label for label, _ in edits), "n": len(repaired), "repaired": "\n".join(repaired)}

        schema = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("audit", pa.string()), ("n", pa.int64()), ("repaired", pa.string())])
        return in_batches((of(key, own) for key, own in runs(batches, 2)), schema, 1)

    texts = parts.select("key", "segment", "at", "role", "text", "times", "blank", "again").join(chosen, ["key", "segment"])
    texts = texts.repartition("key", "segment").sortWithinPartitions("key", "segment", "at")
    texts = texts.mapInArrow(pieces, "key string, segment long, audit string, n long, repaired string")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, digest, begun = None, [], None, False
        schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            for k, _, part, n, repaired in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
                    key, audit, digest, begun = k, [], hashlib.sha256(), False
                audit.append(part)
                if n:
                    digest.update(("\n" * begun + repaired).encode())
                    begun = True
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    hashed = texts.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(digests, "key string, audit string, repaired_sha256 string")
    turns = rows.where("times > 0").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    single = F.when(F.col("blank") | F.col("again"), 0).otherwise(1)
    counts = parts.groupBy("key").agg(
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("times") - single)).alias("duplicate"),
        F.sum(F.when(F.col("truncated"), single).otherwise(0)).alias("truncated"),
    )
    totals = borders.groupBy("key").agg(F.first("total").alias("cost"), F.first("wrong").alias("illegal"))
    every = rows.select("key").distinct().join(turns, "key", "left").join(counts, "key", "left").join(totals, "key", "left").join(hashed, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("key", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame, longest: int = LONGEST, segment: int = SEGMENT) -> DataFrame:
    """Per conv_id of ``rows`` (conv_id, turn, role, text): faults after the damage, the cheapest edits and the digest of the repaired text."""
    kind = rows.schema["conv_id"].dataType
    rows = damaged(rows)
    long = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > longest).select("key"), "long-keys")
    if long.isEmpty():
        found = repair_short(rows)
    else:
        found = repair_short(rows.join(long, "key", "left_anti")).unionByName(repair_long(rows.join(long, "key", "left_semi"), segment))
    conv_id = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind)
    return found.select(conv_id.alias("conv_id"), *[c for c in found.columns if c != "key"])


def sql() -> str:
    """The rows of ``repair`` over the table conversations, for DuckDB: the least (cost, edits) of each state, row after row. Inserts are left out: at a cost of 5 one
    never pays, as deleting a row next to it costs 2 at most and has the same effect on what may follow."""

    def row(s: str, cost: str, label: str, line: str | None) -> str:
        out = f"{s}.o" if line is None else f"{s}.o || chr(10) || {line}"
        return f"case when {s} is not null then {{'c': {s}.c + {cost}, 'a': {s}.a || '{label}', 'o': {out}}} end"

    def kept(s: str, initial: str) -> str:
        return f"case when not must and initial = '{initial}' then {row(s, 'extra', 'K', 'line')} end"

    def given(s: str, role: str) -> str:
        return f"case when not must then {row(s, '1 + extra', 'R', f"'{role}:' || text")} end"

    deleted = [row(f"s{k}", "2", "D", None) for k in range(4)]
    user = ", ".join(f"{kept(s, 'u')}, {given(s, 'user')}" for s in ("s0", "s1", "s3"))
    state = "null::struct(c bigint, a varchar, o varchar)"
    return f"""with recursive told as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as codes from conversations),
 crc as (select *, xor(list_reduce(list_concat([4294967295::bigint], codes), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::bigint) % 20 as kind from told),
 damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from crc),
 placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as rn from damaged),
 faulty as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by rn) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' end as fault,
   left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by rn) || left(role, 1) as pair from placed),
 lattice as materialized (select conv_id, rn, initial, text, role || ':' || text as line, coalesce(fault in ('blank', 'duplicate'), false) as must, case when fault = 'truncated' then 5 else 0 end as extra from faulty),
 steps as (select conv_id, 0::bigint as rn, {{'c': 0::bigint, 'a': '', 'o': ''}} as s0, {state} as s1, {state} as s2, {state} as s3 from (select distinct conv_id from conversations)
   union all select l.conv_id, l.rn, {deleted[0]}, list_min([{deleted[1]}, {kept('s0', 's')}]), list_min([{deleted[2]}, {user}]), list_min([{deleted[3]}, {kept('s2', 'a')}, {given('s2', 'assistant')}])
   from steps s join lattice l on l.conv_id is not distinct from s.conv_id and l.rn = s.rn + 1),
 best as (select conv_id, list_min([s0, s3]) as b from steps qualify row_number() over (partition by conv_id order by rn desc) = 1),
 counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
 select best.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, b.c as cost, b.a as audit, sha256(substr(b.o, 2)) as repaired_sha256
 from best left join counts on counts.conv_id is not distinct from best.conv_id"""
