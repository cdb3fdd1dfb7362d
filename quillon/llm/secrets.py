"""Secret scans with multipart credential linking, with Spark functions only.

Strong patterns stand alone. Weak ones (identifiers, short secrets, endpoints) are noise by themselves; they are reported only
if a complementary part lies within ``SCOPE`` code points: a secret for an identifier or an endpoint, either of them for a
secret. Parts are joined by document and overlapping scope bins, so a bin holds a bounded number of them; rows with equal doc_id
and text are one document here.

Null texts count as empty. Rows with equal doc_id and text share one set of spans and each get it. An empty table gives
no rows. Extra columns are ignored (and kept by ``mask``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, materialize

SCOPE = 200
# The base patterns, and the weak ones of this method.
KEY = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
IDENTIFIER = r"""(?i:client_?id|access_?key_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?:https?|ftps?|ssh|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}"""
KINDS = ["assign", "access", "hex", "identifier", "short_secret", "endpoint"]
MIN_ASSIGN, MIN_SHORT = 12, 6
BLOCK, GROUP = 4096, 64
SPAN = "struct<start:int,kind:int,end:int>"


def scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join``, an associative function, makes of each value and all before it: steps of doubled length, so no array is copied per value."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        moved = F.concat(F.array_repeat(F.lit(None).cast("int"), shift), F.slice(acc, 1, F.greatest(F.size(acc) - shift, F.lit(0))))
        return F.when(F.size(acc) > shift, F.zip_with(acc, moved, lambda a, b: F.when(b.isNull(), a).otherwise(join(b, a)))).otherwise(acc)

    return F.aggregate(steps, values.cast("array<int>"), step)


def found(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """(start, end, ok) of all leftmost matches, in code points.

    The text between matches and the matches themselves alternate, so their lengths add up to the places. ``keep`` says of the matches which are ok.
    """

    def spans(hits: Column) -> Column:
        hit = F.transform(hits, F.length)
        gap = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.length)
        ok = F.transform(hits, lambda _: F.lit(True)) if keep is None else keep(hits)
        parts = F.arrays_zip(scanned(F.zip_with(gap, hit, lambda g, h: g + h), lambda a, b: a + b).alias("end"), hit.alias("hit"), ok.alias("ok"))
        return F.transform(parts, lambda p: F.struct((p["end"] - p["hit"]).alias("start"), p["end"].alias("end"), p["ok"].alias("ok")))

    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def as_spans(spans: Column, kind: int, ok: bool = True) -> Column:
    chosen = F.filter(spans, lambda s: s["ok"] if ok else ~s["ok"])
    return F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def shown(spans: Column) -> Column:
    """kind:start:end, by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, its base spans and its weak spans."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    value = F.regexp_extract_all(text, F.lit(KEY), F.lit(2))
    rows = rows.withColumn("assign", found(text, KEY, lambda _: F.transform(value, lambda v: F.length(v) >= MIN_ASSIGN)))
    rows = rows.withColumn("short", F.transform(value, lambda v: F.length(v) >= MIN_SHORT))
    short = F.zip_with("assign", "short", lambda s, long: F.struct(s["start"].alias("start"), s["end"].alias("end"), (~s["ok"] & long).alias("ok")))
    base = F.concat(as_spans(F.col("assign"), 0), as_spans(found(text, ACCESS), 1), as_spans(found(text, HEX), 2))
    weak = F.concat(as_spans(found(text, IDENTIFIER), 3), as_spans(short, 4), as_spans(found(text, ENDPOINT), 5))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), base.alias("base"), weak.alias("weak"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of ``rows`` that have a complementary part in scope: (doc_id, text_hash, linked)."""
    rows = rows.where(F.size("weak") > 0).groupBy("doc_id", "text_hash").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    parts = rows.select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("p"))
    secret = F.col("p.kind").isin(0, 2, 4)
    parts = parts.select(F.struct("doc_id", "text_hash").alias("of"), "p", secret.alias("secret"), (F.col("p.kind") == 5).alias("endpoint"))
    near = F.sequence(F.floor((F.greatest(F.col("p.start") - scope, F.lit(0))) / scope), F.floor((F.col("p.end") + scope) / scope))
    left = parts.where("p.kind >= 3").withColumn("bin", F.explode(near)).alias("l")
    own = F.sequence(F.floor(F.col("p.start") / scope), F.floor(F.col("p.end") / scope))
    right = parts.withColumn("bin", F.explode(own)).alias("r")
    in_scope = (F.col("r.p.start") <= F.col("l.p.end") + scope) & (F.col("l.p.start") <= F.col("r.p.end") + scope)
    complementary = F.col("l.secret") != F.col("r.secret")
    pairs = left.join(right, (F.col("l.of") == F.col("r.of")) & (F.col("l.bin") == F.col("r.bin")) & in_scope & complementary)
    spans = pairs.select("l.of.doc_id", "l.of.text_hash", F.col("l.p").alias("p")).distinct()
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_list("p").alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its counts, the digest of its base spans, and all spans."""
    rows = with_links(docs, scope)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select("doc_id", *map(number, range(3)), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def with_links(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, base, spans) per row; spans are the base and the linked weak ones."""
    rows = materialize(candidates(docs), "secret-candidates")
    links = linked(rows, scope)
    same = rows["doc_id"].eqNullSafe(links["doc_id"]) & (rows["text_hash"] == links["text_hash"])
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked"))
    return rows.join(links, same, "left").select(rows["doc_id"], rows["text_hash"], "base", spans.alias("spans"))


def mask(docs: DataFrame, scope: int = SCOPE, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``by``; ``n_chars``, if there, follows the new text."""
    spans = with_links(docs, scope).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name of docs clashes
    text = F.col("row.text").cast("string")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    masked = F.when(F.col("spans").isNull(), text).otherwise(without(text, F.col("spans"), by))
    out = whole.join(spans, same, "left").select("row", F.col("spans").isNotNull().alias("hit"), masked.alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without(text: Column, spans: Column, by: str) -> Column:
    """``text`` with every span replaced by ``by``; of overlapping spans only the first is.

    The text is cut into blocks once, and each group of spans takes its pieces from the blocks around it, so time grows with the text and the spans.
    """

    def part(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(near, start - first * BLOCK + 1, end - start)

    def joined(both: Column) -> Column:
        blocks, ordered = both["blocks"], both["spans"]
        after = F.concat(F.array(F.lit(0)), scanned(ordered["end"], F.greatest))  # where the text goes on behind each span and all before it
        cuts = F.arrays_zip(F.slice(after, 1, F.size(ordered)).alias("at"), ordered["start"].alias("start"))

        def of_group(cuts: Column, k: Column) -> Column:
            own = F.slice(cuts, k * GROUP + 1, GROUP)
            base = own[0]["at"]
            segment = part(blocks, base, F.greatest(base, F.array_max(own["start"])))
            pieces = lambda near: F.transform(own, lambda c: F.when(c["start"] >= c["at"], F.concat(F.substring(near, c["at"] - base + 1, c["start"] - c["at"]), F.lit(by))).otherwise(F.lit("")))
            return let(segment, lambda near: F.array_join(pieces(near), ""))

        groups = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / GROUP).cast("int"))
        pieces = let(cuts, lambda c: F.array_join(F.transform(groups, lambda k: of_group(c, k)), ""))
        last = F.array_max(ordered["end"])
        return F.concat(pieces, part(blocks, last, F.greatest(last, F.length(text))))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), F.array_sort(spans).alias("spans")), joined)


def _matches_sql(kind: int, pattern: str, group: int = 0) -> str:
    """Rows (rid, kind, start, end, value) of all matches; places add up as in ``found``."""
    quoted = pattern.replace("'", "''")
    lengths = "list_sum(list_transform({}, lambda x: length(x)))"
    start = f"coalesce({lengths.format('gaps[1:i]')}, 0) + coalesce({lengths.format('hits[1:i - 1]')}, 0)"
    return f"""select rid, {kind} as kind, ({start})::int as "start", ({start} + length(hits[i]))::int as "end", vals[i] as value
      from (select rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) as i from (select rid, regexp_extract_all(t, '{quoted}') as hits,
        regexp_extract_all(t, '{quoted}', {group}) as vals, string_split_regex(t, '{quoted}') as gaps from docs) where len(hits) > 0)"""


def sql(scope: int = SCOPE) -> str:
    """The rows of ``scan`` over the table documents, for DuckDB."""
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"{names}[kind + 1] || ':' || \"start\" || ':' || \"end\""
    listed = f"coalesce(string_agg({text}, ',' order by \"start\", kind, \"end\"), '')"
    count = ", ".join(f"count_if(kind = {k}) as n_{KINDS[k]}" for k in range(3))
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
      keyed as ({_matches_sql(0, KEY, 2)}),
      base as (select * from keyed where length(value) >= {MIN_ASSIGN} union all {_matches_sql(1, ACCESS)} union all {_matches_sql(2, HEX)}),
      weak as (select rid, 4 as kind, "start", "end", value from keyed where length(value) >= {MIN_SHORT} and length(value) < {MIN_ASSIGN}
        union all {_matches_sql(3, IDENTIFIER)} union all {_matches_sql(5, ENDPOINT)}),
      parts as (select * from base union all select * from weak),
      linked as (select * from weak w where exists (select 1 from parts p where p.rid = w.rid and (p.kind in (0, 2, 4)) <> (w.kind in (0, 2, 4))
        and p."start" <= w."end" + {scope} and w."start" <= p."end" + {scope})),
      b as (select rid, {count}, {listed} as base from base group by rid),
      s as (select rid, {listed} as spans from (select * from base union all select * from linked) group by rid)
      select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
      from docs left join b using (rid) left join s using (rid)"""
