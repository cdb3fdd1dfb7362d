"""URL filters: listed rules first, association rules for the rest, with Spark functions only.

Listed rules label the URLs they fit. FP-growth mines combinations of at most ``MAX_ITEMS`` tokens of the labelled URLs; rules
above a support and a confidence, without those that a shorter rule makes redundant, judge the URLs that no listed rule
fits: their tokens meet an inverted index from token to rules, and a rule fires when all its tokens are there. The rule with the
greatest confidence decides (then support, then length; block before allow); without a rule the verdict is allow.

What must not be combined is taken out before mining, so that sites with long templated paths do not multiply: a token whose URLs all
have one verdict is a rule by itself that makes every longer one redundant, tokens that stand in exactly the same labelled URLs are
one item, of which any member counts, and items without a frequent pair are rules by themselves only. If a URL still has more than ``MAX_WIDTH`` items, these are dealt into blocks and FP-growth sees every
triple of blocks apart, which holds every combination of three items.

Null urls, and urls without "://", have an empty host and path and no tokens. Repeated rows stay. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_partitions

# Fixed values: (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
MAX_ITEMS = 3
MAX_WIDTH = 12
REPEAT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, below = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{below}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path words; digits become one sign, so that numbers are one token."""
    words = F.concat(
        F.transform(F.split(host, r"[.:]"), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.split(F.translate(path, UPPER, LOWER), r"[/._~-]+"), lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, r"[0-9]+", "0"))),
    )
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def frequent_tokens(patterns: DataFrame, least: int) -> DataFrame:
    """(token, n, top, alike) of the tokens that ``least`` URLs of one verdict have: number of URLs, the verdict of most of them, and
    what tokens that stand in the same URLs have in common (their number and 128 bits of the sums of the URLs' hashes)."""
    hashes = [F.xxhash64("tokens", "verdict", F.lit(k)).cast("decimal(20,0)").alias(f"h{k}") for k in (1, 2)]
    hits = patterns.select(F.explode("tokens").alias("token"), "verdict", "n", *hashes)
    by = hits.groupBy("token", "verdict").agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    top = F.max(F.struct("n", "verdict")).alias("top")
    by = by.groupBy("token").agg(F.sum("n").alias("n"), top, F.struct(F.sum("n"), F.sum("h1"), F.sum("h2")).alias("alike"))
    return by.where(F.col("top.n") >= least)


def transactions(reduced: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """Rows for FP-growth, one per labelled URL (and triple of blocks): names of items, behind the number of the triple and the verdict."""
    width = reduced.agg(F.max(F.size("items"))).first()[0] or 0
    n_blocks = 1 if width <= max_width else max(3, -(-MAX_ITEMS * width // max_width))
    triples = list(combinations(range(n_blocks), min(MAX_ITEMS, n_blocks)))
    rows = reduced.select("n", "verdict", "items", F.posexplode(F.array(*[F.array(*map(F.lit, t)) for t in triples])).alias("k", "blocks"))
    rows = rows.withColumn("items", F.filter("items", lambda x: F.array_contains("blocks", x["place"] % n_blocks))).where(F.size("items") > 0)
    rows = rows.select("n", F.transform("items", lambda x: F.concat_ws("|", "k", "verdict", x["item"])).alias("items"))
    # A pattern of n URLs is n rows, through two arrays of bounded or slowly growing size.
    rows = rows.select("n", "items", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEAT))).alias("part"))
    size = F.least(F.col("n") - F.col("part") * REPEAT, F.lit(REPEAT)).cast("int")
    return rows.select("items", F.explode(F.array_repeat(F.lit(0), size)).alias("_")).drop("_")


def fired(found: DataFrame, rules: DataFrame, of: list[str]) -> DataFrame:
    """The rules (items, ...) whose items all are among the ``found`` items (*of, item) of a URL, by an inverted index from item to rules."""
    rules = rules.withColumn("n_items", F.size("items"))
    index = rules.select(*[c for c in rules.columns if c != "items"], F.explode("items").alias("item"))
    own = [c for c in index.columns if c != "item"]
    return found.join(index, "item").groupBy(*of, *own).count().where("count = n_items").drop("count")


def with_partners(reduced: DataFrame, least: int) -> DataFrame:
    """``reduced`` (of, verdict, n, items) without the items that stand in no pair of items that ``least`` URLs of one verdict have."""
    pair = F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b"))))
    pairs = reduced.withColumn("items", F.array_sort("items")).select("verdict", "n", F.explode(F.flatten(pair)).alias("pair"))
    pairs = pairs.groupBy("pair", "verdict").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    useful = pairs.select(F.explode(F.array("pair.a", "pair.b")).alias("item")).distinct()
    single = reduced.select("of", "verdict", "n", F.explode("items").alias("x"), F.col("x.item").alias("item"))
    return single.join(useful, "item").groupBy("of", "verdict", "n").agg(F.collect_list("x").alias("items")).where(F.size("items") > 1)


def combinations_of_items(patterns: DataFrame, members: DataFrame, least: int, total: int, min_confidence: float, max_width: int) -> DataFrame | None:
    """(items, verdict, confidence, support) of rules over two items or more.

    FP-growth finds the sets that enough URLs of one verdict hold; the URLs of all verdicts are counted for those that may pass.
    """
    of = F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens")).alias("of")
    found = patterns.select(of, "verdict", "n", F.explode("tokens").alias("token")).join(members, "token")
    reduced = found.groupBy("of", "verdict", "n").agg(F.collect_set(F.struct("item", "place")).alias("items"))
    reduced = materialize(reduced, "url-items")
    rows = materialize(transactions(materialize(with_partners(reduced, least), "url-partners"), max_width), "url-transactions")
    n_rows = rows.count()
    if not n_rows:
        return None
    spread = shuffle_partitions(rows.sparkSession)  # a few rows may still hold many combinations
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n_rows), numPartitions=spread).fit(rows).freqItemsets
    sets = sets.where(F.size("items").between(2, MAX_ITEMS)).withColumn("head", F.regexp_extract(F.get("items", F.lit(0)), r"^[0-9]+\|[^|]*\|", 0))
    names = F.array_sort(F.transform("items", lambda x: F.substring(x, F.length("head") + 1, F.length(x))))
    sets = sets.select(names.alias("items"), F.element_at(F.split("head", r"\|"), 2).alias("verdict"), "freq").distinct()
    known = F.sum("freq").over(Window.partitionBy("items"))
    sets = sets.withColumn("known", known).where(F.col("freq") >= min_confidence * F.col("known"))
    sets = materialize(sets.select("items", "verdict", "freq", F.xxhash64("items", "verdict").alias("rule_id")), "url-sets")
    hits = fired(reduced.select("of", "verdict", "n", F.explode("items.item").alias("item")), sets.select("rule_id", "items"), ["of", "verdict", "n"])
    rules = sets.join(hits.groupBy("rule_id").agg(F.sum("n").alias("n")), "rule_id")
    rules = rules.select("items", "verdict", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / F.lit(total)).alias("support"))
    return rules.where(F.col("confidence") >= min_confidence)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_width: int = MAX_WIDTH) -> tuple[DataFrame, DataFrame]:
    """From (tokens, verdict) rows: the rules (items, verdict, confidence, support, rule_id) and the tokens of each item (token, item).

    All rules of at most ``MAX_ITEMS`` items that pass support and confidence (over one half) and that no shorter rule makes redundant.
    Frequent tokens, and pairs of them, are bounded by the support and the tokens of a URL.
    """
    if min_confidence <= 0.5:
        raise ValueError("min_confidence must be over 0.5: an item is a rule for the verdict of most of its URLs")
    patterns = materialize(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-patterns")
    total = patterns.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(min_support * total))
    frequent = materialize(frequent_tokens(patterns, least), "url-tokens")
    pure = F.col("top.n") == F.col("n")
    classes = frequent.groupBy(F.when(pure, F.col("token")).alias("alone"), "alike", "top").agg(F.min("token").alias("item"), F.max("n").alias("n"), F.collect_set("token").alias("members"))
    place = F.row_number().over(Window.orderBy("n", "item"))  # over the frequent tokens only
    classes = classes.withColumn("place", place)
    members = materialize(classes.select("item", "place", F.col("alone").isNotNull().alias("pure"), F.explode("members").alias("token")), "url-members")
    confidence = F.col("top.n") / F.col("n")
    rules = classes.select(F.array("item").alias("items"), "top.verdict", confidence.alias("confidence"), (F.col("top.n") / F.lit(total)).alias("support"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    mixed = members.where("not pure").select("token", "item", "place")
    several = combinations_of_items(patterns, mixed, least, total, min_confidence, max_width)
    if several is not None:
        rules = materialize(rules.unionByName(several), "url-rules")
        # A rule is redundant if one over a part of its items says the same with no less confidence.
        part = F.expr("transform(sequence(1, shiftleft(1, size(items)) - 2), mask -> filter(items, (x, i) -> shiftright(mask, i) % 2 = 1))")
        parts = rules.where(F.size("items") > 1).select(F.col("items").alias("whole"), "verdict", F.explode(part).alias("items"))
        best = parts.join(rules, ["items", "verdict"]).groupBy(F.col("whole").alias("items"), "verdict").agg(F.max("confidence").alias("best"))
        rules = rules.join(best, ["items", "verdict"], "left").where("best is null or best < confidence").drop("best")
    return rules.withColumn("rule_id", F.xxhash64("items", "verdict")), members.select("token", "item")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("by_list", listed(F.col("host"), F.col("path"), rules)), "urls")
    rows = rows.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    mined, members = mine(rows.where("by_list is not null").select("tokens", "by_list.verdict"), min_support, min_confidence)
    mined = materialize(mined, "mined-rules")
    open_urls = rows.where("by_list is null").select("host", "path", "tokens").dropDuplicates(["host", "path"])
    found = open_urls.select("host", "path", F.explode("tokens").alias("token")).join(members, "token").select("host", "path", "item").distinct()
    hits = fired(found, mined, ["host", "path"])
    rank = F.struct("confidence", "support", -F.col("n_items"), F.col("verdict") == "block", "rule_id")
    chosen = hits.groupBy("host", "path").agg(F.max_by("verdict", rank).alias("mined"))
    verdict = F.coalesce("by_list.verdict", "mined", F.lit("allow"))
    return rows.join(chosen, ["host", "path"], "left").select("page_id", "host", "path", F.col("by_list.rule").alias("rule"), verdict.alias("verdict"))
