"""Agreement of two raters, and sampling of items to rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.functions.text import normalize_label, overlap, seeded_rank
from quillon.sources.store import stored

MAX_DONORS = 4096
SAMPLED = 64
SCOPES = "(human, judge), (kind, human, judge), (source, human, judge), (kind, source, human, judge)"


def rate_items(sheet: DataFrame, key: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ratings, problems) of a label sheet (item_id, human) and its key (item_id, kind, source, judge).

    Every row of either side ends in one of the two: unknown, missing and repeated items, absent and unknown labels.
    """
    counted = sheet.groupBy("item_id").agg(F.first("human").alias("human"), F.count("*").alias("_n"))
    both = counted.join(key, "item_id", "full").withColumn("human", normalize_label(F.col("human")))
    problem = (
        F.when(F.col("judge").isNull(), "unknown_item").when(F.col("_n").isNull(), "missing_item").when(F.col("_n") > 1, "repeated_item")
        .when(F.coalesce(F.col("human"), F.lit("")) == "", "no_label").when(~F.col("human").isin(allowed), "unknown_label")
    )
    both = both.withColumn("rule", problem)
    return both.where("rule is null").select("item_id", "kind", "source", "human", "judge"), both.where("rule is not null").select("item_id", "rule")


def confusion(ratings: DataFrame, labels: list[str]) -> DataFrame:
    """One row per human label, one column per judge label, and a total."""
    wide = ratings.groupBy("human").pivot("judge", labels).count().na.fill(0)
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0))
    return wide.withColumn("total", total)


def agreement_scopes(ratings: DataFrame) -> DataFrame:
    """(scope, kind, source, n, agreed, kappa, undefined): pooled, by kind, by source and by both, in one pass.

    Ratings are first counted per (kind, source, human, judge), a handful of rows; kappa is exact on whole numbers
    until its one division, and undefined where both raters gave one and the same label.
    """
    cells = ratings.groupBy("kind", "source", "human", "judge").agg(F.count("*").alias("c"))
    cells.createOrReplaceTempView("quillon_rating_cells")
    by = cells.sparkSession.sql(
        f"select grouping(kind) * 2 + grouping(source) as g, kind, source, human, judge, sum(c) as c from quillon_rating_cells group by grouping sets ({SCOPES})"
    )
    cells.sparkSession.catalog.dropTempView("quillon_rating_cells")
    scope = ["g", "kind", "source"]
    human = by.groupBy(*scope, F.col("human").alias("label")).agg(F.sum("c").alias("r"))
    judge = by.groupBy(*scope, F.col("judge").alias("label")).agg(F.sum("c").alias("j"))
    same = [human[c].eqNullSafe(judge[c]) for c in scope] + [human["label"] == judge["label"]]
    chance = human.join(judge, same).select(*[human[c] for c in scope], (F.col("r") * F.col("j")).alias("p")).groupBy(*scope).agg(F.sum("p").alias("chance"))
    total = by.groupBy(*scope).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("human") == F.col("judge"), F.col("c")).otherwise(0)).alias("agreed"))
    rows = total.alias("t").join(chance.alias("e"), [F.col(f"t.{c}").eqNullSafe(F.col(f"e.{c}")) for c in scope], "left")
    n, e = F.col("n"), F.coalesce(F.col("chance"), F.lit(0))
    undefined = e == n * n
    kappa = F.when(~undefined, (F.col("agreed") * n - e) / (n * n - e))
    name = F.element_at(F.array(F.lit("kind_source"), F.lit("kind"), F.lit("source"), F.lit("pooled")), F.col("t.g").cast("int") + 1)
    return rows.select(name.alias("scope"), "t.kind", "t.source", "n", "agreed", kappa.alias("kappa"), undefined.alias("undefined"))


def fair_share(items: DataFrame, strata: list[str], n: int, rank: Column, order: list[str] | None = None) -> DataFrame:
    """``n`` items over the strata as evenly as they allow, the remainder to the first strata; ``rank`` orders a stratum.

    The round of an item is its place within its stratum; rounds are filled one after the other.
    """
    inner = items.withColumn("_rank", rank).withColumn("_round", F.row_number().over(Window.partitionBy(*strata).orderBy("_rank")))
    cut = inner.where(F.col("_round") <= n)  # no stratum gives more; what is left is bounded by strata times n
    turn = Window.orderBy("_round", *(order or strata))
    return cut.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).drop("_rank", "_round", "_turn")


def judge_sample(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """Verdicts share ``n`` fairly, then configs within a verdict; hash order; items numbered a01, a02, ..."""
    key = F.concat_ws("|", "config", "question_id", "item")
    chosen = fair_share(candidates, ["verdict", "config"], n, seeded_rank(seed, "item", key), ["verdict", "config"])
    place = F.row_number().over(Window.orderBy(seeded_rank(seed, "id", key)))
    return chosen.withColumn("item_id", F.concat(F.lit("a"), F.lpad(place.cast("string"), 2, "0")))


def calibration(claims: DataFrame) -> DataFrame:
    """(bucket, n, supported_rate) of claims (confidence, supported)."""
    c = F.col("confidence")
    bucket = F.when(c < 0.5, "low").when(c <= 0.8, "mid").otherwise("high")
    return claims.where(c.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("supported").cast("double")).alias("supported_rate"))


def too_alike(donors: DataFrame, sources: DataFrame, max_overlap: float) -> DataFrame:
    """(donor, source_name): donors (donor, words) that share more than ``max_overlap`` of their words with a source (source_name, source_words).

    A pair that shares more than m of a donor's k words shares one of its k - m rarest: only these are joined to the sources' words,
    and only the pairs that meet there are counted in full.
    """
    size = F.size("words")
    spread = sources.select("source_name", F.explode("source_words").alias("word"))
    rarity = spread.groupBy("word").agg(F.count("*").alias("n"))
    ranked = donors.select("donor", (size - F.floor(size * max_overlap + 1e-9)).alias("prefix"), F.explode("words").alias("word")).join(rarity, "word", "left")
    place = F.row_number().over(Window.partitionBy("donor").orderBy(F.coalesce("n", F.lit(0)), "word"))
    rare = ranked.withColumn("place", place).where("place <= prefix").select("donor", "word")
    met = rare.join(spread, "word").select("donor", "source_name").distinct()
    both = met.join(donors.select("donor", "words"), "donor").join(sources.select("source_name", "source_words"), "source_name")
    return both.where(F.size(F.array_intersect("words", "source_words")) / size > max_overlap).select("donor", "source_name")


def named_sources(sources: DataFrame) -> DataFrame:
    """Distinct sources with their name and a number, written once."""
    named = sources.withColumn("source_name", F.concat_ws("|", "source_question", "source")).dropDuplicates(["source_name"])
    return stored(named.withColumn("source_no", F.monotonically_increasing_id()), "control-sources")


def fitting_pairs(donors: list[Row], bounds: dict[int, str], given: DataFrame, sources: DataFrame, seed: int, max_overlap: float, depth: int) -> DataFrame:
    """(donor_no, source_question, first (k, source_no, overlap), place): each donor's first ``depth`` questions with a fitting source, in its order.

    A task hashes each of its sources for every donor and goes on with those up to the donor's bound, if it has one; only fitting ones are shuffled, without their texts.
    """
    question = given.schema["question_id"].dataType
    every = F.array(*[F.struct(F.lit(no).alias("donor_no"), F.lit(d["donor"]).alias("donor"), F.lit(d["question_id"]).cast(question).alias("question_id"), F.lit(bounds.get(no)).cast("string").alias("bound")) for no, d in enumerate(donors)])
    pairs = sources.select("source_question", "source_sections", "source_words", "source_name", "source_no", F.explode(every).alias("d")).where("d.question_id <> source_question")
    key = seeded_rank(seed, F.concat(F.lit("control-sources:"), "d.donor"), F.col("source_name"))
    pairs = pairs.withColumn("k", key).where(F.col("d.bound").isNull() | (F.col("k") <= F.col("d.bound"))).withColumn("donor_no", F.col("d.donor_no")).drop("d", "source_name")
    both = pairs.join(F.broadcast(given.select("donor_no", "sections", "words")), "donor_no")
    both = both.withColumn("overlap", F.coalesce(overlap(F.col("words"), F.col("source_words")), F.lit(0.0)))
    fit = both.where(~F.coalesce(F.arrays_overlap("sections", "source_sections"), F.lit(False)) & (F.col("overlap") <= max_overlap))
    first = fit.groupBy("donor_no", "source_question").agg(F.min(F.struct("k", "source_no", "overlap")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("donor_no").orderBy("first"))).where(F.col("place") <= depth)


def fitting_sources(donors: list[Row], queue: DataFrame, sources: DataFrame, seed: int, max_overlap: float, depth: int) -> DataFrame:
    """(donor, place, source_question, source, overlap): for each of a stated set of donors the first ``depth`` questions with a fitting source, in
    the donor's own seeded order; of each question the first source.

    The order needs a hash of every donor and source. A donor's ``depth``-th place among one of ``SAMPLED`` questions bounds its true one, so of the
    other pairs only about ``SAMPLED * depth`` a donor are looked at, whatever the number of sources; a donor with fewer places there has no bound.
    """
    spark, named = queue.sparkSession, sources if "source_no" in sources.columns else named_sources(sources)
    given = spark.createDataFrame([(no, *d) for no, d in enumerate(donors)], StructType([StructField("donor_no", IntegerType()), *queue.schema]))
    some = named.where(F.pmod(F.xxhash64("source_question"), F.lit(SAMPLED)) == 0)
    last = fitting_pairs(donors, {}, given, some, seed, max_overlap, depth).where(F.col("place") == depth)
    bounds = {r["donor_no"]: r["k"] for r in last.select("donor_no", "first.k").collect()}
    ranked = fitting_pairs(donors, bounds, given, named, seed, max_overlap, depth).select("donor_no", "place", "source_question", "first.source_no", "first.overlap")
    texts = ranked.join(named.select("source_no", "source"), "source_no").join(F.broadcast(given.select("donor_no", "donor")), "donor_no")
    return texts.select("donor", "place", "source_question", "source", "overlap")


def control_donors(claims: DataFrame, seed: int) -> DataFrame:
    """Claims with their name and seeded place, which is the order in which they are tried."""
    named = claims.withColumn("donor", F.concat_ws("|", "question_id", "claim")).dropDuplicates(["donor"])
    return named.withColumn("_k", seeded_rank(seed, "control-claim", F.col("donor")))


def negative_controls(claims: DataFrame, sources: DataFrame, n: int, seed: int, max_overlap: float) -> DataFrame:
    """``n`` claims paired with sources of another question (fewer if there are no more), no question used twice.

    claims: question_id, sections, words, claim; sources: source_question, source_sections, source_words, source. Claims are tried in
    seeded order, each with the sources in an order of its own; the first source with other sections that shares at most
    ``max_overlap`` of the claim's words is taken (a claim without words shares none). The first ``8 * n`` claims are looked at together; at most
    ``2 * n`` questions are used up, so one more fitting question for each claim decides. Only if they do not suffice, the next claims
    follow, eight times as many each time but at most ``MAX_DONORS``.
    """
    queue, named, made, used, last, block = control_donors(claims, seed), named_sources(sources), [], set(), None, 8 * n
    while len(made) < n:
        rest = queue if last is None else queue.where(F.struct("_k", "donor") > F.struct(F.lit(last[0]), F.lit(last[1])))
        donors = rest.orderBy("_k", "donor").limit(min(block, MAX_DONORS)).collect()
        if not donors:
            break
        last, block = (donors[-1]["_k"], donors[-1]["donor"]), 8 * block
        found: dict[str, list] = {}
        for r in fitting_sources(donors, queue, named, seed, max_overlap, 2 * n + 1).orderBy("donor", "place").collect():
            found.setdefault(r["donor"], []).append(r)
        for d in donors:
            free = [r for r in found.get(d["donor"], []) if r["source_question"] not in used]
            if len(made) < n and d["question_id"] not in used and free:
                made.append((free[0]["source_question"], d["question_id"], d["claim"], free[0]["source"], free[0]["overlap"]))
                used |= {d["question_id"], free[0]["source_question"]}
    kinds = [(c, df.schema[c].dataType.simpleString()) for df, c in ((sources, "source_question"), (claims, "question_id"), (claims, "claim"), (sources, "source"))]
    return claims.sparkSession.createDataFrame(made, ", ".join(f"`{c}` {k}" for c, k in kinds) + ", overlap double")
