"""Retrieval over many questions and many chunks: dense, lexical, fused, reranked; and context building.

A ranked result has one row per (question_id, chunk_id). Cuts are ``row_number() <= k``, which Spark turns into a limit
within each task before the shuffle. Wide chunk fields are joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import cosine_distance, rrf_credit
from quillon.functions.text import analyze, escape_attribute, escape_content
from quillon.sources.store import stored

#: Up to so many pairs are joined as rows; beyond, blocks of so many questions and chunks meet, and a product takes so many questions at once.
JOINED_PAIRS = 5_000_000
QUESTION_BLOCK, CHUNK_BLOCK, QUESTIONS_AT_ONCE, MAX_TASKS = 4_096, 16_384, 256, 2_000
#: Products of vectors up to this norm do not overflow.
MAX_NORM = 1e150
#: Vectors of up to so many components have a column for each; wider ones keep the general product of arrays.
MAX_COLUMNS = 64
WEIGHT_HEADING, WEIGHT_BODY = 1.0, 0.4
POSTING_BLOCK = 1 << 16
CHUNKS_PER_TASK = 2_000
MAX_BROADCAST_LEVELS = 500_000


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")


def top(df: DataFrame, k: int, rank: str, *order: Column | str, by: str = "question_id") -> DataFrame:
    """The first ``k`` rows of each question with their 1-based ``rank``."""
    check_k(k)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def active_chunks(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the one active version; the version row (one at most) is broadcast, which prunes partitions."""
    active = versions.where("is_active").select("index_version_id").limit(1)
    return chunks.join(F.broadcast(active), "index_version_id")


def of_version(chunks: DataFrame, version_id: int) -> DataFrame:
    """The chunks of exactly one version; a column of partitions prunes the scan."""
    return chunks.where(F.col("index_version_id") == version_id)


def whole(v: Column, width: int) -> Column:
    """True for a vector of ``width`` components without nulls."""
    return F.coalesce((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))


class Side(NamedTuple):
    """One side of the pairs: rows with their components as columns of doubles (an array beyond ``MAX_COLUMNS``), and whether they are all there."""

    rows: DataFrame
    tag: str
    width: int

    @classmethod
    def of(cls, df: DataFrame, key: str, tag: str, width: int) -> Side:
        e = F.col("embedding")
        # A missing component is NaN, so that no column is nullable and the product is straight code; ``_whole`` tells it from a given NaN.
        parts = [e.alias(f"_{tag}")] if width > MAX_COLUMNS else [F.coalesce(F.get(e, F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"_{tag}{i}") for i in range(width)]
        return cls(df.select(key, whole(e, width).alias(f"_whole_{tag}"), *parts), tag, width)


def pair_distance(a: Side, b: Side) -> Column:
    """1 - inner product, summed in the order of the components; NaN or null where a component is missing."""
    if a.width > MAX_COLUMNS:
        return cosine_distance(F.col(f"_{a.tag}"), F.col(f"_{b.tag}"))
    return F.expr(f"1.0D - ({' + '.join(['0.0D', *(f'_{a.tag}{i} * _{b.tag}{i}' for i in range(a.width))])})")


def pairs(questions: Side, chunks: Side, within: bool = False) -> DataFrame:
    """question_id, chunk_id, distance of all pairs, or of those not beyond their question's (_bound, _last). The questions are broadcast."""
    at = pair_distance(chunks, questions)
    bound = F.col("_bound")
    near = F.isnan(bound) | (at < bound) | ((at == bound) & F.coalesce(F.col("chunk_id") <= F.col("_last"), F.lit(True)))
    found = chunks.rows.join(F.broadcast(questions.rows), near if within else F.lit(True), "inner")
    return found.select("question_id", "chunk_id", F.when(F.col(f"_whole_{chunks.tag}") & F.col(f"_whole_{questions.tag}"), at).alias("distance"))


def nearest(questions: Side, chunks: Side, k: int, within: bool = False) -> DataFrame:
    return top(pairs(questions, chunks, within), k, "dense_rank", F.asc_nulls_last("distance"), "chunk_id")


def matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a block in double precision, zeros where there is none; which are given; their norms."""
    vectors = table["embedding"].combine_chunks()
    given = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(given), width))
    rows[given] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return rows, given, np.sqrt(np.einsum("ij,ij->i", rows, rows))


def nearest_of_blocks(questions: pa.Table, chunks: pa.Table, k: int, width: int) -> pa.Table:
    """question_id, chunk_id, distance: each question's exact top ``k`` of a block of chunks. A vector that is not whole is null.

    A matrix product gives scores with a bound of their error. The k-th best among a part of the chunks bounds the block's k-th one; only pairs that may reach it are
    summed again, in the order of the components, and sorted. Vectors too large for the bound meet everything; of equal vectors, absent ones
    and those with NaN, the first ``k`` are enough.
    """
    chunks = chunks.take(pc.sort_indices(chunks.select(["chunk_id"]), sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
    with np.errstate(all="ignore"):
        (q, q_given, q_norm), (c, c_given, c_norm) = matrix(questions, width), matrix(chunks, width)
        kinds = 2 * np.unique(c.view(f"V{8 * width}").ravel(), return_inverse=True)[1] + c_given
        few = (pd.Series(kinds).groupby(kinds).cumcount() < k).to_numpy()
        chunks, c, c_given, c_norm = chunks.filter(pa.array(few)), c[few], c_given[few], c_norm[few]
        q_alike, c_nan = ~q_given | np.isnan(q).any(1), np.isnan(c).any(1)
        q_plain, c_plain = q_given & (q_norm <= MAX_NORM), np.flatnonzero(c_given & (c_norm <= MAX_NORM))
        absent = np.flatnonzero(~c_given)[:k]
        rest = np.concatenate([absent, np.flatnonzero(c_nan)[:k], np.flatnonzero(c_given & ~c_nan & ~(c_norm <= MAX_NORM))])
        alike = np.concatenate([absent, np.flatnonzero(c_given)[:k]])
        error = (width + 8) * 2.0**-51
        wide = np.vstack([c[c_plain].T, c_norm[c_plain]])
        step = max(1, int((len(c_plain) / (30 * k)) ** 0.5))
        q_parts, c_parts, found = q.T.copy(), c.T.copy(), []
        plain, odd = np.flatnonzero(q_plain), np.flatnonzero(~q_plain)
        for group in [*(plain[i : i + QUESTIONS_AT_ONCE] for i in range(0, len(plain), QUESTIONS_AT_ONCE)), *odd.reshape(-1, 1)]:
            if q_plain[group[0]]:
                most = np.column_stack([q[group], error * q_norm[group]]) @ wide
                least = most[:, ::step] - np.outer(2 * error * q_norm[group], wide[-1, ::step])
                bound = np.partition(least, -k, axis=1)[:, -k] - 1e-15 if least.shape[1] >= k else np.full(len(group), -np.inf)
                i, j = np.nonzero(most >= bound[:, None])
                at_q, at_c = np.concatenate([group[i], np.repeat(group, len(rest))]), np.concatenate([c_plain[j], np.tile(rest, len(group))])
            else:
                at_c = alike if q_alike[group[0]] else np.arange(len(c))
                at_q = np.repeat(group, len(at_c))
            total = np.zeros(len(at_q))
            for q_part, c_part in zip(q_parts, c_parts, strict=True):
                total += c_part[at_c] * q_part[at_q]
            null = ~(q_given[at_q] & c_given[at_c])
            distance = np.where(null, 0.0, 1.0 - total)
            order = np.lexsort((at_c, distance, null, at_q))
            asked = at_q[order]
            order = order[np.arange(len(asked)) - np.searchsorted(asked, asked) < k]
            found.append((at_q[order], at_c[order], distance[order], null[order]))
    at_q, at_c, distance, null = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
    return pa.table({"question_id": questions["question_id"].take(pa.array(at_q)), "chunk_id": chunks["chunk_id"].take(pa.array(at_c)), "distance": pa.array(distance, mask=null)})


def block_search(questions: DataFrame, chunks: DataFrame, k: int, n_questions: int, n_chunks: int, width: int) -> DataFrame:
    """``dense_search`` by matrix products: every block of questions meets every block of chunks in a group of its own, whose size is bounded."""
    n_q, n_c = -(-n_questions // QUESTION_BLOCK), -(-n_chunks // CHUNK_BLOCK)
    tasks = min(2 * n_q * n_c, MAX_TASKS)

    def blocks(df: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        e, kind = F.col("embedding"), df.schema["embedding"].dataType.elementType.typeName()
        vector = F.when(whole(e, width), e if kind in ("float", "double") else e.cast("array<double>"))
        rows = df.select(key, vector.alias("embedding"), F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int").alias(own[0]))
        return rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)))).repartition(tasks, "_q", "_c").groupBy("_q", "_c")

    def best(asked: pa.Table, block: pa.Table) -> pa.Table:
        return nearest_of_blocks(asked, block, k, width)

    kinds = {**dict(questions.dtypes), **dict(chunks.dtypes)}
    asked, all_chunks = blocks(questions, "question_id", ("_q", n_q), ("_c", n_c)), blocks(chunks, "chunk_id", ("_c", n_c), ("_q", n_q))
    found = asked.cogroup(all_chunks).applyInArrow(best, f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, distance double")
    return top(found, k, "dense_rank", F.asc_nulls_last("distance"), "chunk_id")


def dense_search(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` by cosine distance, ties by chunk_id, null distances last: question_id, chunk_id, distance, dense_rank.

    Up to ``JOINED_PAIRS`` pairs are joined: the questions are broadcast and the chunks stream past them; the k-th place among about sqrt(k * n) of the n chunks
    bounds the true one from above, so only pairs that are not beyond it are put in order. More pairs meet block by block as matrix products.
    """
    check_k(k)
    size = questions.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n_chunks, width = chunks.count(), max(size["width"] or 0, 1)
    if size["n"] * n_chunks > JOINED_PAIRS:
        return block_search(questions, chunks, k, size["n"], n_chunks, width)
    step = int((n_chunks / k) ** 0.5)
    asked, all_chunks = Side.of(questions, "question_id", "q", width), Side.of(chunks, "chunk_id", "c", width)
    if step <= 1:
        return nearest(asked, all_chunks, k)
    some = Side.of(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(step)) == 0), "chunk_id", "c", width)
    last = nearest(asked, some, k).where(F.col("dense_rank") == k).select("question_id", F.col("distance").alias("_bound"), F.col("chunk_id").alias("_last"))
    bounded = asked.rows.join(last, "question_id", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("nan"))))
    return nearest(asked._replace(rows=bounded), all_chunks, k, within=True)


def mean_distances(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, n, mean_distance over all pairs with all chunks: as the inner product is linear, it is taken with the mean of the chunks."""
    given = F.col("embedding").isNotNull()
    means = chunks.where(given).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_mean"))
    n = chunks.agg(F.count("*").alias("_n")).where("_n > 0")
    rows = questions.join(F.broadcast(n), F.lit(True)).join(F.broadcast(mean), F.lit(True))
    at = F.when(F.size("_mean") > 0, cosine_distance(F.col("embedding"), F.col("_mean")))
    return rows.groupBy("question_id").agg(F.sum("_n").alias("n"), F.avg(at).alias("mean_distance"))


def counting_tasks(chunks: DataFrame) -> int:
    return -(-max(chunks.count(), 1) // CHUNKS_PER_TASK)


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, hits_a (heading), hits_b (body)."""
    fields = F.array(
        F.struct(F.lit(1).alias("a"), analyze(F.coalesce("heading", F.lit(""))).alias("terms")),
        F.struct(F.lit(0).alias("a"), analyze(F.coalesce("body", F.lit(""))).alias("terms")),
    )
    # Chunks are dealt out before their terms are counted, so texts are shuffled instead of postings, and a task counts a bounded number of chunks.
    dealt = chunks.repartition(counting_tasks(chunks), "chunk_id")
    hits = dealt.select("chunk_id", F.explode(fields).alias("f")).select("chunk_id", "f.a", F.explode("f.terms").alias("term"))
    return hits.groupBy("term", "chunk_id").agg(F.sum("a").alias("hits_a"), F.sum(1 - F.col("a")).alias("hits_b"))


class LexicalIndex(NamedTuple):
    """``rows``: the postings with hit (their weight); ``levels``: term, hit, n, the number of postings of a term with that hit.

    A search reads no more than these. ``lexical_index`` also names parts: the postings of a term and hit are dealt into parts of about ``POSTING_BLOCK`` by a hash of the chunk, so a hot term stands in many blocks, whose
    greatest hit is known without reading them.
    """

    rows: DataFrame
    levels: DataFrame


def weighted(found: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, hits_a, hits_b) with their weight, hit."""
    return found.withColumn("hit", F.round(F.col("hits_a") * WEIGHT_HEADING + F.col("hits_b") * WEIGHT_BODY, 9))


def levels_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "hit").agg(F.count("*").alias("n"))


def lexical_index(found: DataFrame, block: int = POSTING_BLOCK) -> LexicalIndex:
    """The index of postings (term, chunk_id, hits_a, hits_b). Nothing is sorted or gathered by term: counts say how many parts there are."""
    rows = weighted(found)
    levels = levels_of(rows)
    parts = levels.where(F.col("n") > block).select("term", "hit", F.ceil(F.col("n") / block).alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    # Each of these levels has more than ``block`` postings, so there are few of them.
    return LexicalIndex(rows.join(F.broadcast(parts), ["term", "hit"], "left").withColumn("part", part.cast("int")).drop("parts"), levels)


def matched(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """The postings of the levels (question_id, term, hit) of a written table; up to ``MAX_BROADCAST_LEVELS`` of them are broadcast, so
    the index is not shuffled and the hits of a chunk, whose rows stand side by side, are summed where they are read."""
    few = asked.count() <= MAX_BROADCAST_LEVELS
    return index.rows.select("term", "hit", "chunk_id").join(F.broadcast(asked) if few else asked, ["term", "hit"])


def needed_levels(terms: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """(question_id, term, hit) of the postings that the top ``k`` of each question may need, of terms (question_id, term).

    The highest postings of each term, ``k`` at least, give a k-th score that the true one does not fall below. A posting whose hit, with the highest
    hits of the question's other terms, stays below it belongs to no chunk of the top ``k``: its level is left out.
    """
    down = Window.partitionBy("term").orderBy(F.desc("hit"))
    own = index.levels.join(terms.select("term").distinct(), "term")
    own = own.withColumn("before", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("best", F.max("hit").over(Window.partitionBy("term")))
    asked = terms.join(own, "term").select("question_id", "term", "hit", "before", "best")
    first = matched(stored(asked.where(F.col("before") < k).select("question_id", "term", "hit"), "first-levels"), index)
    seen = first.groupBy("question_id", "chunk_id").agg(F.sum("hit").alias("score"))
    floor = top(seen, k, "_rank", F.desc("score"), "chunk_id").where(F.col("_rank") == k).select("question_id", F.col("score").alias("floor"))
    tops = asked.where("before = 0").groupBy("question_id").agg(F.sum("best").alias("tops"))
    bound = F.col("hit") + F.col("tops") - F.col("best")
    kept = asked.join(tops, "question_id").join(floor, "question_id", "left")
    return kept.where(F.col("floor").isNull() | (bound >= F.col("floor") - 1e-6)).select("question_id", "term", "hit")


def lexical_search(questions: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Chunks with at least one question term, top ``k`` by weighted hits, ties by chunk_id.

    A question of stop words only has no rows. Terms are made distinct before the join, so a posting counts once. Levels of postings that no chunk of
    the top ``k`` can be in are not read.
    """
    check_k(k)
    terms = questions.select("question_id", F.explode(F.array_distinct(analyze(F.col("question")))).alias("term"))
    needed = stored(needed_levels(terms, index, k), "needed-levels")
    scored = matched(needed, index).groupBy("question_id", "chunk_id").agg(F.round(F.sum("hit"), 9).alias("fts_score"))
    return top(scored, k, "fts_rank", F.desc("fts_score"), "chunk_id")


def fuse(dense: DataFrame, lexical: DataFrame, k_fused: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two cut lists; every signal is kept, an absent one is null."""
    lists = dense.join(lexical, ["question_id", "chunk_id"], "full")
    score = rrf_credit(F.col("dense_rank"), rrf_k) + rrf_credit(F.col("fts_rank"), rrf_k)
    return top(lists.withColumn("rrf_score", score), k_fused, "fused_rank", F.desc("rrf_score"), "chunk_id")


def hybrid_search(questions: DataFrame, chunks: DataFrame, index: LexicalIndex, k_dense: int = 20, k_fts: int = 20, k_fused: int = 40, rrf_k: int = 60) -> DataFrame:
    return fuse(dense_search(questions, chunks, k_dense), lexical_search(questions, index, k_fts), k_fused, rrf_k)


def rerank(candidates: DataFrame, scores: DataFrame, top_n: int, rank: str = "fused_rank") -> DataFrame:
    """Reorder by score, ties in input order. A question without a full set of scores keeps its order, with a code."""
    joined = candidates.join(scores, ["question_id", "chunk_id"], "left")
    whole = Window.partitionBy("question_id")
    degraded = F.count("rerank_score").over(whole) < F.count(F.lit(1)).over(whole)
    joined = joined.withColumn("rerank_error", F.when(degraded, F.lit("missing_scores")))
    score = F.when(F.col("rerank_error").isNull(), F.col("rerank_score"))
    joined = joined.withColumn("rerank_score", score)
    return top(joined, top_n, "final_rank", F.desc_nulls_last("rerank_score"), rank)


#: The rank column of each mode's result.
RANKS = {"dense": "dense_rank", "fts": "fts_rank", "hybrid": "fused_rank", "hybrid_rerank": "final_rank"}


def search(mode: str, questions: DataFrame, chunks: DataFrame, index: LexicalIndex, k: int = 20, k_fused: int = 40, score: Callable[[DataFrame], DataFrame] | None = None, top_n: int = 10) -> DataFrame:
    """The ranked candidates of a retrieval mode. ``score`` gives (question_id, chunk_id, rerank_score) of the fused candidates; scores
    that are no permutation of them, or out of range, leave the question's order alone."""
    if mode not in RANKS:
        raise ValueError(f"unknown retrieval mode {mode!r}: one of {', '.join(RANKS)}")
    if mode == "dense":
        return dense_search(questions, chunks, k)
    if mode == "fts":
        return lexical_search(questions, index, k)
    found = hybrid_search(questions, chunks, index, k, k, k_fused)
    if mode == "hybrid":
        return found
    if score is None:
        raise ValueError("hybrid_rerank needs scores")
    found = stored(found, "fused")
    given = score(found)
    bad = rerank_problems(found, given).where("rule <> 'missing'").select("question_id").distinct()
    return rerank(found, given.join(bad, "question_id", "left_anti"), top_n)


def rerank_problems(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(question_id, rule, n): scores out of [0, 1], missing, repeated or unknown."""
    bad = scores.where(~F.col("rerank_score").between(0, 1) | F.isnan("rerank_score") | F.col("rerank_score").isNull())
    keys = ["question_id", "chunk_id"]
    rules = {
        "out_of_range": bad,
        "missing": candidates.join(scores, keys, "left_anti"),
        "unknown": scores.join(candidates, keys, "left_anti"),
        "repeated": scores.groupBy(*keys).count().where("count > 1"),
    }
    found = [df.groupBy("question_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit(name)) for name, df in rules.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select("question_id", "rule", "n")


def context_labels(ranked: DataFrame, k_context: int = 5, rank: str = "final_rank") -> DataFrame:
    """The first ``k_context`` chunks, sections by their best chunk, parts by chunk_id, labelled c1, c2, ..."""
    if not 1 <= k_context <= 9:
        raise ValueError(f"k_context must be in 1..9, got {k_context}")
    chosen = ranked.where(F.col(rank) <= k_context)
    best = F.min(rank).over(Window.partitionBy("question_id", "section_id"))
    order = Window.partitionBy("question_id").orderBy("_best", "chunk_id")
    return chosen.withColumn("_best", best).withColumn("label_no", F.row_number().over(order)).withColumn("label", F.concat(F.lit("c"), "label_no")).drop("_best")


def build_context(ranked: DataFrame, k_context: int = 5, rank: str = "final_rank") -> DataFrame:
    """question_id, n_sources, context: the rendered source blocks in label order."""
    section = escape_attribute(F.trim(F.regexp_replace("breadcrumb_text", r"\s+", " ")))
    body = escape_content(F.regexp_replace("content", r"^\n+|\n+$", ""))
    block = F.format_string('<source id="%s" section="%s" url="%s">\n%s\n</source>', "label", section, escape_attribute(F.col("url")), body)
    rows = context_labels(ranked, k_context, rank).select("question_id", F.struct("label_no", block.alias("block")).alias("b"))
    blocks = F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"])
    return rows.groupBy("question_id").agg(F.count("*").alias("n_sources"), F.array_join(blocks, "\n\n").alias("context"))


def rerank_cached(candidates: DataFrame, cache: DataFrame, model: str, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, new, stats): pairs with a cached score take it, the others go to ``score`` on batches of (key, question,
    content) to (key, rerank_score). A score that is missing or out of [0, 1] fails. Candidates: question_id, chunk_id, question, content."""
    keyed = candidates.withColumn("key", F.sha2(F.to_json(F.array(F.lit(model), "question", "content")), 256))
    misses = keyed.select("key", "question", "content").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    given = misses.select("key").join(misses.mapInPandas(score, "key string, rerank_score double"), "key", "full")
    fine = F.col("rerank_score").between(0, 1) & ~F.isnan("rerank_score")
    checked = F.when(fine, F.col("rerank_score")).otherwise(F.raise_error(F.concat(F.lit("no score in [0, 1] for the pair "), "key")).cast("double"))
    new = given.select("key", checked.alias("rerank_score"))
    scores = keyed.join(cache.unionByName(new), "key").select("question_id", "chunk_id", "rerank_score")
    stats = keyed.join(cache.select("key", F.lit(True).alias("hit")), "key", "left").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return scores, new, stats


def retrieval_configs(settings: dict, modes: list[str]) -> list[dict]:
    """One configuration per mode: only the reranked mode keeps rerank fields, and it must name provider and model."""
    found = []
    for mode in modes:
        own = {k: v for k, v in settings.items() if mode == "hybrid_rerank" or not k.startswith("rerank_")}
        if mode == "hybrid_rerank" and not (own.get("rerank_provider") and own.get("rerank_model")):
            raise ValueError("hybrid_rerank needs a rerank provider and model")
        found.append(own | {"mode": mode})
    return found
