"""MinHash near-duplicates, verified on odd sketches and confirmed on the sets.

A document's set holds its distinct two-word shingles; fewer words make one shingle, none make none. Documents are linked if the
Jaccard similarity of their sets is 0.8 or more.

1. Documents with equal sets are one vertex.
2. A vertex stands in ``BANDS`` buckets, each named by five MinHash samples of its set: a pair of similarity 0.8 shares one with
   probability 1 - (1 - 0.8^5)^36, all but 0.0000007.
3. In a bucket, sets of fitting sizes are compared by their odd sketches (``odd_sketch``): parity bitmaps of 1,024 MinHash samples, whose
   XOR population count tells the similarity precisely. Candidates that exceed the count of similarity 0.8 by six deviations go.
4. The rest is linked only if the whole sets have the similarity. Sets meet as 32 bits of a shingle's hash; a wrong decision needs a pair
   within one shingle of the threshold and two shingles with equal bits, fewer than one pair in a million.
5. Buckets are worked off in the two rounds of ``similar``: a large group of near copies costs about a link a member, hot buckets are dealt
   out in parts, and neither copies nor groups are expanded into pairs.

Null texts count as empty; documents without words have size 0 and are each a component of their own. Repeated rows stay; rows with one doc_id and
different texts are different vertices. A null doc_id is kept, and names a component, only if the component has no other. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import odd_sketch, similar
from quillon.llm.common import materialize
from quillon.llm.simhash import BUCKET

WIDTH = 2
SIMILARITY = 0.8
BANDS = 36


def on_sketches(units: np.ndarray, fps: np.ndarray, sketches: np.ndarray | None, sizes: np.ndarray, asks: np.ndarray, answers: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The comparison of odd sketches alone; fingerprints are not looked at."""
    return odd_sketch.answers(units, sketches, sizes, asks, answers, similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the size of its set, the smallest doc_id reachable, and whether that is its own.

    The buckets are meant for a similarity of 0.8 or more; the smaller, the more links they miss.
    """
    marks = materialize(similar.marks_of(docs, width, BANDS), "minhash-marks")
    named = similar.named_groups(marks, on_sketches, similarity, bucket)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def sql() -> str:
    """The rows of ``near_duplicates`` over the table documents, for DuckDB: all pairs that share a shingle, and everything that links reach."""
    return r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
 sets as materialized (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as ss from w),
 members as materialized (select doc_id, len(ss) as n, hash(s) as s from (select doc_id, ss, unnest(ss) as s from sets)),
 met as (select a.doc_id as u, b.doc_id as v, a.n + b.n as total, count(*) as shared from members a join members b on a.s = b.s and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by all),
 links as materialized (select u, v from met where 100 * shared >= 80 * (total - shared)),
 both_ways as materialized (select u, v from links union all select v, u from links),
 reached as (select doc_id as node, doc_id as root from sets union select v, root from reached join both_ways on u = node where root < v),
 least as (select node, min(root) as component_id from reached group by node)
 select doc_id, len(ss)::bigint as n_shingles, component_id, component_id = doc_id as kept from sets join least on node = doc_id"""
