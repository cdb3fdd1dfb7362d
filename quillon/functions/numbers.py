"""Numeric expressions and ordered statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.store import stored

SLICES = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - inner product, for unit vectors; within [0, 2] but for rounding."""
    return F.lit(1.0) - dot(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The unit vector; null where the norm is zero or not finite."""
    n = norm(v)
    bad = (n == 0) | F.isnan(n) | n.isin(float("inf"))
    return F.when(~bad, F.transform(v, lambda x: x.cast("double") / n))


def unit(x: Column) -> Column:
    """Clamped to [0, 1]; NaN, infinities and null become 0."""
    odd = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(odd, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def rank_strength(rank: Column, depth: Column) -> Column:
    """(depth - rank + 1) / depth, with the depth at least the rank."""
    at = F.greatest(rank, F.lit(1))
    deep = F.greatest(depth, at)
    return (deep - at + 1) / deep


def ratio(value: Column, top: Column) -> Column:
    return F.when(value.isNull() | (top <= 0) | top.isNull(), F.lit(0.0)).otherwise(unit(F.try_divide(value, top)))


def rrf_credit(rank: Column, rrf_k: int) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + rank), F.lit(0.0))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    return left.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])).drop(*[f"_of_{c}" for c in keys])


def slice_borders(df: DataFrame, by: list[str], order: str, *more: Column) -> DataFrame:
    """(by, _borders, more) of each group: its approximate quantiles of ``order``. A quantile sketch depends on the order in which tasks merge it, so the
    borders are written once: every row and every count is cut at the same ones."""
    shares = [k / SLICES for k in range(1, SLICES)]
    return stored(df.groupBy(*by).agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), F.lit(20 * SLICES)).alias("_borders"), *more), "slice-borders")


def row_places(df: DataFrame, by: list[str], order: str, *ties: str, name: str = "place") -> DataFrame:
    """``df`` with ``row_number() over (partition by by order by order, ties)`` as the long column ``name``.

    Each group is cut into ``SLICES`` ranges of ``order``, a number, at approximate quantiles; rows are numbered within their range behind the
    count of the ranges below, so that a group with most of all rows is spread over tasks. Nulls come first.
    """
    borders = slice_borders(df, by, order)
    slice_of = F.coalesce(F.size(F.filter("_borders", lambda b: b < F.col(order))), F.lit(0))
    rows = beside(df, borders, by).withColumn("_slice", slice_of).drop("_borders")
    below = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_c")).select(*by, "_slice", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(order, *ties))
    placed = beside(rows.withColumn("_inner", inner), starts, [*by, "_slice"])
    return placed.withColumn(name, F.col("_start") + F.col("_inner")).drop("_slice", "_inner", "_start")


def placed_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, _to, _n) of the distinct values of each group: how many rows have this value or a lower one, and how many there are.

    Values are counted first, then cut into ``SLICES`` ranges per group at approximate quantiles; each range is summed up by itself and
    starts from the exact counts of those below, so that a group with most of all rows is spread over tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    borders = slice_borders(counted, by, value, F.sum("_c").alias("_n"))
    rows = beside(counted, borders, by).select(*by, value, "_c", "_n", F.size(F.filter("_borders", lambda b: b < F.col(value))).alias("_slice"))
    below = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_slice").agg(F.sum("_c").alias("_c")).select(*by, "_slice", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*by, "_slice").orderBy(value)
    rows = rows.withColumn("_inner", F.sum("_c").over(inner))
    return beside(rows, starts, [*by, "_slice"]).select(*by, value, (F.col("_start") + F.col("_inner")).alias("_to"), "_n")


def nearest_rank(df: DataFrame, value: str, percents: dict[str, int], by: list[str]) -> DataFrame:
    """Per group the value at rank ceil(percent / 100 * n), the rank taken in whole numbers."""
    at = {name: F.expr(f"({p} * _n + 99) div 100") for name, p in percents.items()}
    found = [F.min(F.when(F.col("_to") >= rank, F.col(value))).alias(name) for name, rank in at.items()]
    return placed_values(df, value, by).groupBy(*by).agg(*found, F.max("_n").alias("n"))


def continuous_percentiles(df: DataFrame, value: str, percents: dict[str, float], by: list[str]) -> DataFrame:
    """Per group the exact percentiles, interpolated between the two values around each place, and the number of values."""
    n, found = F.max("_n"), []
    for name, p in percents.items():
        place = F.lit(p) * (F.col("_n") - 1)
        low, high = (F.min(F.when(F.col("_to") > at, F.col(value))) for at in (F.floor(place), F.ceil(place)))
        share = F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
        found.append((low + (high - low) * share).alias(name))
    return placed_values(df, value, by).groupBy(*by).agg(*found, n.alias("n"))
