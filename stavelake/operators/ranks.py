"""Exact ranks, empirical CDFs and quantiles of groups of any size.

A group's values are first reduced to distinct (value, weight) rows and split into value ranges at
approximate quantiles. Running weights are then summed inside each range and offset by the total of
the ranges below, so the result is exact while no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 32


def _splits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    return df.groupBy(*keys).agg(F.percentile_approx(value, probs, F.lit(400)).alias("_splits"))


def _range_of(value: str) -> Column:
    return F.size(F.filter("_splits", lambda s: s < F.col(value)))


def cumulative(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values per group with their weight, the weight strictly below, and the group total.

    Returns (keys..., value, weight, below, total).
    """
    counts = df.groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("weight"))
    ranged = counts.join(_splits(counts, keys, value), keys).withColumn("_range", _range_of(value)).drop("_splits")
    within = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    across = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("weight").alias("_in_range"))
        .withColumn("_offset", F.sum("_in_range").over(across) - F.col("_in_range"))
        .withColumn("total", F.sum("_in_range").over(W.partitionBy(*keys)))
        .drop("_in_range")
    )
    return (
        ranged.withColumn("_run", F.sum("weight").over(within))
        .join(offsets, [*keys, "_range"])
        .select(*keys, value, "weight", (F.col("_offset") + F.col("_run") - F.col("weight")).alias("below"), "total")
    )


def quantiles(cum: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from a cumulative table, one column per name in ``probs``."""
    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("weight")), F.col(value)))

    picks = []
    for name, q in probs.items():
        h = (F.col("total") - 1) * F.lit(q)
        picks += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
    agg = cum.groupBy(*keys).agg(F.max("total").alias("n"), *picks)

    def mix(name: str, q: float) -> Column:
        h = (F.col("n") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (h - F.floor(h))).alias(name)

    return agg.select(*keys, "n", *[mix(name, q) for name, q in probs.items()])


def cdf_scores(queries: DataFrame, cum: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the reference weight at or below each query value, as (queries..., cdf).

    Query values are reduced to distinct ones, merged with the reference inside its value ranges and
    carried forward from the last reference value at or below, then joined back.
    """
    splits = _splits(cum, keys, value)
    ref = cum.select(*keys, value, (F.col("below") + F.col("weight")).alias("_upto"), "total", F.lit(0).alias("_q"))
    asked = (
        queries.select(*keys, value).distinct()
        .select(*keys, value, F.lit(None).cast("long").alias("_upto"), F.lit(None).cast("long").alias("total"), F.lit(1).alias("_q"))
    )
    merged = ref.unionByName(asked).join(splits, keys).withColumn("_range", _range_of(value)).drop("_splits")
    within = W.partitionBy(*keys, "_range").orderBy(value, "_q").rowsBetween(W.unboundedPreceding, W.currentRow)
    floors = cum.join(splits, keys).withColumn("_range", _range_of(value)).groupBy(*keys, "_range").agg(
        F.min("below").alias("_floor")
    )
    tops = cum.groupBy(*keys).agg(F.max("total").alias("_total"))
    # A range without a reference value inherits the weight of everything below it.
    ranges = splits.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("_range")).join(
        floors, [*keys, "_range"], "left"
    ).join(tops, keys)
    upward = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges.select(
        *keys, "_range", "_total",
        F.coalesce(F.last("_floor", ignorenulls=True).over(upward), F.col("_total")).alias("_floor"),
    )
    scored = (
        merged.withColumn("_upto", F.last("_upto", ignorenulls=True).over(within))
        .filter("_q = 1")
        .join(ranges, [*keys, "_range"])
        .select(*keys, value, (F.coalesce("_upto", "_floor") / F.col("_total")).alias("cdf"))
    )
    return queries.join(scored, [*keys, value])
