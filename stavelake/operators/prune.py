"""Redundant metrics: pairwise correlation and greedy pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.operators.axes import AXES

REDUNDANT = 0.75


def correlations(fingerprint: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(axis_a, axis_b, r) for a < b, all pairs in one aggregation; r is null for a constant axis."""
    wide = fingerprint.groupBy("piece_id").pivot("axis", list(axes)).agg(F.first("value"))
    n = len(axes)
    row = F.array(*axes)
    mean = wide.agg(*[F.avg(a).alias(a) for a in axes])
    centered = wide.join(F.broadcast(mean.select(F.array(*axes).alias("_m"))), F.lit(True)).select(
        F.zip_with(row, "_m", lambda x, m: x - m).alias("d")
    )
    # 780 products per piece, summed map-side to 780 numbers.
    long = centered.select(F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.transform(F.sequence(i, F.lit(n - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("d", i) * F.get("d", j)).alias("v"))),
    ))).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("s"))
    own = long.filter("i = j").select(F.col("i").alias("x"), F.col("s").alias("sx"))
    names = F.array(*map(F.lit, axes))
    joined = long.filter("i < j").join(own, F.col("i") == F.col("x")).drop("x").withColumnRenamed("sx", "si").join(own, F.col("j") == F.col("x"))
    return joined.select(
        F.get(names, F.col("i")).alias("axis_a"), F.get(names, F.col("j")).alias("axis_b"),
        F.when((F.col("si") > 1e-18) & (F.col("sx") > 1e-18), F.col("s") / F.sqrt(F.col("si") * F.col("sx"))).alias("r"),
    )


def pruned(fingerprint: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Keep or drop per axis: repeatedly drop the axis in most redundant pairs (larger mean |r| on a tie).

    The loop runs on the driver over at most 741 numbers.
    """
    r = {(x["axis_a"], x["axis_b"]): abs(x["r"] or 0.0) for x in correlations(fingerprint, axes).collect()}
    keep, dropped = list(axes), []
    while True:
        edges = {a: [v for (p, q), v in r.items() if a in (p, q) and p in keep and q in keep and v >= REDUNDANT] for a in keep}
        worst = max(keep, key=lambda a: (len(edges[a]), sum(edges[a]) / len(edges[a]) if edges[a] else 0.0))
        if not edges[worst]:
            break
        dropped.append(worst)
        keep.remove(worst)
    rows = [(a, a in keep) for a in axes]
    return fingerprint.sparkSession.createDataFrame(rows, "axis string, kept boolean")
