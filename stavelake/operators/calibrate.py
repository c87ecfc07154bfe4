"""Calibration of gates from real pieces: quantiles of what the corpus itself does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators import ranks

# Admitted share, clamps and tolerance of the calibrated gates.
ADMIT = 0.85
BUDGET_RANGE = (3, 6)
FIT_RANGE = (3, 6)
COPY_RANGE = (0.30, 0.45)
COPY_TOLERANCE = 1.2
COPY_QUANTILE = 0.90
REPRISE_QUANTILE = 0.75


def copy_budget(overlaps: DataFrame, pieces: DataFrame) -> DataFrame:
    """p90 and median of nearest-neighbour overlap per genre."""
    df = overlaps.join(pieces.select("piece_id", "genre"), "piece_id").select("genre", F.round("overlap", 9).alias("overlap"))
    q = ranks.quantiles(ranks.cumulative(df, ["genre"], "overlap"), ["genre"], "overlap", {"p90": COPY_QUANTILE, "median": 0.5})
    return q.select("genre", "n", *[num.round_clean(F.col(c), 2).alias(c) for c in ("p90", "median")])


def small_quantile(value: Column, q: float) -> Column:
    """Exact quantile of a whole-number score with few distinct values (at most the number of axes)."""
    return F.percentile(value, F.lit(q))


def gate_thresholds(extremes: DataFrame, fits: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per genre: extreme budget, fit threshold (null without a genre band), copy ceiling and copy threshold."""
    by_count = extremes.join(fits.select("piece_id", "fit"), "piece_id").groupBy("genre").agg(
        F.count(F.lit(1)).alias("n"),
        num.clamp(F.ceil(num_clean(small_quantile(F.col("extremes"), ADMIT))), *BUDGET_RANGE).cast("int").alias("c1_budget"),
        F.when(
            F.count("fit") > 0, num.clamp(F.floor(num_clean(small_quantile(F.col("fit"), 1 - ADMIT))), *FIT_RANGE)
        ).cast("int").alias("fit_threshold"),
    )
    genre_of = extremes.select("piece_id", "genre")
    rounded = overlaps.join(genre_of, "piece_id").select("genre", F.round("overlap", 3).alias("overlap"))
    ceiling = ranks.quantiles(ranks.cumulative(rounded, ["genre"], "overlap"), ["genre"], "overlap", {"ceiling": COPY_QUANTILE})
    copy = ceiling.select(
        "genre",
        num.round_clean(F.col("ceiling"), 3).alias("real_copy_ceiling"),
        num.round_clean(num.clamp(F.col("ceiling") * COPY_TOLERANCE, *COPY_RANGE), 2).alias("copy_threshold"),
    )
    return by_count.join(copy, "genre")


def num_clean(x: Column) -> Column:
    return F.round(x, 9)
