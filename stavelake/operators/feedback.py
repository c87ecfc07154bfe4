"""Verdict, score and corrections of whole pieces against genre-calibrated gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators.corpus import Corpus

LENGTH = (64, 179)


def fitness(extremes: DataFrame, fits: DataFrame, overlaps: DataFrame, bars: DataFrame, out_of_band: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per piece: the four gates, the penalty score (lower is better) and convergence.

    A genre too small for a band has no fit: that gate is null, costs nothing and convergence cannot be true.

    bars: (piece_id, bars); out_of_band: (piece_id, n_oob).
    """
    df = extremes.join(thresholds.drop("n"), "genre").join(fits.select("piece_id", "fit"), "piece_id")
    df = df.join(overlaps.select("piece_id", F.round("overlap", 3).alias("copy")), "piece_id").join(bars, "piece_id")
    df = df.join(out_of_band, "piece_id", "left").fillna({"n_oob": 0})
    c1, c2 = F.col("extremes") <= F.col("c1_budget"), F.col("bars").between(*LENGTH)
    new, fit = F.col("copy") < F.col("copy_threshold"), F.col("fit") >= F.col("fit_threshold")
    score = (
        F.greatest(F.lit(0), F.col("extremes") - F.col("c1_budget")) * 40 + F.when(c2, 0).otherwise(50)
        + F.greatest(F.lit(0.0), F.col("copy") - F.col("copy_threshold")) * 300
        + F.greatest(F.lit(0), F.col("fit_threshold") - F.col("fit")) * 15 + F.col("n_oob") * 2
    )
    return df.select(
        "piece_id", "genre", "bars", "extremes", "c1_budget", "copy", "copy_threshold", "fit", "fit_threshold", "n_oob",
        c1.alias("c1_pass"), c2.alias("c2_pass"), new.alias("copy_pass"), fit.alias("fit_pass"),
        (c1 & c2 & new & fit).alias("converged"), num.round_clean(score, 1).alias("score"),
    )


def guardrail(corpus: Corpus, scored: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Axes outside the genre's [p5, p95], ranked by distance in band widths times an optional axis weight."""
    bands = corpus.genre_bands.select("axis", "genre", "p5", "p95")
    v, width = F.col("value"), F.greatest(F.col("p95") - F.col("p5"), F.lit(1e-6))
    severity = F.when(v < F.col("p5"), (F.col("p5") - v) / width).when(v > F.col("p95"), (v - F.col("p95")) / width)
    df = scored.join(bands, ["axis", "genre"]).withColumn("severity", severity).filter("severity is not null")
    if weights is not None:
        df = df.join(weights, "axis", "left").withColumn("severity", F.col("severity") * F.coalesce("weight", F.lit(0.0)))
    w = W.partitionBy("piece_id").orderBy(F.desc("severity"), "axis")
    move = F.when(v < F.col("p5"), "raise").otherwise("lower")
    rounded = df.withColumn("severity", F.round("severity", 9))
    return rounded.select("piece_id", "genre", "axis", move.alias("move"), "severity", F.row_number().over(w).alias("rank"))


def corrections(verdicts: DataFrame, states: DataFrame) -> DataFrame:
    """Revision notes per piece: failed gates first, then out-of-band axes with their direction and percentile.

    states: (piece_id, axis, percentile, state) with state LOW or HIGH. A percentile that contradicts the
    direction (genre and global bands can disagree) is left out of the text.
    """
    c = F.col
    gates = F.array_compact(F.array(
        F.when(~c("c2_pass"), F.format_string("LENGTH: %d bars; write between %d and %d.", c("bars"), F.lit(LENGTH[0]), F.lit(LENGTH[1]))),
        F.when(~c("c1_pass"), F.format_string("EXTREMES: %d traits at an extreme; the genre allows %d.", c("extremes"), c("c1_budget"))),
        F.when(~c("copy_pass"), F.format_string("COPY: overlap %.2f reaches the limit %.2f.", c("copy"), c("copy_threshold"))),
        F.when(~c("fit_pass"), F.format_string("FIT: %d axes in the genre band; at least %d wanted.", c("fit"), c("fit_threshold"))),
    ))
    low = c("state") == "LOW"
    agrees = F.when(low, c("percentile") <= 50).otherwise(c("percentile") >= 50)
    name = F.regexp_replace(F.regexp_replace("axis", "^axis_", ""), "_", " ")
    text = F.concat(
        F.when(low, "raise ").otherwise("lower "), name, F.when(agrees, F.format_string(" (percentile %d)", c("percentile"))).otherwise("")
    )
    # At most one line per axis.
    lines = states.filter(c("state").isin("LOW", "HIGH")).groupBy("piece_id").agg(F.sort_array(F.collect_list(text)).alias("lines"))
    return verdicts.join(lines, "piece_id", "left").select(
        "piece_id", F.explode(F.concat(gates, F.coalesce("lines", F.array().cast("array<string>")))).alias("note")
    )
