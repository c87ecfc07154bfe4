"""Trajectory scoring: how evenly a piece glides from one piece's profile to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators import dose
from stavelake.operators.models import GenreModel

# Axes that follow length, and the least difference that makes an axis part of the glide.
LENGTH_AXES = ("axis_note_density_bar_variability", "axis_bar_pitch_range_mean")
MIN_DIFF = 15
BACKTRACK = -0.05


def cyclic_pairs(exemplars: DataFrame) -> DataFrame:
    """(a, b, genre_a, genre_b): every genre once as source and once as target.

    One exemplar per genre, so the ordering runs over as many rows as there are genres.
    """
    w = W.orderBy("genre")
    all_rows = W.partitionBy(F.lit(0))
    df = exemplars.select("genre", "piece_id")
    return df.select(
        F.col("piece_id").alias("a"), F.col("genre").alias("genre_a"),
        F.coalesce(F.lead("piece_id").over(w), F.min_by("piece_id", "genre").over(all_rows)).alias("b"),
        F.coalesce(F.lead("genre").over(w), F.min("genre").over(all_rows)).alias("genre_b"),
    )


def targets(pairs: DataFrame, profile: DataFrame, parts: int = 6) -> DataFrame:
    """Linear per-segment target percentiles of every case and axis."""
    p = profile.select("piece_id", "axis", "percentile")
    a = p.withColumnsRenamed({"piece_id": "a", "percentile": "pa"})
    b = p.withColumnsRenamed({"piece_id": "b", "percentile": "pb"})
    step = F.col("part") / F.lit(parts - 1)
    return pairs.join(a, "a").join(b, ["b", "axis"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        "a", "b", "axis", "part", F.rint(F.col("pa") + step * (F.col("pb") - F.col("pa"))).cast("int").alias("target")
    )


def progress(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """Per case and segment the share of the way from A to B, over the axes that differ enough.

    segments: (case_id, part, axis, percentile); ends: (case_id, axis, pa, pb). If no axis differs
    enough, all axes count.
    """
    gap = F.abs(F.col("pa") - F.col("pb")) >= MIN_DIFF
    usable = ends.filter(~F.col("axis").isin(*LENGTH_AXES))
    moving = usable.withColumn("any", F.max(gap).over(W.partitionBy("case_id"))).filter(gap | ~F.col("any")).drop("any")
    d = segments.join(moving, ["case_id", "axis"]).groupBy("case_id", "part").agg(
        F.avg(F.abs(F.col("percentile") - F.col("pa"))).alias("da"), F.avg(F.abs(F.col("percentile") - F.col("pb"))).alias("db")
    )
    return d.select("case_id", "part", (F.col("da") / F.greatest(F.lit(1e-9), F.col("da") + F.col("db"))).alias("progress"))


def graduality(track: DataFrame) -> DataFrame:
    """Monotonic rise, span, evenness, largest jolt, backtracks, anchoring and the combined score."""
    w = W.partitionBy("case_id").orderBy("part")
    steps = track.withColumn("step", F.col("progress") - F.lag("progress").over(w))
    rho = dose.spearman(track.withColumn("progress", F.round("progress", 12)), ["case_id"], "part", "progress")
    agg = steps.groupBy("case_id").agg(
        F.min_by("progress", "part").alias("first"), F.max_by("progress", "part").alias("last"),
        F.count("step").alias("n_step"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("sd"), F.max("step").alias("top"),
        num.count_if(F.col("step") < BACKTRACK).alias("backtracks"),
    )
    span = F.col("last") - F.col("first")
    ideal = span / F.greatest(F.lit(1), F.col("n_step"))
    even = F.when(F.col("n_step") > 0, F.greatest(F.lit(0.0), 1 - F.col("sd") / (F.abs("mean") + 1e-9))).otherwise(0.0)
    mono = F.coalesce("rho", F.lit(0.0))
    anchored = (F.col("first") < 0.40) & (F.col("last") > 0.60)
    score = (F.greatest(F.lit(0.0), mono) + F.least(F.lit(1.0), span / 0.6) + even + anchored.cast("double")) / 4
    return agg.join(rho, "case_id", "left").select(
        "case_id", num.round_clean(span, 3).alias("span"), num.round_clean(mono, 3).alias("monotonic"), num.round_clean(even, 3).alias("evenness"),
        num.round_clean(F.when((ideal > 1e-6) & (F.col("n_step") > 0), F.col("top") / ideal).otherwise(0.0), 2).alias("max_jolt"),
        "backtracks", anchored.alias("anchored"), num.round_clean(score, 3).alias("score"),
    )


def genre_shift(model: GenreModel, segments: DataFrame, cases: DataFrame) -> DataFrame:
    """Does the source genre's probability fall and the target's rise, with a handover and clear ends?

    segments: wide rows (case_id, part, <axes>); cases: (case_id, genre_a, genre_b).
    """
    names = F.array(*map(F.lit, model.classes))

    def prob(g):
        return F.when(F.array_contains(names, F.col(g)), F.element_at("p", F.array_position(names, F.col(g)).cast("int"))).otherwise(0.0)

    df = model.score(segments).join(cases, "case_id").select(
        "case_id", "part", "genre_a", "genre_b", prob("genre_a").alias("pa"), prob("genre_b").alias("pb"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("reads"),
    )
    rise = dose.spearman(df, ["case_id"], "part", "pb").withColumnRenamed("rho", "rise")
    fall = dose.spearman(df, ["case_id"], "part", "pa").withColumnRenamed("rho", "fall")
    agg = df.groupBy("case_id", "genre_a", "genre_b").agg(
        F.min(F.when(F.col("pb") >= F.col("pa"), F.col("part"))).alias("cross"),
        F.min_by("reads", "part").alias("first"), F.max_by("reads", "part").alias("last"),
    )
    starts, ends = F.col("first") == F.col("genre_a"), F.col("last") == F.col("genre_b")
    up, down = F.coalesce("rise", F.lit(0.0)), F.coalesce("fall", F.lit(0.0))
    same = F.col("genre_a") == F.col("genre_b")
    score = F.when(same, (starts.cast("double") + ends.cast("double")) / 2).otherwise(
        (F.greatest(F.lit(0.0), up) + F.greatest(F.lit(0.0), -down) + F.col("cross").isNotNull().cast("double") + (starts & ends).cast("double")) / 4
    )
    return agg.join(rise, "case_id", "left").join(fall, "case_id", "left").select(
        "case_id", "genre_a", "genre_b", F.round(up, 3).alias("target_rise"), F.round(down, 3).alias("source_fall"), F.col("cross").alias("crossover"),
        (starts & ends).alias("ends_read"), F.round(score, 3).alias("score"),
    )


def verdict(grad: DataFrame, shift: DataFrame, copy: DataFrame, gate: float = 0.30) -> DataFrame:
    """Combined score, softened where the piece is not new. copy: (case_id, copy_risk)."""
    df = grad.select("case_id", F.col("score").alias("graduality")).join(shift.select("case_id", F.col("score").alias("shift")), "case_id").join(copy, "case_id")
    new = F.col("copy_risk") < gate
    return df.select(
        "case_id", "graduality", "shift", new.alias("genuinely_new"),
        F.round(F.col("graduality") * F.col("shift") * F.when(new, 1.0).otherwise(0.7), 3).alias("morph_score"),
        ((F.col("graduality") >= 0.6) & (F.col("shift") >= 0.6) & new).alias("verdict"),
    )
