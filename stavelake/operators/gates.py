"""Band checks, extremes, drift and the calibrated gates built on percentile profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators.corpus import HIGH_EXTREME, LOW_EXTREME, Corpus

LO, HI = 25, 75
COLLAPSE_SD = 3.0
DRIFT_STEP = 15
PINNED_SHARE = 0.02


def status(p: Column) -> Column:
    return (
        F.when(p < LOW_EXTREME, "EXT-LO").when(p < LO, "lo").when(p <= HI, "in").when(p <= HIGH_EXTREME, "hi").otherwise("EXT-HI")
    )


def band_profile(profile: DataFrame) -> DataFrame:
    return profile.select("piece_id", "axis", "percentile", status(F.col("percentile")).alias("status"))


def band_summary(profile: DataFrame) -> DataFrame:
    """Per piece: in-band and extreme counts, profile spread, distance from 50, near-mean count."""
    p = F.col("percentile")
    s = status(p)
    return profile.groupBy("piece_id").agg(
        num.count_if(s == "in").alias("n_in"),
        num.count_if(s != "in").alias("n_out"),
        num.count_if(s.isin("EXT-LO", "EXT-HI")).alias("n_extreme"),
        F.stddev_pop(p.cast("double")).alias("spread"),
        F.avg(F.abs(p - 50)).alias("from_center"),
        num.count_if(p.between(40, 60)).alias("near_mean"),
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Axes that moved between two profiles of a piece, with the kind of move."""
    b = before.select("piece_id", "axis", F.col("percentile").alias("p0"))
    a = after.select("piece_id", "axis", F.col("percentile").alias("p1"))
    d = F.col("p1") - F.col("p0")
    outside = status(F.col("p0")) != "in"
    toward = ((d > 0) & (F.col("p0") < LO)) | ((d < 0) & (F.col("p0") > HI))
    centering = F.abs(F.col("p1") - 50) < F.abs(F.col("p0") - 50) - 3
    kind = (
        F.when(outside & toward, "toward-band").when(outside, "AWAY").when(centering, "centering").otherwise("in-band")
    )
    return a.join(b, ["piece_id", "axis"]).filter(d != 0).select(
        "piece_id", "axis", "p0", "p1", d.alias("delta"), kind.alias("kind"), (F.abs(d) >= DRIFT_STEP).alias("large")
    )


def drift_verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per piece: spread kept or collapsing, moves toward and away, and the verdict."""
    moves = drift(before, after).groupBy("piece_id").agg(
        *[num.count_if(F.col("kind") == k).alias(n) for k, n in (("toward-band", "toward"), ("AWAY", "away"), ("centering", "centering"))]
    )
    b = band_summary(before).select("piece_id", F.col("spread").alias("spread0"), F.col("near_mean").alias("near0"))
    a = band_summary(after).select("piece_id", F.col("spread").alias("spread1"), F.col("near_mean").alias("near1"))
    zero = {c: 0 for c in ("toward", "away", "centering")}
    kept = F.col("spread1") >= F.col("spread0") - COLLAPSE_SD
    return b.join(a, "piece_id").join(moves, "piece_id", "left").fillna(zero).select(
        "*", (~kept).alias("collapsing"), (kept & (F.col("toward") >= F.col("away"))).alias("healthy")
    )


def genre_targets(corpus: Corpus) -> DataFrame:
    """Target band per (axis, genre); a pinned [p25, p75] falls back to [p5, p95]."""
    scale = corpus.breakpoints.select("axis", F.greatest(F.lit(1e-9), F.col("p95") - F.col("p5")).alias("axis_range"))
    pinned = (F.col("p75") - F.col("p25")) < PINNED_SHARE * F.col("axis_range")
    return corpus.genre_bands.join(scale, "axis").select(
        "axis", "genre",
        F.when(pinned, F.col("p5")).otherwise(F.col("p25")).alias("lo"),
        F.col("p50").alias("target"),
        F.when(pinned, F.col("p95")).otherwise(F.col("p75")).alias("hi"),
    )


def genre_band_check(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """State of every axis against the piece's genre band: in, LOW, HIGH, or no_band where the genre is too small for one."""
    v = F.col("value")
    banded = F.when(v.between(F.col("lo"), F.col("hi")), "in").when(v < F.col("lo"), "LOW").otherwise("HIGH")
    state = F.when(F.col("lo").isNull(), "no_band").otherwise(banded)
    return scored.join(genre_targets(corpus), ["axis", "genre"], "left").select(
        "piece_id", "genre", "axis", "value", "percentile", "lo", "hi", "target", state.alias("state")
    )


def global_band_check(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """Axes outside the balanced [p25, p75]."""
    b = corpus.breakpoints.select("axis", F.col("p25").alias("lo"), F.col("p50").alias("target"), F.col("p75").alias("hi"))
    v = F.col("value")
    return scored.join(b, "axis").filter(~v.between(F.col("lo"), F.col("hi"))).select(
        "piece_id", "axis", "value", "target", F.when(v < F.col("lo"), "LOW").otherwise("HIGH").alias("state")
    )


def genre_extremes(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """Globally extreme axes, minus those idiomatic for the genre (inside its [p25, p75])."""
    bands = corpus.genre_bands.select("axis", "genre", "p25", "p75")
    far = (F.col("percentile") <= LOW_EXTREME) | (F.col("percentile") >= HIGH_EXTREME)
    idiomatic = F.coalesce(F.col("value").between(F.col("p25"), F.col("p75")), F.lit(False))
    return scored.filter(far).join(bands, ["axis", "genre"], "left").filter(~idiomatic).select(
        "piece_id", "genre", "axis", "percentile"
    )


def extreme_counts(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """Genre-aware extreme count for every piece, zero included."""
    counts = genre_extremes(corpus, scored).groupBy("piece_id").agg(F.count(F.lit(1)).alias("extremes"))
    return scored.select("piece_id", "genre").distinct().join(counts, "piece_id", "left").fillna({"extremes": 0})


def band_occupancy(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """How many axes sit inside the genre's [p25, p75] ("fit"); null where the genre is too small for a band."""
    bands = corpus.genre_bands.select("axis", "genre", "p25", "p75")
    inside = num.count_if(F.col("value").between(F.col("p25"), F.col("p75")))
    return scored.join(bands, ["axis", "genre"], "left").groupBy("piece_id", "genre").agg(
        F.when(F.count("p25") > 0, inside).alias("fit")
    )
