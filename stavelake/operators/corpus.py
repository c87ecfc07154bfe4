"""Reference distribution: group-balanced values, breakpoints, shapes, bands, budgets and profiles.

Input is the long fingerprint with a group: (piece_id, genre, axis, value).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators import ranks
from stavelake.session import cut_lineage

BREAKS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
MIN_GROUP = 4
MODAL_BINS = 12
DEGENERATE_SHARE = 0.55
BIMODAL_ABOVE = 0.60
NORMAL_SKEW = 0.8
LOW_EXTREME, HIGH_EXTREME = 5, 95


def admitted(pieces: DataFrame, voices: DataFrame, min_bars: int = 8, max_bars: int = 400) -> DataFrame:
    """Pieces with at least two sounding header voices and a bar count in range."""
    heard = voices.filter(F.col("voice_ix").isNotNull()).groupBy("piece_id").agg(F.count_distinct("voice").alias("n_voices"))
    return pieces.join(heard, "piece_id").filter((F.col("n_voices") >= 2) & F.col("n_bars").between(min_bars, max_bars))


class Corpus:
    """Everything derived from one corpus fingerprint."""

    def __init__(self, fingerprint: DataFrame):
        # Stored at six decimals, so equal coordinates stay equal whatever order sums ran in.
        # Small (39 rows per piece) and read by everything below, so it is written once.
        self.fingerprint = cut_lineage(fingerprint.withColumn("value", F.round("value", 6)))

    @cached_property
    def group_cumulative(self) -> DataFrame:
        return cut_lineage(ranks.cumulative(self.fingerprint, ["axis", "genre"], "value"))

    @cached_property
    def balanced(self) -> DataFrame:
        """Balanced values as weights: (axis, value, weight).

        Resampling a group's n sorted values at floor(k*n/K) for k < K repeats the value of rank i
        ceil((i+1)K/n) - ceil(iK/n) times; K is the largest group's size.
        """
        cum = self.group_cumulative
        sizes = cum.groupBy("axis").agg(F.max("total").alias("big"))

        def reached(rank):  # ceil(rank * K / n) in whole numbers
            return F.floor((rank * F.col("big") + F.col("total") - 1) / F.col("total"))

        weight = reached(F.col("below") + F.col("weight")) - reached(F.col("below"))
        return (
            cum.join(sizes, "axis")
            .select("axis", "value", weight.cast("long").alias("weight"))
            .groupBy("axis", "value")
            .agg(F.sum("weight").alias("weight"))
            .filter("weight > 0")
        )

    @cached_property
    def cumulative(self) -> DataFrame:
        return cut_lineage(ranks.cumulative(self.balanced, ["axis"], "value", F.col("weight")))

    @cached_property
    def breakpoints(self) -> DataFrame:
        """p5..p95, mean, sd, min, max and n of the balanced distribution."""
        return cut_lineage(_breakpoints(self.cumulative, ["axis"]))

    @cached_property
    def genre_bands(self) -> DataFrame:
        """The same per group, for groups of at least four pieces."""
        return cut_lineage(_breakpoints(self.group_cumulative, ["axis", "genre"]).filter(F.col("n") >= MIN_GROUP))

    def shapes(self) -> DataFrame:
        """Skew, kurtosis (not excess), bimodality coefficient, modal share and shape label per axis."""
        cum = self.cumulative
        w, v = F.col("weight"), F.col("value")
        base = cum.groupBy("axis").agg(
            F.sum("weight").alias("n"),
            (F.sum(w * v) / F.sum(w)).alias("mean"),
            F.sum(w * F.round(v * 1e6).cast("long")).alias("millionths"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.count(F.lit(1)).alias("distinct"),
            F.max(F.when(v.isin(0.0, 1.0), 0).otherwise(1)).alias("not_bool"),
        )
        d = v - F.col("mean")
        bin_ = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * MODAL_BINS), F.lit(MODAL_BINS - 1))
        located = cum.join(base, "axis").select(
            "axis", "weight", d.alias("d"), F.when(F.col("hi") > F.col("lo"), bin_).otherwise(F.lit(0)).alias("bin")
        )
        moments = located.groupBy("axis").agg(
            *[F.sum(w * F.pow("d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)]
        )
        modal = located.groupBy("axis", "bin").agg(F.sum("weight").alias("k")).groupBy("axis").agg(F.max("k").alias("k"))
        n = F.col("n")
        sd = F.sqrt(F.col("m2") / n)
        df = (
            base.join(moments, "axis").join(modal, "axis")
            .withColumn("sd", sd)
            .withColumn("skew", F.when(F.col("sd") > 0, F.col("m3") / n / F.pow("sd", F.lit(3))).otherwise(0.0))
            .withColumn("kurt", F.when(F.col("sd") > 0, F.col("m4") / n / F.pow("sd", F.lit(4))).otherwise(0.0))
            .withColumn("bc", F.when(F.col("kurt") > 0, (F.pow("skew", F.lit(2)) + 1) / F.col("kurt")).otherwise(1.0))
            .withColumn("modal_share", F.col("k") / n)
        )
        degenerate = (
            (F.col("hi") == F.col("lo"))
            | (F.col("modal_share") > DEGENERATE_SHARE)
            | ((F.col("not_bool") == 0) & ((F.col("mean") > 0.95) | (F.col("mean") < 0.05)))
        )
        shape = (
            F.when(degenerate, "DEGENERATE")
            .when(F.col("bc") > BIMODAL_ABOVE, "bimodal/flat")
            .when(F.abs("skew") < NORMAL_SKEW, "near-normal")
            .otherwise("skewed")
        )
        # Values have six decimals, so their mean rounds exactly in whole millionths, whatever the order of summation.
        mean = F.floor((2 * F.col("millionths") + n) / (2 * n)) / 1e6
        return df.select("axis", "n", mean.alias("mean"), "sd", "skew", "kurt", "bc", "modal_share", "distinct", shape.alias("shape"))

    @cached_property
    def profile(self) -> DataFrame:
        """Percentile coordinates of the corpus pieces: (piece_id, genre, axis, value, percentile)."""
        return cut_lineage(self._score(self.fingerprint))

    def score(self, fingerprint: DataFrame) -> DataFrame:
        """Integer percentile of any fingerprint against this distribution (inclusive, half to even)."""
        # Read twice below (distinct values, then the join back), so it is written once.
        asked = cut_lineage(fingerprint.withColumn("value", F.round("value", 6)))
        return self.score_written(asked)

    def score_written(self, asked: DataFrame) -> DataFrame:
        """The same of a fingerprint that is written already, at six decimals."""
        return self._score(asked)

    def _score(self, asked: DataFrame) -> DataFrame:
        scored = ranks.cdf_scores(asked, self.cumulative, ["axis"], "value")
        return scored.withColumn("percentile", num.half_even(F.col("cdf") * 100).cast("int"))

    def profile_report(self) -> DataFrame:
        """Value, percentile and the axis' mean and range, per piece and axis."""
        stats = self.breakpoints.select("axis", F.col("mean").alias("corpus_mean"), F.col("min").alias("corpus_min"), F.col("max").alias("corpus_max"))
        return self.profile.join(stats, "axis").select(
            "piece_id", "axis", F.round("value", 4).alias("value"), "percentile", "corpus_mean", "corpus_min", "corpus_max"
        )

    @cached_property
    def extreme_budget(self) -> DataFrame:
        """How many axes real pieces of a group have outside the group's own p5..p95 percentile band."""
        prof = self.profile
        # Percentiles are whole numbers 0..100, so exact percentile state is at most 101 counts.
        edges = prof.groupBy("genre", "axis").agg(
            F.percentile("percentile", F.lit(0.05)).alias("lo"), F.percentile("percentile", F.lit(0.95)).alias("hi")
        )
        outside = (F.col("percentile") < F.col("lo")) | (F.col("percentile") > F.col("hi"))
        counts = prof.join(edges, ["genre", "axis"]).groupBy("genre", "piece_id").agg(num.count_if(outside).alias("ext"))
        return counts.groupBy("genre").agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("ext", F.lit(0.5)).cast("int").alias("median"),
            F.percentile("ext", F.lit(0.75)).cast("int").alias("p75"),
            F.avg("ext").alias("mean"),
        ).filter(F.col("n") >= MIN_GROUP)


def _breakpoints(cum: DataFrame, keys: list[str]) -> DataFrame:
    w, v = F.col("weight"), F.col("value")
    moments = cum.groupBy(*keys).agg(
        (F.sum(w * v) / F.sum(w)).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    spread = (
        cum.join(moments.select(*keys, "mean"), keys)
        .groupBy(*keys)
        .agg(F.sqrt(F.sum(w * F.pow(v - F.col("mean"), F.lit(2))) / F.sum("weight")).alias("sd"))
    )
    q = ranks.quantiles(cum, keys, "value", BREAKS)
    cols = [*BREAKS, "mean", "sd", "min", "max"]
    return q.join(moments, keys).join(spread, keys).select(*keys, "n", *[num.round_clean(F.col(c), 4).alias(c) for c in cols])
