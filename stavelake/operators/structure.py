"""Bar-level structure shared by the metric bank and the pattern catalogue."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.operators.frames import Frames

PROMINENT = 0.30
# Chord templates as intervals above the root.
DOM7, DIM, AUG = (0, 4, 7, 10), (0, 3, 6), (0, 4, 8)


def roots_holding(mask, template):
    """How many roots carry the template inside the set."""
    return reduce(lambda a, b: a + b, [bits.contains_all(mask, [r + t for t in template]).cast("int") for r in range(12)])


class Structure:
    def __init__(self, fr: Frames):
        self.fr = fr

    # -- prominent pitch classes ---------------------------------------------------------------
    @cached_property
    def _pc_durations(self) -> DataFrame:
        """Duration per (piece, bar, half of the bar, pitch class)."""
        half = F.when(F.col("onb") < F.col("bar_ql") / 2, 0).otherwise(1)
        return self.fr.keep(
            self.fr.events.join(self.fr.pieces.select("piece_id", "bar_ql"), "piece_id")
            .groupBy("piece_id", "bar", half.alias("half"), "pc")
            .agg(F.sum("dur").alias("w"))
        )

    @staticmethod
    def _prominent(weights: DataFrame, keys: list[str]) -> DataFrame:
        top = F.max("w").over(W.partitionBy(*keys))
        return (
            weights.withColumn("top", top)
            .filter(F.col("w") >= PROMINENT * F.col("top"))
            .groupBy(*keys)
            .agg(F.bit_or(bits.pc_bit(F.col("pc"))).alias("pcs"))
        )

    @cached_property
    def half_bars(self) -> DataFrame:
        return self._prominent(self._pc_durations, ["piece_id", "bar", "half"])

    @cached_property
    def prominent_bars(self) -> DataFrame:
        per_bar = self._pc_durations.groupBy("piece_id", "bar", "pc").agg(F.sum("w").alias("w"))
        return self._prominent(per_bar, ["piece_id", "bar"])

    # -- bass roots ----------------------------------------------------------------------------
    @cached_property
    def bass_bars(self) -> DataFrame:
        """Lowest bass pitch per bar the bass sounds in, with the previous one."""
        bass = self.fr.role_voices.select("piece_id", F.col("bass").alias("voice"))
        w = W.partitionBy("piece_id").orderBy("bar")
        return (
            self.fr.onsets.join(bass, ["piece_id", "voice"])
            .groupBy("piece_id", "bar")
            .agg(F.min("lo").alias("lo"))
            .withColumn("prev", F.lag("lo").over(w))
        )

    # -- bar sets ------------------------------------------------------------------------------
    @cached_property
    def cells(self) -> DataFrame:
        """Distinct (voice, onset, pitch) per bar."""
        return self.fr.keep(self.fr.events.select("piece_id", "bar", "voice", "onb", "midi").distinct())

    @cached_property
    def bar_sets(self) -> DataFrame:
        """Size and order-free signature of each bar's note set, with the bar's index in the piece."""
        note = F.struct("voice", "onb", "midi")
        return self.cells.groupBy("piece_id", "bar").agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64(note)).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit("b"), note)).alias("h2"),
        ).select(
            "piece_id", "bar", "size", F.struct("size", "h1", "h2").alias("sig"),
            (F.row_number().over(W.partitionBy("piece_id").orderBy("bar")) - 1).alias("ix"),
            F.count(F.lit(1)).over(W.partitionBy("piece_id")).alias("n"),
        )

    @cached_property
    def similar_bars(self) -> DataFrame:
        """Jaccard similarity of bar pairs i < j that share a note; all other pairs are 0.

        A note kind recurs in at most one row per bar, so pairs are bounded by bars squared per piece.
        """
        a = self.cells.select("piece_id", "voice", "onb", "midi", F.col("bar").alias("b1"))
        b = self.cells.select("piece_id", "voice", "onb", "midi", F.col("bar").alias("b2"))
        common = (
            a.join(b, ["piece_id", "voice", "onb", "midi"]).filter("b1 < b2")
            .groupBy("piece_id", "b1", "b2").agg(F.count(F.lit(1)).alias("k"))
        )
        s = self.bar_sets
        s1 = s.select("piece_id", F.col("bar").alias("b1"), F.col("size").alias("n1"), F.col("ix").alias("i"), "n")
        s2 = s.select("piece_id", F.col("bar").alias("b2"), F.col("size").alias("n2"), F.col("ix").alias("j"))
        return common.join(s1, ["piece_id", "b1"]).join(s2, ["piece_id", "b2"]).select(
            "piece_id", "b1", "b2", "i", "j", "n", (F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).alias("sim")
        )

    @cached_property
    def four_bars(self) -> DataFrame:
        """Every run of four adjacent sounding bars with its signature."""
        w = W.partitionBy("piece_id").orderBy("bar")
        sigs = F.array("sig", *[F.lead("sig", k).over(w) for k in (1, 2, 3)])
        return self.bar_sets.select("piece_id", "bar", sigs.alias("key"), F.lead("bar", 3).over(w).alias("last")).filter(
            F.col("last") - F.col("bar") == 3
        )

    # -- voice pairs ---------------------------------------------------------------------------
    @cached_property
    def voice_pairs(self) -> DataFrame:
        """Shared onsets of header voice pairs with the kinds of interval between their top notes."""
        v = self.fr.voice_onsets.filter(F.col("voice_ix").isNotNull())
        a = v.select("piece_id", "abs", F.col("voice_ix").alias("v1"), F.col("hi").alias("t1"))
        b = v.select("piece_id", "abs", F.col("voice_ix").alias("v2"), F.col("hi").alias("t2"))
        gap = F.abs(F.col("t1") - F.col("t2")) % 12

        def hits(*kinds):
            return F.sum(F.when(gap.isin(*kinds), 1).otherwise(0))

        return a.join(b, ["piece_id", "abs"]).filter("v1 < v2").groupBy("piece_id", "v1", "v2").agg(
            F.count(F.lit(1)).alias("shared"),
            hits(0).alias("same"),
            hits(3, 4).alias("thirds"),
            hits(8, 9).alias("sixths"),
            F.min("abs").alias("first_abs"),
        )
