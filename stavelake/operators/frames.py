"""Shared aggregation levels of one event table.

Raw notes are reduced once, map-side first, to two levels that every metric reads:

* ``onsets``: one row per (piece, voice, onset, bar) with a pitch-class mask and pitch extremes;
* ``pitches``: one row per (piece, voice, pitch) with note count and duration.

Events dealt by piece are reduced where they lie. Otherwise the keys are fine-grained, so a piece that
holds a large share of all notes is still spread over every task, and what later steps group by piece has
been reduced to musical positions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.session import shared


class Frames:
    """Lazily built intermediate tables for one (events, pieces) pair."""

    def __init__(self, events: DataFrame, pieces: DataFrame, bars: DataFrame | None = None, dealt: int = 0):
        """``dealt`` says over how many partitions ``events`` are dealt by piece, 0 that they are not."""
        self.events = events
        self.pieces = pieces
        self.bars = bars
        self.dealt = dealt
        self.kept: list[DataFrame] = []

    # -- levels ------------------------------------------------------------------------------
    @cached_property
    def onsets(self) -> DataFrame:
        df = self.events.groupBy("piece_id", "voice", "voice_ix", "is_drum", "program", "abs", "bar", "onb").agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_or(bits.pc_bit(F.col("pc"))).alias("pcs"),
            F.min("midi").alias("lo"),
            F.max("midi").alias("hi"),
            F.sum("midi").alias("sum_midi"),
            F.max("dur").alias("max_dur"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.max_by("dur", "seq").alias("last_dur"),
        )
        return shared(df)

    @cached_property
    def pitches(self) -> DataFrame:
        df = self.events.groupBy("piece_id", "voice", "is_drum", "midi").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("dur").alias("dur"),
            F.sum(F.greatest("dur", F.lit(0.0))).alias("pos_dur"),
        )
        return shared(df)

    @cached_property
    def voice_onsets(self) -> DataFrame:
        """One row per (piece, voice, onset), whatever bar it was written in."""
        return self.onsets.groupBy("piece_id", "voice", "voice_ix", "is_drum", "abs").agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("max_dur").alias("max_dur"),
            F.max_by("last_dur", "last_seq").alias("last_dur"),
        )

    @cached_property
    def voices(self) -> DataFrame:
        """One row per sounding voice."""
        per_onset = self.onsets.groupBy("piece_id", "voice", "voice_ix", "is_drum", "program", "abs").agg(
            F.sum("n").alias("n"),
            F.sum("sum_midi").alias("sum_midi"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.min("first_seq").alias("first_seq"),
        )
        df = per_onset.groupBy("piece_id", "voice", "voice_ix", "is_drum", "program").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("n_onset"),
            F.sum("sum_midi").alias("sum_midi"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.min("first_seq").alias("first_seq"),
            (F.sum("sum_midi") / F.sum("n")).alias("avg_midi"),
            (F.sum("n") / F.count(F.lit(1))).alias("chordality"),
        )
        return shared(df)

    @cached_property
    def pc_weights(self) -> DataFrame:
        """Sounding duration per pitch class (percussion included): piece_id, w array<double>(12), total."""
        weights = [
            F.sum(F.when(F.col("midi") % 12 == k, F.col("dur")).otherwise(0.0)).alias(f"w{k}") for k in range(12)
        ]
        return (
            self.pitches.groupBy("piece_id")
            .agg(*weights)
            .select("piece_id", F.array(*[f"w{k}" for k in range(12)]).alias("w"))
            .withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        )

    # -- picks -------------------------------------------------------------------------------
    @cached_property
    def bass_voice(self) -> DataFrame:
        """Pitched voice of lowest mean pitch; the one heard first wins a tie."""
        return (
            self.voices.filter(~F.col("is_drum"))
            .groupBy("piece_id")
            .agg(F.min_by("voice", F.struct("avg_midi", "first_seq")).alias("voice"))
        )

    @cached_property
    def lead_voice(self) -> DataFrame:
        """Header voice with the most distinct onsets; header order settles ties."""
        return (
            self.voices.filter(F.col("voice_ix").isNotNull())
            .groupBy("piece_id")
            .agg(F.max_by("voice", F.struct(F.col("n_onset"), -F.col("voice_ix"))).alias("voice"))
        )

    @cached_property
    def role_voices(self) -> DataFrame:
        """Bass and melody among header voices, percussion included, header order on ties.

        The melody prefers near-monophonic voices with at least eight onsets.
        """
        heard = self.voices.filter(F.col("voice_ix").isNotNull())
        mono = (F.col("chordality") < 1.4) & (F.col("n_onset") >= 8)
        return heard.groupBy("piece_id").agg(
            F.min_by("voice", F.struct("avg_midi", "voice_ix")).alias("bass"),
            F.max_by("voice", F.struct(mono.alias("mono"), F.col("avg_midi"), -F.col("voice_ix"))).alias("melody"),
        )

    def top_line(self, pick: DataFrame, voice_col: str = "voice") -> DataFrame:
        """Top pitch at each onset of the picked voice, with the step from the previous onset."""
        chosen = pick.select("piece_id", F.col(voice_col).alias("voice"))
        line = self.voice_onsets.join(chosen, ["piece_id", "voice"]).select("piece_id", "voice", "abs", "hi", "max_dur")
        w = W.partitionBy("piece_id").orderBy("abs")
        return line.withColumn("step", F.col("hi") - F.lag("hi").over(w))

    @cached_property
    def instants(self) -> DataFrame:
        """Pitched notes grouped by the nearest quarter-of-a-beat instant."""
        grouped = (
            self.onsets.filter(~F.col("is_drum"))
            .groupBy("piece_id", F.rint(F.col("abs") * 4).alias("q"))
            .agg(
                F.bit_or("pcs").alias("pcs"),
                F.min("lo").alias("lo"),
                (F.min(F.xxhash64("voice")) != F.max(F.xxhash64("voice"))).alias("many_voices"),
            )
        )
        return grouped.withColumn("size", bits.size(F.col("pcs"))).withColumn(
            "above_bass", bits.rotate_down(F.col("pcs"), F.col("lo") % 12)
        )

    @cached_property
    def bar_levels(self) -> DataFrame:
        """One row per sounding bar."""
        return self.onsets.groupBy("piece_id", "bar").agg(
            F.sum("n").alias("n"),
            F.bit_or("pcs").alias("pcs"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )

    def keep(self, df: DataFrame) -> DataFrame:
        """Share a table until ``release``."""
        self.kept.append(shared(df))
        return self.kept[-1]

    def kept_events(self) -> Frames:
        """The same with its events kept too, so that every level reads them where they were dealt."""
        self.events = self.keep(self.events)
        return self

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        for name in ("onsets", "pitches", "voices"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
