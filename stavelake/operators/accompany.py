"""Accompaniment cases: take a voice out, put a generated one in, and grade the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators import overlap, regions

# General MIDI drum notes by kit part.
KICK, SNARE, HATS = (35, 36), (37, 38, 40), (42, 44, 46, 49, 51, 52, 55, 57, 59)
BINS = 16


def role(voice: Column, program: Column, is_drum: Column, chordality: Column) -> Column:
    bass = F.lower(voice).contains("bass") | F.coalesce(program.between(32, 39), F.lit(False))
    return F.when(is_drum, "drums").when(bass, "bass").when(chordality >= 1.4, "harmony").otherwise("melody")


def remove_voice(events: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, answer): the piece without the target voice, and that voice alone. Nothing is lost.

    targets: (piece_id, voice).
    """
    keys = ["piece_id", "voice"]
    return events.join(targets.select(*keys), keys, "left_anti"), events.join(targets.select(*keys), keys, "left_semi")


def splice(context: DataFrame, part: DataFrame) -> DataFrame:
    """Put a voice back into its context."""
    return context.unionByName(part, allowMissingColumns=True)


def groove(generated: DataFrame, real: DataFrame, pieces: DataFrame, bar_slots: int = 16) -> DataFrame:
    """Kit coverage, density ratio and onset-position cosine of a drum voice against the real one."""
    where = F.least(F.lit(BINS - 1), F.floor((F.col("slot") % bar_slots) / bar_slots * BINS))

    def hist(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("piece_id", where.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias(name))

    both = hist(generated, "g").join(hist(real, "r"), ["piece_id", "bin"], "full").fillna(0.0)
    sums = both.groupBy("piece_id").agg(
        F.sum(F.col("g") * F.col("r")).alias("dot"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("r") * F.col("r")).alias("rr"),
        F.sum("g").alias("n_g"), F.sum("r").alias("n_r"),
    )
    kit = generated.groupBy("piece_id").agg(sum(
        (F.max(F.col("midi").isin(*part).cast("int")) for part in (SNARE, HATS)), F.max(F.col("midi").isin(*KICK).cast("int"))
    ).alias("kit"))
    mag = F.sqrt("gg") * F.sqrt("rr")
    sim = F.round(num.ratio(F.col("dot"), mag), 3)
    ratio = num.ratio(F.col("n_g"), F.col("n_r"))
    n_bars = F.greatest(F.lit(1), F.col("n_bars"))
    fit = (F.coalesce("kit", F.lit(0)) >= 2) & ratio.between(0.4, 2.5) & (sim >= 0.5)
    return sums.join(kit, "piece_id", "left").join(pieces.select("piece_id", "n_bars"), "piece_id").select(
        "piece_id", F.coalesce("kit", F.lit(0)).alias("kit"), F.round(F.col("n_g") / n_bars, 1).alias("density"),
        F.round(F.col("n_r") / n_bars, 1).alias("density_real"), sim.alias("rhythm_sim"), fit.alias("groove_fit"),
    )


def part_facts(part: DataFrame, answer: DataFrame, keys: DataFrame) -> DataFrame:
    """Notes, share in key and overlap with the held-out voice of a generated part. keys: (piece_id, key mask)."""
    inside = F.col("key").bitwiseAND(bits.pc_bit(F.col("pc"))) != 0
    facts = part.join(keys, "piece_id").groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n_notes"), F.round(F.avg(inside.cast("double")), 2).alias("in_key")
    )
    copy = overlap.case_overlap(part, answer).select("piece_id", F.round("overlap_slid", 3).alias("copy_vs_answer"))
    return facts.join(copy, "piece_id").withColumn("fit", (F.col("n_notes") >= 4) & (F.col("in_key") >= 0.8))


def improvement(completed: DataFrame, context: DataFrame, original: DataFrame) -> DataFrame:
    """Did the part move the profile toward the original? Inputs are percentile profiles."""
    a = regions.profile_distance(completed, original).withColumnRenamed("dist", "d_completed")
    b = regions.profile_distance(context, original).withColumnRenamed("dist", "d_context")
    return a.join(b, "piece_id").withColumn("improved", F.col("d_completed") < F.col("d_context"))
