"""Practice-drill checks: challenge detectors, requirements and the drill gate, as columns over per-piece features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.frames import Frames

# Scales as intervals above the tonic, and the gate's limits.
SCALES = {
    "major": (0, 2, 4, 5, 7, 9, 11), "ionian": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10),
    "natural minor": (0, 2, 3, 5, 7, 8, 10), "aeolian": (0, 2, 3, 5, 7, 8, 10), "harmonic minor": (0, 2, 3, 5, 7, 8, 11),
    "melodic minor": (0, 2, 3, 5, 7, 9, 11), "major pentatonic": (0, 2, 4, 7, 9), "minor pentatonic": (0, 3, 5, 7, 10),
    "blues": (0, 3, 5, 6, 7, 10), "chromatic": tuple(range(12)), "whole tone": (0, 2, 4, 6, 8, 10),
    "dorian": (0, 2, 3, 5, 7, 9, 10), "phrygian": (0, 1, 3, 5, 7, 8, 10), "lydian": (0, 2, 4, 6, 7, 9, 11),
    "mixolydian": (0, 2, 4, 5, 7, 9, 10), "locrian": (0, 1, 3, 5, 6, 8, 10),
}
OUTSIDE_ALLOWED = 0.12
CORPUS_LIMIT, SHOWN_LIMIT = 0.70, 0.50


def scale_mask(name: str, tonic: int = 0) -> int:
    """Pitch-class mask of a named scale; unknown names read as major."""
    return sum(1 << ((tonic + i) % 12) for i in SCALES.get(name.strip().lower(), SCALES["major"]))


def features(fr: Frames, unit: float = 1.0) -> DataFrame:
    """Everything the detectors look at, one row per piece. ``unit`` is the beat in quarter notes."""
    dur, onb = F.col("dur"), F.col("onb")

    def near(*values):
        return F.max(reduce(lambda a, b: a | b, [F.abs(dur - v) < 0.05 for v in values]))

    next_beat = (F.floor(F.round(onb / unit, 6)) + 1) * unit
    base = fr.events.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n"),
        num.count_if(F.round(F.pmod(onb / unit, F.lit(1.0)), 3) != 0).alias("n_off"),
        near(0.5).alias("has_eighth"), near(0.25).alias("has_sixteenth"), near(1.5, 0.75).alias("has_dotted"),
        F.max(dur >= 3.5).alias("has_whole"),
        F.max((onb < next_beat) & (next_beat < onb + dur - 1e-6)).alias("has_tie"),
        F.count_distinct("midi").alias("n_pitch"), F.min("midi").alias("lo"), F.max("midi").alias("hi"),
        F.bit_or(bits.pc_bit(F.col("pc"))).alias("pcs"), F.count_distinct("voice").alias("n_voice"),
    )
    together = fr.onsets.groupBy("piece_id", "bar", F.round("onb", 3).alias("o")).agg(F.sum("n").alias("k"), F.max("hi").alias("top"), F.bit_or("pcs").alias("pcs"))
    w = W.partitionBy("piece_id").orderBy("bar", "o")
    steps = together.withColumn("step", F.col("top") - F.lag("top").over(w))
    size = F.abs("step")
    lines = steps.groupBy("piece_id").agg(
        F.max("k").alias("sim"), F.avg((F.col("k") >= 2).cast("double")).alias("poly"),
        F.avg(F.when(size.isNotNull(), (size <= 2).cast("double"))).alias("step_share"), F.max(size).alias("max_step"),
        F.max(F.col("step") > 0).alias("goes_up"), F.max(F.col("step") < 0).alias("goes_down"),
    )
    bars = together.groupBy("piece_id", "bar").agg(F.max("k").alias("k"), bits.size(F.bit_or("pcs")).alias("n_pc"))
    harmony = bars.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n_bar"), F.max("n_pc").alias("bar_pcs"), F.max((F.col("n_pc") >= 3) & (F.col("k") <= 2)).alias("broken")
    )
    df = base.join(lines, "piece_id").join(harmony, "piece_id").join(rhythm_mix(fr), "piece_id").join(held_cells(fr, unit), "piece_id", "left")
    if fr.bars is not None:
        trip = fr.bars.groupBy("piece_id").agg(F.max((F.col("grid") == 12) & F.col("is_triplet")).alias("has_triplet"))
        df = df.join(trip, "piece_id", "left")
    else:
        df = df.withColumn("has_triplet", F.lit(False))
    return df.withColumn("off_share", F.col("n_off") / F.col("n")).fillna({"n_held": 0, "has_triplet": False})


def rhythm_mix(fr: Frames) -> DataFrame:
    """Distinct bar rhythms, the longest identical run and the share of bar changes."""
    notes = fr.events.groupBy("piece_id", "bar", F.round("onb", 3).alias("o"), F.round("dur", 3).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    cell = F.struct("o", "d", "k")
    sig = notes.groupBy("piece_id", "bar").agg(F.struct(
        F.sum("k").alias("n"), F.bit_xor(F.xxhash64(cell)).alias("h1"), F.bit_xor(F.xxhash64(F.lit("r"), cell)).alias("h2")).alias("sig"))
    w = W.partitionBy("piece_id").orderBy("bar")
    marked = sig.withColumn("new", F.coalesce(F.col("sig") != F.lag("sig").over(w), F.lit(True)))
    runs = marked.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    longest = runs.groupBy("piece_id", "run").agg(F.count(F.lit(1)).alias("len")).groupBy("piece_id").agg(
        F.max("len").alias("longest_run"), F.sum("len").alias("nb"), F.count(F.lit(1)).alias("n_run"))
    kinds = sig.groupBy("piece_id").agg(F.count_distinct("sig").alias("n_rhythm"))
    return longest.join(kinds, "piece_id").select(
        "piece_id", "longest_run", "n_rhythm", F.when(F.col("nb") > 1, (F.col("n_run") - 1) / (F.col("nb") - 1)).otherwise(0.0).alias("change_share"),
        ((F.col("n_rhythm") >= F.least(F.lit(3), F.col("nb"))) & (F.col("longest_run") <= 2)
         & (F.when(F.col("nb") > 1, (F.col("n_run") - 1) / (F.col("nb") - 1)).otherwise(0.0) >= 0.5)).alias("rhythm_mixed"),
    )


def held_cells(fr: Frames, unit: float) -> DataFrame:
    """Distinct lengths of notes that start off the beat, are held over the next one and outlast their neighbours."""
    notes = fr.events.select("piece_id", "voice", "bar", "onb", "midi", "dur").distinct()
    w = W.partitionBy("piece_id", "voice", "bar").orderBy("onb", "midi", "dur")
    start, dur = F.col("onb"), F.col("dur")
    beat = (F.rint(start / unit - 0.5).cast("int") + 1) * unit
    off = F.abs(start - F.rint(start / unit) * unit) > 1e-6
    longer = (dur > F.lag("dur").over(w) + 1e-9) & (dur >= F.lead("dur").over(w) - 1e-9)
    held = notes.withColumn("cell", off & (start < beat) & (beat < start + dur - 1e-9) & longer).filter("cell")
    return held.groupBy("piece_id").agg(F.count_distinct(F.round("dur", 3)).alias("n_held"))


def detectors() -> dict[str, Column]:
    """Concept id -> check. Concepts without a detector are reviewed by hand and never gate."""
    c = F.col
    harmony = (c("sim") >= 3) | (c("bar_pcs") >= 3)
    groups = {
        ("TR-SYNCOPATION", "TR-PAT-SYNCOPATED-RHYTHM"): c("off_share") >= 0.30,
        ("TR-TRIPLET", "TR-PAT-TRIPLET-RHYTHM", "TR-METER-128"): c("has_triplet"),
        ("TR-EIGHTH-NOTE", "TR-PAT-FOUR-EIGHTHS"): c("has_eighth"),
        ("TR-SIXTEENTH-NOTE", "TR-PAT-SIXTEENTH-RUN"): c("has_sixteenth"),
        ("TR-WHOLE-NOTE",): c("has_whole"),
        ("TR-DOTTED-NOTE", "TR-PAT-DOTTED-LONG-SHORT", "TR-PAT-DOTTED-SHORT-LONG"): c("has_dotted"),
        ("TR-SHORT-LONG-SHORT",): c("n_held") >= 1,
        ("TR-TIE",): c("has_tie"),
        ("TM-LEAP",): F.coalesce(c("max_step"), F.lit(0)) >= 3,
        ("TM-STEPWISE",): F.coalesce(c("step_share"), F.lit(0.0)) >= 0.6,
        ("TX-ARPEGGIO", "TX-BROKEN-CHORDS", "TX-ALBERTI-BASS"): c("broken"),
        ("TX-BLOCK-CHORDS", "TX-HOMOPHONIC"): c("sim") >= 3,
        ("category:chord", "category:progression", "category:cadence"): harmony,
        ("category:scale", "category:key"): F.lit(True),
    }
    return {cid: check for ids, check in groups.items() for cid in ids}


def challenge_checks(feats: DataFrame) -> DataFrame:
    """(piece_id, concept, passed) for every concept with a detector."""
    rows = F.array(*[F.struct(F.lit(k).alias("concept"), v.alias("passed")) for k, v in detectors().items()])
    return feats.select("piece_id", F.explode(rows).alias("r")).select("piece_id", "r.concept", "r.passed")


def requirements(feats: DataFrame, off_band: tuple[float, float] | None = None, min_span: int | None = None,
                 melody: bool = False, figuration: bool = False, single_line: bool = False, mixed: bool = False) -> DataFrame:
    """One boolean column per requested requirement; null where it was not asked for."""
    def asked(on, check):
        return check if on else F.lit(None).cast("boolean")

    lo, hi = off_band or (0.0, 1.0)
    lively = (
        (F.coalesce("step_share", F.lit(0.0)) >= (0.0 if figuration else 0.25)) & (F.coalesce("max_step", F.lit(0)) >= 3)
        & F.coalesce("goes_up", F.lit(False)) & F.coalesce("goes_down", F.lit(False)) & (F.col("n_pitch") >= 5)
    )
    return feats.select(
        "piece_id",
        asked(off_band is not None, F.round("off_share", 2).between(lo, hi)).alias("syncopation_ok"),
        asked(min_span is not None, F.col("hi") - F.col("lo") >= (min_span or 0)).alias("span_ok"),
        asked(melody, lively).alias("melody_ok"),
        asked(single_line, (F.col("sim") <= 2) & (F.col("poly") <= 0.10)).alias("single_line_ok"),
        asked(mixed, F.col("rhythm_mixed")).alias("rhythm_ok"),
    )


def register_balance(fr: Frames, lo: int, hi: int) -> DataFrame:
    """Evenness of notes over the octaves of [lo, hi] (0..1) and the busiest octave's share."""
    n_oct = max(1, -(-(hi - lo + 1) // 12))
    octave = F.greatest(F.lit(0), F.least(F.lit(n_oct - 1), F.floor((F.col("midi") - lo) / 12)))
    counts = fr.pitches.groupBy("piece_id", octave.alias("o")).agg(F.sum("n").cast("double").alias("n"))
    total = F.sum("n")
    h = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return counts.groupBy("piece_id").agg(
        (h / F.log(F.lit(float(n_oct))) if n_oct > 1 else F.lit(1.0)).alias("balance"), (F.max("n") / total).alias("busiest_share")
    )


def gate(feats: DataFrame, key: DataFrame, checks: DataFrame, wanted: list[str], reqs: DataFrame, copies: DataFrame) -> DataFrame:
    """Single voice, in key, challenge met, requirements met, novel, at least two bars.

    key: (piece_id, outside); copies: (piece_id, vs_corpus, vs_shown).
    """
    auto = checks.filter(F.col("concept").isin(*wanted)).groupBy("piece_id").agg(F.min("passed").alias("challenge"))
    names = [c for c in reqs.columns if c != "piece_id"]
    met = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(True)) for c in names])
    df = feats.join(key, "piece_id").join(auto, "piece_id", "left").join(reqs, "piece_id").join(copies, "piece_id")
    parts = {
        "single": F.col("n_voice") == 1, "in_key": F.col("outside") <= OUTSIDE_ALLOWED, "challenge_pass": F.coalesce("challenge", F.lit(True)),
        "requirement_pass": met, "novel": (F.col("vs_corpus") < CORPUS_LIMIT) & (F.col("vs_shown") < SHOWN_LIMIT), "long_enough": F.col("n_bar") >= 2,
    }
    return df.select("piece_id", *[v.alias(k) for k, v in parts.items()], reduce(lambda a, b: a & b, parts.values()).alias("verdict"))
