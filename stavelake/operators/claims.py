"""Grading of structured claims about a piece against its ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits, pitch
from stavelake.functions import numeric as num
from stavelake.operators import drills, lookups
from stavelake.operators.frames import Frames
from stavelake.operators.structure import Structure

SPAN_TOL, DURATION_TOL = 1, 0.25
SCALE_MASS = 0.90

CLAIM = (
    "piece_id {id}, highest string, lowest string, active_voice string, span int, longest double, over_bar boolean, densest int,"
    " no_repeat boolean, bar_a int, bar_b int, query_pc string, pc_present boolean, pc_count int, tonic string, mode string,"
    " subdivision string, syncopation boolean, note_value string, chord_bar int, chord_pcs array<string>,"
    " voice_a string, voice_b string, parallel boolean, interval_a string, interval_b string, semis int, interval boolean"
)


def _ok(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def parallel_pairs(fr: Frames, asked: DataFrame) -> DataFrame:
    """The asked (piece_id, voice_a, voice_b) whose top notes move by the same nonzero step between shared onsets, or never."""
    v = fr.voice_onsets.filter(F.col("voice_ix").isNotNull())
    a = v.select("piece_id", "abs", F.col("voice").alias("voice_a"), F.col("hi").alias("ta"))
    b = v.select("piece_id", "abs", F.col("voice").alias("voice_b"), F.col("hi").alias("tb"))
    w = W.partitionBy("piece_id", "voice_a", "voice_b").orderBy("abs")
    da, db = F.col("ta") - F.lag("ta").over(w), F.col("tb") - F.lag("tb").over(w)
    both = asked.distinct().join(a, ["piece_id", "voice_a"]).join(b, ["piece_id", "voice_b", "abs"])
    return both.withColumn("hit", (da != 0) & (da == db)).groupBy("piece_id", "voice_a", "voice_b").agg(
        F.coalesce(F.max("hit"), F.lit(False)).alias("ever")
    )


def grade(fr: Frames, truth: DataFrame, claims: DataFrame) -> DataFrame:
    """(piece_id, category, score) for the seventeen claim categories; claims follow ``CLAIM``, one row per piece."""
    c = F.col
    near = Structure(fr).similar_bars.select("piece_id", F.col("b1"), F.col("b2"), "sim")
    asked = claims.select("piece_id", F.col("interval_a").alias("voice_a"), F.col("interval_b").alias("voice_b"), "semis")
    sounds = lookups.ever_interval(fr.events, asked).withColumnsRenamed({"voice_a": "interval_a", "voice_b": "interval_b"})
    bars = fr.bar_levels.select("piece_id", F.col("bar").alias("chord_bar"), F.col("pcs").alias("bar_pcs"))
    df = (
        claims.withColumns({"b1": F.least("bar_a", "bar_b"), "b2": F.greatest("bar_a", "bar_b")})
        .join(truth.withColumnsRenamed({"subdivision": "t_sub", "syncopation": "t_sync", "note_value": "t_value"}), "piece_id")
        .join(near, ["piece_id", "b1", "b2"], "left").join(bars, ["piece_id", "chord_bar"], "left").join(fr.pc_weights, "piece_id")
        .join(parallel_pairs(fr, claims.select("piece_id", "voice_a", "voice_b")), ["piece_id", "voice_a", "voice_b"], "left")
        .join(sounds.withColumn("sounds", F.lit(True)), ["piece_id", "interval_a", "interval_b", "semis"], "left")
    )
    asked = reduce(lambda a, b: a.bitwiseOR(b), [
        F.coalesce(bits.pc_bit(pitch.pc_of(F.get("chord_pcs", F.lit(i)))), F.lit(0)) for i in range(12)
    ])
    tonic = pitch.pc_of(c("tonic"))
    modes = F.create_map(*[F.lit(x) for m in drills.SCALES for x in (m, drills.scale_mask(m))])
    mask = bits.rotate_down(F.element_at(modes, F.lower(F.trim("mode"))), F.pmod(-tonic, F.lit(12)).cast("int"))
    mass = F.aggregate(
        F.transform("w", lambda x, i: F.when(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    ) / c("total")
    strongest = F.array_position("w", F.array_max("w")) - 1
    scale = F.when(mass < SCALE_MASS, 0.0).when(tonic == strongest, 1.0).otherwise(0.5)
    qpc = pitch.pc_of(c("query_pc"))
    has = c("present_pcs").bitwiseAND(bits.pc_bit(qpc)) != 0
    grades = {
        "range:highest": _ok(pitch.midi_of(c("highest")) == c("highest_midi")),
        "range:lowest": _ok(pitch.midi_of(c("lowest")) == c("lowest_midi")),
        "range:active_voice": _ok(F.lower(F.trim("active_voice")) == F.lower("most_active_voice")),
        "range:span": _ok(F.abs(c("span") - c("active_span")) <= SPAN_TOL),
        "rhythm_basic:longest": _ok(F.abs(c("longest") - c("longest_beats")) <= DURATION_TOL),
        "rhythm_basic:over_bar": _ok(c("over_bar") == c("any_longer_than_bar")),
        "rhythm_basic:densest": _ok(c("densest") == c("densest_bar")),
        "repetition": F.when(F.coalesce("no_repeat", F.lit(False)), _ok(~c("near_identical_bars"))).otherwise(
            _ok((c("sim") >= 0.90) | (c("bar_a") == c("bar_b")))),
        "voice_rel:parallel": _ok(F.coalesce("ever", F.lit(False)) == F.coalesce("parallel", F.lit(False))),
        "voice_rel:interval": _ok(F.coalesce("sounds", F.lit(False)) == F.coalesce("interval", F.lit(False))),
        "pitch_content:present": _ok(has == c("pc_present")),
        "pitch_content:count": _ok(c("pc_count") == c("distinct_pc_count")),
        "scale_mode": F.coalesce(scale, F.lit(0.0)),
        "rhythm_type:subdivision": _ok(F.lower("subdivision") == c("t_sub")),
        "rhythm_type:syncopation": _ok(c("syncopation") == c("t_sync")),
        "rhythm_type:note_value": _ok(F.lower("note_value") == F.lower("t_value")),
        "chord_constituents": _ok((asked != 0) & (asked.bitwiseAND(c("bar_pcs")) == asked)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("category"), v.alias("score")) for k, v in grades.items()])
    return df.select("piece_id", F.explode(rows).alias("g")).select("piece_id", "g.category", "g.score")


def report(grades: DataFrame) -> DataFrame:
    return grades.groupBy("category").agg(F.avg("score").alias("accuracy"), num.count_if(F.col("score") == 1.0).alias("right"), F.count(F.lit(1)).alias("n"))
