"""Diagnosis of a piece: which bars drive an axis, and where a copy sits note by note.

Leave-one-bar-out attribution needs no recomputation per bar. The axes here are functions of sums, so each bar keeps its
own partial sums, the piece's are their total, and the piece without a bar is the total less that bar's: one row per bar
and one window, linear in bars. Removing a bar also shortens the piece by one bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.frames import Frames
from stavelake.operators.overlap import corpus_overlap, note_key

#: Fewer bars than this leave nothing to attribute to.
LEAST_BARS = 3
_PCS = tuple(f"w{k}" for k in range(12))


def bar_states(fr: Frames) -> DataFrame:
    """Partial sums of every bar of a piece, silent bars included: piece_id, n_bars, bar and one column per sum."""
    onb, dur, vel = F.col("onb"), F.col("dur"), F.col("vel").cast("double")
    beat, frac = num.half_even(onb), onb - F.floor(onb)
    on_beat, inner = F.abs(onb - beat) < 0.12, (frac >= 0.12) & (frac <= 0.88)
    swung = F.least(F.abs(frac - 0.667), F.abs(frac - 0.333)) < F.abs(frac - 0.5)
    sounding = F.when(dur > 0, dur)
    notes = fr.events.groupBy("piece_id", "bar").agg(
        F.count(F.lit(1)).alias("n"),
        num.count_if(F.col("is_drum")).alias("n_drum"),
        num.count_if(num.off_beat(onb)).alias("n_off"),
        num.count_if(inner).alias("n_inner"),
        num.count_if(inner & swung).alias("n_swung"),
        F.count(sounding).alias("n_dur"),
        F.sum(sounding).alias("dur"),
        F.sum(sounding * sounding).alias("dur2"),
        F.sum(F.col("midi").cast("double")).alias("midi"),
        F.sum(F.when(on_beat & beat.isin(1.0, 3.0), vel)).alias("back"),
        F.sum(F.when(on_beat & beat.isin(0.0, 2.0), vel)).alias("front"),
        num.count_if(on_beat & vel.isNull()).alias("n_silent_beat"),
        num.count_if(vel.isNull()).alias("n_no_vel"),
        F.sum(vel).alias("vel"),
        F.sum(vel * vel).alias("vel2"),
        F.sum(dur).alias("w"),
        *(F.sum(F.when(F.col("midi") % 12 == k, dur)).alias(w) for k, w in enumerate(_PCS)),
    )
    heard = fr.bar_levels.select(
        "piece_id", "bar", F.lit(1).alias("n_heard"), bits.size(F.col("pcs")).alias("n_pcs"), (F.col("n").cast("double") * F.col("n")).alias("n2"),
        (F.col("n") >= 2).cast("int").alias("n_span"), F.when(F.col("n") >= 2, F.col("hi") - F.col("lo")).alias("span"),
    )
    onsets = fr.onsets.groupBy("piece_id", "bar").agg(F.count(F.lit(1)).alias("n_onset"))
    every = fr.pieces.where(F.col("n_bars") >= LEAST_BARS).select("piece_id", "n_bars", F.explode(F.sequence(F.lit(1), F.col("n_bars"))).alias("bar"))
    states = every
    for part in (notes, heard, onsets):
        states = states.join(part, ["piece_id", "bar"], "left")
    return states.fillna(0).withColumn("n_bar", F.lit(1))


def axis_values(s: dict[str, Column]) -> dict[str, Column]:
    """The decomposable axes as functions of sums; 0 where an axis is undefined."""
    ratio, zero = num.ratio, F.lit(0.0)

    def spread(squares: Column, total: Column, n: Column) -> Column:
        mean = total / n
        return F.sqrt(F.greatest(squares / n - mean * mean, zero))

    length, density = ratio(s["dur"], s["n_dur"]), ratio(s["n"], s["n_bar"])
    entropy = F.aggregate(F.array(*(s[w] for w in _PCS)), zero, lambda total, w: total + num.plogp(w, s["w"]))
    return {
        "axis_backbeat_emphasis": F.when(s["n_silent_beat"] > 0, 0.0).otherwise(ratio(s["back"], s["back"] + s["front"])),
        "axis_bar_pitch_range_mean": ratio(s["span"], s["n_span"]),
        "axis_drum_ratio": ratio(s["n_drum"], s["n"]),
        "axis_duration_cv": F.when(s["n_dur"] >= 2, num.cv(spread(s["dur2"], s["dur"], s["n_dur"]), length)).otherwise(0.0),
        "axis_mean_note_length": length,
        "axis_note_density_bar_variability": num.cv(spread(s["n2"], s["n"], s["n_bar"]), density),
        "axis_offbeat_onset_ratio": ratio(s["n_off"], s["n"]),
        "axis_onset_density": ratio(s["n_onset"], s["n_bar"]),
        "axis_pc_entropy": F.when(s["w"] > 0, entropy / F.log(F.lit(12.0))).otherwise(0.0),
        "axis_pcs_per_bar": ratio(s["n_pcs"], s["n_heard"]),
        "axis_register_center": ratio(s["midi"], s["n"]),
        "axis_swing_ratio": ratio(s["n_swung"], s["n_inner"]),
        "axis_velocity_dynamic_range": F.when((s["n_no_vel"] == 0) & (s["n"] >= 2), spread(s["vel2"], s["vel"], s["n"])).otherwise(0.0),
    }


def bar_attribution(fr: Frames) -> DataFrame:
    """(piece_id, bar, axis, value, without, delta, rank): every decomposable axis with and without every bar.

    Rank 1 is the bar whose removal moves the axis most; earlier bars come first among equals.
    """
    states = bar_states(fr)
    sums = [c for c in states.columns if c not in ("piece_id", "bar", "n_bars")]
    piece = W.partitionBy("piece_id")
    totals = states.select("piece_id", "bar", *sums, *(F.sum(c).over(piece).alias(f"all_{c}") for c in sums))
    variants = F.array(
        F.struct(F.lit(True).alias("whole"), *(F.col(f"all_{c}").alias(c) for c in sums)),
        F.struct(F.lit(False).alias("whole"), *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums)),
    )
    both = totals.select("piece_id", "bar", F.explode(variants).alias("s")).select("piece_id", "bar", "s.*")
    values = axis_values({c: F.col(c) for c in sums})
    side = both.select("piece_id", "bar", "whole", *(v.alias(a) for a, v in values.items())).unpivot(["piece_id", "bar", "whole"], list(values), "axis", "v")
    pick = lambda whole: F.max(F.when(F.col("whole") == F.lit(whole), F.col("v")))
    long = side.groupBy("piece_id", "bar", "axis").agg(pick(True).alias("value"), pick(False).alias("without"))
    long = long.withColumn("delta", F.col("without") - F.col("value"))
    order = W.partitionBy("piece_id", "axis").orderBy(F.round(F.abs("delta"), 9).desc(), "bar")
    return long.withColumn("rank", F.row_number().over(order))


def copy_runs(gen: DataFrame, corpus: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Maximal runs of onsets that hold a copied note, at the best alignment with the best partner.

    Per run: piece_id, song, where it starts and ends in the piece (bar, onset), the bar of the song it starts in, how
    many onsets and copied notes it holds, and its rank by notes (earlier runs first among equals).
    """
    slot = F.rint(F.col("onb") * 100).cast("long")
    best = corpus_overlap(gen, corpus, exclude_self).filter("song is not null").select("piece_id", "song", "bar_offset")
    own = gen.select("piece_id", "bar", slot.alias("slot"), note_key().alias("k")).distinct().join(best, "piece_id")
    theirs = corpus.select(F.col("piece_id").alias("song"), F.col("bar").alias("src_bar"), note_key().alias("k"), F.lit(1).alias("hit")).distinct()
    seen = own.withColumn("src_bar", F.col("bar") + F.col("bar_offset")).join(theirs, ["song", "src_bar", "k"], "left")
    onsets = seen.groupBy("piece_id", "song", "bar", "slot", "src_bar").agg(F.count("hit").alias("notes"))
    order = W.partitionBy("piece_id").orderBy("bar", "slot")
    copied = onsets.withColumn("at", F.row_number().over(order)).where("notes > 0")
    island = copied.withColumn("run", F.col("at") - F.row_number().over(order))
    place, last = F.min(F.struct("bar", "slot", "src_bar")), F.max(F.struct("bar", "slot"))
    runs = island.groupBy("piece_id", "song", "run").agg(place.alias("a"), last.alias("z"), F.count("*").alias("n_onsets"), F.sum("notes").alias("n_notes"))
    rank = F.row_number().over(W.partitionBy("piece_id").orderBy(F.desc("n_notes"), "a.bar", "a.slot"))
    return runs.select(
        "piece_id", "song", F.col("a.bar").alias("from_bar"), (F.col("a.slot") / 100).alias("from_onset"), F.col("z.bar").alias("to_bar"),
        (F.col("z.slot") / 100).alias("to_onset"), F.col("a.src_bar").alias("src_bar"), "n_onsets", "n_notes", rank.alias("rank"),
    )
