"""Per-piece facts: ground truth, encoding cost, key guess, chord labels and difficulty grade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits, pitch
from stavelake.functions import numeric as num
from stavelake.operators.axes import MAJOR, MINOR
from stavelake.operators.frames import Frames
from stavelake.operators.structure import Structure

NEAR_IDENTICAL = 0.90
SYNCOPATED = 0.15


def encoding_cost(fr: Frames) -> DataFrame:
    """Work a reader must do to place notes: onset recovery, edit blast and vertical alignment."""
    per_voice_bar = fr.onsets.groupBy("piece_id", "voice", "bar").agg(F.sum("n").alias("n"))
    recovery = per_voice_bar.groupBy("piece_id").agg(F.sum(F.col("n") - 1).alias("onset_recovery"))
    blast = fr.voices.groupBy("piece_id").agg(
        F.sum("n").alias("n_notes"), F.count_distinct("voice").alias("n_voices"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("edit_blast"),
    )
    w = W.partitionBy("piece_id", "bar").orderBy("onb").rowsBetween(W.unboundedPreceding, -1)
    before = (
        fr.onsets.groupBy("piece_id", "bar", "onb").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .groupBy("piece_id").agg(F.sum("before").alias("vertical_align"), F.count_distinct("bar").alias("n_bars"))
    )
    return blast.join(recovery, "piece_id").join(before, "piece_id").select(
        "piece_id", "n_notes", "n_voices", "n_bars", "onset_recovery", "edit_blast", "vertical_align"
    )


def _is_triplet(onb: Column) -> Column:
    frac = F.pmod(onb, F.lit(1.0))
    binary = F.least(*[F.abs(frac - x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    triple = F.least(*[F.abs(frac - x) for x in (0.0, 1 / 3, 2 / 3, 1.0)])
    return triple + 1e-9 < binary


def ground_truth(fr: Frames) -> DataFrame:
    """The checkable facts of a piece, among them the largest similarity of two of its bars."""
    st = Structure(fr)
    onb, off = F.col("onb"), F.pmod(F.col("onb"), F.lit(1.0)) > 1e-6
    base = fr.events.join(fr.pieces.select("piece_id", "bar_ql"), "piece_id").groupBy("piece_id").agg(
        F.max("midi").alias("highest_midi"),
        F.min("midi").alias("lowest_midi"),
        F.max("dur").alias("longest_beats"),
        F.max(F.col("dur") > F.col("bar_ql") + 1e-6).alias("any_longer_than_bar"),
        F.bit_or(bits.pc_bit(F.col("pc"))).alias("pcs"),
        F.count(F.lit(1)).alias("n"),
        num.count_if(_is_triplet(onb)).alias("n_trip"),
        num.count_if(off).alias("n_off"),
    )
    bars = fr.onsets.groupBy("piece_id", "bar").agg(F.sum("n").alias("n"), F.min("first_seq").alias("s"))
    densest = bars.groupBy("piece_id").agg(F.max_by("bar", F.struct(F.col("n"), -F.col("s"))).alias("densest_bar"))
    values = fr.events.groupBy("piece_id", "dur").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"))
    named = values.groupBy("piece_id", pitch.note_value(F.col("dur")).alias("name")).agg(F.sum("n").alias("n"), F.min("s").alias("s"))
    value = named.groupBy("piece_id").agg(F.max_by("name", F.struct(F.col("n"), -F.col("s"))).alias("note_value"))
    lead = fr.lead_voice
    span = fr.voices.join(lead, ["piece_id", "voice"]).groupBy("piece_id", F.col("voice").alias("most_active_voice")).agg(
        (F.max("hi") - F.min("lo")).alias("active_span")
    )
    twin = st.similar_bars.groupBy("piece_id").agg(F.max("sim").alias("max_bar_sim"))
    df = base.join(densest, "piece_id").join(value, "piece_id").join(span, "piece_id", "left").join(twin, "piece_id", "left")
    return df.select(
        "piece_id", "highest_midi", "lowest_midi", "most_active_voice", F.coalesce("active_span", F.lit(0)).alias("active_span"),
        "longest_beats", "any_longer_than_bar", "densest_bar", F.coalesce("max_bar_sim", F.lit(0.0)).alias("max_bar_sim"),
        F.coalesce(F.col("max_bar_sim") >= NEAR_IDENTICAL, F.lit(False)).alias("near_identical_bars"),
        bits.size(F.col("pcs")).cast("int").alias("distinct_pc_count"), F.col("pcs").alias("present_pcs"),
        F.when(F.col("n_trip") > F.col("n") - F.col("n_trip"), "triplet").otherwise("straight").alias("subdivision"),
        (F.col("n_off") / F.col("n") >= SYNCOPATED).alias("syncopation"), "note_value",
    )


def constant_baselines(truth: DataFrame) -> DataFrame:
    """Accuracy of the best constant guess per fact."""
    out = None
    for fact in ("highest_midi", "lowest_midi", "most_active_voice", "densest_bar", "distinct_pc_count", "note_value",
                 "any_longer_than_bar", "near_identical_bars", "subdivision", "syncopation"):
        counts = truth.select(F.col(fact).cast("string").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg((F.max("n") / F.sum("n")).alias("accuracy")).select(F.lit(fact).alias("fact"), "accuracy")
        out = row if out is None else out.unionByName(row)
    for fact, tol in (("active_span", 10000), ("longest_beats", 2500)):
        # Counts per distinct value (a bounded alphabet, in ten-thousandths), then a range frame around each guess.
        counts = truth.select(F.rint(F.col(fact) * 10000).cast("long").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        near = W.partitionBy(F.lit(0)).orderBy("v").rangeBetween(-tol, tol)
        row = counts.withColumn("k", F.sum("n").over(near)).agg((F.max("k") / F.sum("n")).alias("accuracy"))
        out = out.unionByName(row.select(F.lit(fact).alias("fact"), "accuracy"))
    return out


def key_guess(fr: Frames) -> DataFrame:
    """Best of the 24 major and minor keys by note count; tonic order then major first settles ties."""
    counts = fr.pitches.groupBy("piece_id").agg(
        F.array(*[F.sum(F.when(F.col("midi") % 12 == k, F.col("n")).otherwise(0)) for k in range(12)]).alias("h")
    )
    def score(i):
        """Notes inside key i: even numbers are major, odd ones minor, two per tonic."""
        tonic = F.floor(i / 2)
        minor = i % 2 == 1

        def at(d):
            return F.element_at("h", (F.pmod(tonic + d, F.lit(12)) + 1).cast("int"))

        inside = reduce(lambda x, y: x + y, [at(d) if d == e else at(F.when(minor, e).otherwise(d)) for d, e in zip(MAJOR, MINOR)])
        return F.struct(inside.alias("score"), (-i).alias("o"), tonic.alias("tonic"), F.when(minor, "minor").otherwise("major").alias("mode"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(23)), score))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.withColumn("best", best).select(
        "piece_id", pitch.pc_name(F.col("best.tonic")).alias("tonic"), F.col("best.mode").alias("mode"),
        (1 - F.col("best.score") / total).alias("outside"),
    )


# Triad qualities in preference order, as (suffix, intervals).
TRIADS = (("", (0, 4, 7)), ("m", (0, 3, 7)), ("dim", (0, 3, 6)), ("aug", (0, 4, 8)))


def chord_label(weights: DataFrame) -> DataFrame:
    """Adds ``label`` for a column ``w`` of 12 weights: the best-covering triad, with a seventh where one really sounds."""
    def at(i):
        return F.element_at("w", (F.pmod(i, F.lit(12)) + 1).cast("int"))

    templates = F.array(*[F.struct(F.lit(s).alias("q"), F.lit(t[1]).alias("third"), F.lit(t[2]).alias("fifth"), F.lit(-i).alias("p"))
                          for i, (s, t) in enumerate(TRIADS)])

    def option(i):
        root, t = F.floor(i / 4), F.element_at(templates, (i % 4 + 1).cast("int"))
        cover = at(root) + at(root + t["third"]) + at(root + t["fifth"])
        return F.struct(F.round(cover, 9).alias("cover"), at(root).alias("rw"), t["p"].alias("p"), (-root).alias("o"),
                        root.alias("root"), t["q"].alias("q"), at(root + t["third"]).alias("third"), at(root + t["fifth"]).alias("fifth"))

    df = weights.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(47)), option)))
    root, q, rw = F.col("best.root"), F.col("best.q"), F.col("best.rw")
    ref = F.when(rw > 0, rw).otherwise(F.greatest("best.third", "best.fifth"))

    def strong(i):
        return (ref > 0) & (at(root + i) >= 0.5 * ref)

    suffix = (
        F.when(q == "", F.when(strong(10) | strong(11), "7").otherwise(""))
        .when(q == "m", F.when(strong(10), "m7").otherwise("m"))
        .when(q == "dim", F.when(strong(9), "dim7").when(strong(10), "m7").otherwise("dim"))
        .otherwise("aug")
    )
    return df.withColumn("label", F.concat(pitch.pc_name(root), suffix)).drop("best")


def bar_chords(fr: Frames) -> DataFrame:
    """Chord label per bar from the pitched notes struck in it, at half-bar resolution.

    Differing halves read "X | Y"; halves that share root and triad keep the longer label.
    """
    notes = fr.events.filter(~F.col("is_drum")).groupBy("piece_id", "abs", "dur", "pc").agg(F.count(F.lit(1)).alias("k"))
    half = F.col("bar_ql") / 2
    bar = F.floor(F.col("abs") / F.col("bar_ql"))
    spread = (
        notes.join(fr.pieces.select("piece_id", "bar_ql"), "piece_id")
        .withColumn("bar", bar).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("from", F.col("bar") * F.col("bar_ql") + F.col("h") * half)
        .withColumn("inside", F.least(F.col("abs") + F.col("dur"), F.col("from") + half) - F.greatest("abs", "from"))
        .filter("inside > 0")
    )
    per_half = spread.groupBy("piece_id", "bar", "h").agg(
        F.array(*[F.sum(F.when(F.col("pc") == k, F.col("inside") * F.col("k")).otherwise(0.0)) for k in range(12)]).alias("w")
    )
    pair = chord_label(per_half).groupBy("piece_id", "bar").agg(
        F.max(F.when(F.col("h") == 0, F.col("label"))).alias("l0"), F.max(F.when(F.col("h") == 1, F.col("label"))).alias("l1")
    )
    a, b = F.coalesce("l0", "l1"), F.coalesce("l1", "l0")

    def triad(label):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(label, "dim7$", "dim"), "m7$", "m"), "(?<!dim|m)7$", "")

    label = F.when(a == b, a).when(triad(a) == triad(b), F.when(F.length(a) >= F.length(b), a).otherwise(b)).otherwise(F.concat(a, F.lit(" | "), b))
    return pair.select("piece_id", (F.col("bar") + 1).cast("int").alias("bar"), label.alias("chord"))


# Meter difficulty, sharps or flats per major tonic, and factor weights.
METER_DIFFICULTY = {"4/4": 0.10, "3/4": 0.20, "2/4": 0.20, "6/8": 0.50, "9/8": 0.80, "12/8": 0.70}
KEY_ACCIDENTALS = {0: 0, 7: 1, 2: 2, 9: 3, 4: 4, 11: 5, 6: 6, 5: 1, 10: 2, 3: 3, 8: 4, 1: 5}
WEIGHTS = {
    "tempo": 0.12, "note_density": 0.14, "note_values": 0.14, "syncopation": 0.14, "rhythmic_variety": 0.10,
    "melodic_range_leaps": 0.12, "chromaticism": 0.08, "hand_span_polyphony": 0.08, "meter": 0.04, "key_signature": 0.04,
}


def difficulty(fr: Frames) -> DataFrame:
    """Ten clamped factors, weighted to a 0..100 score and a 1..10 grade; the key is guessed."""
    cols = fr.pieces.columns
    head = fr.pieces.select(
        "piece_id",
        F.coalesce(F.col("tempo"), F.lit(90.0)).alias("tempo") if "tempo" in cols else F.lit(90.0).alias("tempo"),
        F.concat_ws("/", "meter_num", "meter_den").alias("meter") if "meter_num" in cols else F.lit("4/4").alias("meter"),
        (F.lit(4.0) / F.col("meter_den") if "meter_den" in cols else F.lit(1.0)).alias("unit"),
    )
    trip = fr.bars.groupBy("piece_id").agg(F.max((F.col("grid") == 12) & F.col("is_triplet")).alias("trip"))
    ev = fr.events.join(head.select("piece_id", "unit"), "piece_id").groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("dur", F.lit(0.5)).alias("median"),
        F.count_distinct(F.round("dur", 2)).alias("n_dur"),
        num.count_if(F.round(F.pmod(F.col("onb") / F.col("unit"), F.lit(1.0)), 3) != 0).alias("n_off"),
        (F.max("midi") - F.min("midi")).alias("reach"),
    )
    nb = fr.bar_levels.groupBy("piece_id").agg(F.count(F.lit(1)).alias("nb"))
    together = fr.onsets.groupBy("piece_id", "bar", F.round("onb", 3).alias("o")).agg(
        F.sum("n").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    step = F.abs(F.col("hi") - F.lag("hi").over(W.partitionBy("piece_id").orderBy("bar", "o")))
    tops = together.withColumn("step", step).groupBy("piece_id").agg(
        F.max(F.when(F.col("k") > 1, F.col("hi") - F.col("lo"))).alias("span"),
        F.max("k").alias("sim"),
        F.avg(F.when(F.col("step").isNotNull(), (F.col("step") >= 3).cast("double"))).alias("leaps"),
    )
    key = key_guess(fr)
    tonic = F.array_position(F.array(*map(F.lit, pitch.SHARP_NAMES)), F.col("tonic")) - 1
    relative = F.pmod(tonic + F.when(F.col("mode") == "minor", 3).otherwise(0), F.lit(12)).cast("int")
    accidentals = F.element_at(F.create_map(*[F.lit(x) for kv in KEY_ACCIDENTALS.items() for x in kv]), relative)
    meter = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METER_DIFFICULTY.items() for x in kv]), F.col("meter")), F.lit(0.6))
    bonus = F.when(F.col("trip"), F.lit(1.0)).otherwise(F.lit(0.0))

    def unit(x):
        return num.clamp(x, 0.0, 1.0)

    factors = {
        "tempo": (F.col("tempo") - 60) / 120,
        "note_density": (F.col("n") / F.col("nb") - 2) / 10,
        "note_values": unit(1.25 - F.col("median")) + 0.15 * bonus,
        "syncopation": F.col("n_off") / F.col("n"),
        "rhythmic_variety": unit(F.col("n_dur") / 6) + 0.1 * bonus,
        "melodic_range_leaps": unit(F.col("reach") / 24) * 0.5 + F.coalesce("leaps", F.lit(0.0)) * 0.5,
        "chromaticism": F.col("outside") * 4,
        "hand_span_polyphony": unit(F.coalesce("span", F.lit(0)) / 24) * 0.6 + unit((F.col("sim") - 1) / 3) * 0.4,
        "meter": meter,
        "key_signature": accidentals / 6,
    }
    df = ev
    for other in (head, nb, tops, key):
        df = df.join(other, "piece_id")
    df = df.join(trip, "piece_id", "left").select("piece_id", "tonic", "mode", *[unit(x).alias(k) for k, x in factors.items()])
    score = F.round(sum((F.col(k) * w for k, w in list(WEIGHTS.items())[1:]), F.col("tempo") * WEIGHTS["tempo"]), 9)
    return df.withColumn("score", score).select(
        "piece_id", "tonic", "mode", *[F.round(k, 3).alias(k) for k in factors],
        F.round(F.col("score") * 100, 1).alias("score_0_100"),
        F.greatest(F.lit(1), F.least(F.lit(10), F.rint(F.col("score") * 9 + 1).cast("int"))).alias("grade_1_10"),
    )
