"""The 39 fingerprint axes.

Axes of one grain share one aggregation ("family"). ``axis_value`` plans only the family an axis
needs; ``fingerprint_wide`` joins all families on the piece key; ``fingerprint`` is the long form.
Every axis is 0.0 where it is undefined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.frames import Frames

# Major and natural minor scale degrees.
MAJOR = (0, 2, 4, 5, 7, 9, 11)
MINOR = (0, 2, 3, 5, 7, 8, 10)
# Tertian degree classes above the bass (third, fifth, seventh, ninth, eleventh, thirteenth).
TERTIAN = ((3, 4), (7,), (10, 11), (1, 2), (5, 6), (8, 9))

SEQ_CHUNK_BITS = 20


# -- note grain ------------------------------------------------------------------------------
def _note_family(fr: Frames) -> DataFrame:
    onb, dur, vel = F.col("onb"), F.col("dur"), F.col("vel")
    beat = num.half_even(onb)
    on_beat = F.abs(onb - beat) < 0.12
    frac = onb - F.floor(onb)
    inner = (frac >= 0.12) & (frac <= 0.88)
    swung = F.least(F.abs(frac - 0.667), F.abs(frac - 0.333)) < F.abs(frac - 0.5)
    sounding = F.when(dur > 0, dur)
    agg = fr.events.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n"),
        num.count_if(F.col("is_drum")).alias("n_drum"),
        num.count_if(num.off_beat(onb)).alias("n_off"),
        num.count_if(inner).alias("n_inner"),
        num.count_if(inner & swung).alias("n_swung"),
        F.avg(sounding).alias("dur_mean"),
        F.stddev_pop(sounding).alias("dur_sd"),
        F.count(sounding).alias("n_dur"),
        F.sum(dur).alias("dur_sum"),
        F.min("abs").alias("start"),
        F.max(F.col("abs") + dur).alias("end"),
        F.avg("midi").alias("midi_mean"),
        F.sum(F.when(on_beat & beat.isin(1.0, 3.0), vel)).alias("vel_back"),
        F.sum(F.when(on_beat & beat.isin(0.0, 2.0), vel)).alias("vel_front"),
        num.count_if(on_beat & vel.isNull()).alias("n_silent_beat"),
        num.count_if(vel.isNull()).alias("n_no_vel"),
        F.stddev_pop(vel.cast("double")).alias("vel_sd"),
    )
    back = F.coalesce(F.col("vel_back"), F.lit(0))
    front = F.coalesce(F.col("vel_front"), F.lit(0))
    return agg.select(
        "piece_id",
        F.when(F.col("n_silent_beat") > 0, 0.0).otherwise(num.ratio(back, back + front)).alias("axis_backbeat_emphasis"),
        num.ratio(F.col("n_drum"), F.col("n")).alias("axis_drum_ratio"),
        F.when(F.col("n_dur") >= 2, num.cv(F.col("dur_sd"), F.col("dur_mean"))).alias("axis_duration_cv"),
        F.col("dur_mean").alias("axis_mean_note_length"),
        num.ratio(F.col("n_off"), F.col("n")).alias("axis_offbeat_onset_ratio"),
        num.ratio(F.col("dur_sum"), F.col("end") - F.col("start")).alias("axis_polyphony"),
        F.col("midi_mean").alias("axis_register_center"),
        num.ratio(F.col("n_swung"), F.col("n_inner")).alias("axis_swing_ratio"),
        F.when((F.col("n_no_vel") == 0) & (F.col("n") >= 2), F.col("vel_sd")).alias("axis_velocity_dynamic_range"),
    )


# -- voice grain -----------------------------------------------------------------------------
def _voice_family(fr: Frames) -> DataFrame:
    agg = fr.voices.groupBy("piece_id").agg(
        F.count_distinct("voice").alias("n_voice"),
        F.stddev_pop(F.when(~F.col("is_drum"), F.col("avg_midi"))).alias("sep"),
        num.count_if(~F.col("is_drum")).alias("n_pitched"),
    )
    programs = fr.voices.filter(F.col("program").isNotNull()).groupBy("piece_id", "program").agg(F.sum("n").alias("n"))
    # At most 128 pitches per voice: the exact median comes from the histogram.
    reach = fr.pitches.groupBy("piece_id").agg(
        F.when(F.sum("n") >= 2, F.percentile("midi", F.lit(0.5), F.col("n")) - F.min("midi")).alias("axis_bass_register_gap")
    )
    kits = fr.pitches.filter("is_drum").groupBy("piece_id", "midi").agg(F.sum("n").alias("n"))
    return (
        agg.join(_entropy(programs, "axis_instrument_diversity"), "piece_id", "left")
        .join(_entropy(kits, "axis_drum_timbre_entropy"), "piece_id", "left")
        .join(reach, "piece_id", "left")
        .select(
            "piece_id",
            "axis_bass_register_gap",
            F.col("n_voice").cast("double").alias("axis_active_voice_count"),
            F.when(F.col("n_pitched") >= 2, F.col("sep")).alias("axis_voice_register_separation"),
            "axis_instrument_diversity",
            "axis_drum_timbre_entropy",
        )
    )


def _entropy(counts: DataFrame, name: str) -> DataFrame:
    """Natural-log entropy from counts n, as ln N - sum(n ln n)/N, in one pass."""
    n, total = F.col("n").cast("double"), F.sum("n")
    return counts.groupBy("piece_id").agg((F.log(total) - F.sum(n * F.log(n)) / total).alias(name))


# -- pitch-class weights ---------------------------------------------------------------------
def _tonal_family(fr: Frames) -> DataFrame:
    def mass(root, degrees):
        return reduce(lambda a, b: a + b, [at(root, d) for d in degrees])

    def best_root(degrees):
        """Root of largest mass; the lowest root wins a tie."""
        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: F.struct(mass(r, degrees).alias("m"), (-r).alias("r"))))

    def scale_mass(root):
        return F.greatest(mass(root, MAJOR), mass(root, MINOR))

    def at(root, interval):
        return F.element_at("w", ((root + interval) % 12 + 1).cast("int"))

    total = F.col("total")
    inside = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), scale_mass))
    spread = F.aggregate("w", F.lit(0.0), lambda a, x: a + num.plogp(x, total))
    df = fr.pc_weights.filter(total > 0).select(
        "piece_id",
        "w",
        "total",
        (-best_root((0, 4, 7))["r"]).alias("blues_root"),
        (-best_root((0, 7))["r"]).alias("fifth_root"),
        (1.0 - inside / total).alias("axis_chromaticism"),
        (spread / F.log(F.lit(12.0))).alias("axis_pc_entropy"),
    )
    blues, fifth = F.col("blues_root"), F.col("fifth_root")
    return df.select(
        "piece_id",
        ((at(blues, 3) + at(blues, 6) + at(blues, 10)) / total).alias("axis_blue_note_content"),
        ((at(fifth, 4) - at(fifth, 3)) / total).alias("axis_mode_majorness"),
        "axis_chromaticism",
        "axis_pc_entropy",
    )


# -- bars ------------------------------------------------------------------------------------
def _bar_family(fr: Frames) -> DataFrame:
    n_bars = fr.pieces.select("piece_id", "n_bars")
    inside = fr.bar_levels.join(n_bars, "piece_id").filter((F.col("bar") >= 1) & (F.col("bar") <= F.col("n_bars")))
    w = W.partitionBy("piece_id").orderBy("bar")
    # Silent bars are not materialised: a gap after a sounding bar stands for two full turnovers
    # (into and out of silence), silence at either end for one, and silent pairs do not count.
    steps = inside.select(
        "*",
        F.lag("bar").over(w).alias("prev_bar"),
        F.lag("pcs").over(w).alias("prev_pcs"),
        F.lead("bar").over(w).alias("next_bar"),
    )
    adjacent = F.col("prev_bar") == F.col("bar") - 1
    opened = F.col("prev_bar").isNull() & (F.col("bar") > 1)
    closed = F.col("next_bar").isNull() & (F.col("bar") < F.col("n_bars"))
    gap = F.col("prev_bar") < F.col("bar") - 1
    turnover = F.when(adjacent, 1.0 - bits.jaccard(F.col("pcs"), F.col("prev_pcs")))
    edges = opened.cast("int") + closed.cast("int") + 2 * F.coalesce(gap.cast("int"), F.lit(0))
    agg = steps.groupBy("piece_id", "n_bars").agg(
        F.avg(F.when(F.col("n") >= 2, F.col("hi") - F.col("lo"))).alias("axis_bar_pitch_range_mean"),
        F.avg(bits.size(F.col("pcs"))).alias("axis_pcs_per_bar"),
        F.sum(turnover).alias("turn"),
        F.count(turnover).alias("n_turn"),
        F.sum(edges).alias("n_edge"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
    )
    mean = F.col("n") / F.col("n_bars")
    variance = F.greatest(F.col("n2") / F.col("n_bars") - mean * mean, F.lit(0.0))
    long_enough = F.col("n_bars") >= 2
    return agg.select(
        "piece_id",
        "axis_bar_pitch_range_mean",
        "axis_pcs_per_bar",
        F.when(
            long_enough,
            num.ratio(F.coalesce(F.col("turn"), F.lit(0.0)) + F.col("n_edge"), F.col("n_turn") + F.col("n_edge")),
        ).alias("axis_harmonic_rhythm"),
        F.when(long_enough, num.cv(F.sqrt(variance), mean)).alias("axis_note_density_bar_variability"),
    )


# -- quarter-beat instants -------------------------------------------------------------------
def _instant_family(fr: Frames) -> DataFrame:
    size, above, pcs = F.col("size"), F.col("above_bass"), F.col("pcs")
    chordal, full = size >= 2, size >= 3
    third = bits.has(above, 3, 4)
    tense = bits.pairs_at(pcs, 1) + bits.pairs_at(pcs, 2) + bits.pairs_at(pcs, 6)
    depth = reduce(lambda a, b: a + b, [bits.has(above, *d).cast("int") for d in TERTIAN])
    shape = F.when(chordal, bits.rotate_down(pcs, bits.lowest(pcs)))
    agg = fr.instants.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(size).alias("axis_chord_simultaneity_size"),
        F.count_distinct(shape).alias("n_shape"),
        num.count_if(chordal).alias("n_chord"),
        F.sum(F.when(chordal, tense)).alias("tense"),
        F.sum(F.when(chordal, size * (size - 1) / 2)).alias("pairs"),
        num.count_if(F.col("many_voices")).alias("n_sync"),
        num.count_if(chordal & bits.has(above, 7) & ~third).alias("n_power"),
        num.count_if(full).alias("n_full"),
        num.count_if(full & third & bits.has(above, 10, 11)).alias("n_seventh"),
        F.avg(F.when(chordal, depth)).alias("axis_tertian_stack_depth"),
    )
    return agg.select(
        "piece_id",
        "axis_chord_simultaneity_size",
        num.ratio(F.col("n_shape"), F.col("n_chord")).alias("axis_chord_type_diversity"),
        num.ratio(F.col("tense"), F.col("pairs")).alias("axis_dissonant_interval_ratio"),
        num.ratio(F.col("n_sync"), F.col("n")).alias("axis_onset_synchrony"),
        num.ratio(F.col("n_power"), F.col("n_chord")).alias("axis_power_chord_ratio"),
        num.ratio(F.col("n_seventh"), F.col("n_full")).alias("axis_seventh_chord_ratio"),
        "axis_tertian_stack_depth",
    )


# -- bass voice ------------------------------------------------------------------------------
def _bass_family(fr: Frames) -> DataFrame:
    bass = fr.bass_voice
    per_bar = (
        fr.onsets.join(bass, ["piece_id", "voice"])
        .groupBy("piece_id", "bar")
        .agg(
            F.bit_or("pcs").alias("pcs"),
            F.sum("n").alias("n"),
            F.sum(F.when(num.off_beat(F.col("onb")), F.col("n")).otherwise(0)).alias("n_off"),
        )
        .groupBy("piece_id")
        .agg(
            F.avg(bits.size(F.col("pcs"))).alias("axis_bass_walk_rate"),
            F.sum("n").alias("n"),
            F.sum("n_off").alias("n_off"),
        )
    )
    pedal = (
        fr.pitches.join(bass, ["piece_id", "voice"])
        .groupBy("piece_id", (F.col("midi") % 12).alias("pc"))
        .agg(F.sum("pos_dur").alias("dur"))
        .groupBy("piece_id")
        .agg(num.ratio(F.max("dur"), F.sum("dur")).alias("axis_tonic_pedal_fraction"))
    )
    return per_bar.join(pedal, "piece_id").select(
        "piece_id",
        "axis_bass_walk_rate",
        F.when(F.col("n") >= 2, F.col("n_off") / F.col("n")).alias("axis_bass_syncopation"),
        "axis_tonic_pedal_fraction",
    )


# -- top line of the busiest voice -----------------------------------------------------------
def _line_family(fr: Frames) -> DataFrame:
    line = fr.top_line(fr.lead_voice)
    moves = line.filter(F.col("step") != 0).select("piece_id", "abs", F.signum("step").alias("sign"))
    turns = moves.withColumn(
        "turned", F.col("sign") != F.lag("sign").over(W.partitionBy("piece_id").orderBy("abs"))
    ).groupBy("piece_id").agg(num.ratio(num.count_if(F.col("turned")), F.count("turned")).alias("axis_contour_reversal_rate"))
    steps = line.groupBy("piece_id").agg(
        F.avg(F.abs("step")).alias("axis_melodic_interval_mean"),
        F.avg(F.when(F.col("step").isNotNull(), (F.col("step") == 0).cast("double"))).alias("axis_repeated_note_ratio"),
    )
    return steps.join(turns, "piece_id", "left")


# -- onsets ----------------------------------------------------------------------------------
def _onset_family(fr: Frames) -> DataFrame:
    w = W.partitionBy("piece_id", "voice").orderBy("abs")
    gap = F.lead("abs").over(w) - F.col("abs")
    held = F.when(
        (gap > 1e-6) & F.col("voice_ix").isNotNull() & ~F.col("is_drum"),
        F.least(F.col("last_dur") / gap, F.lit(3.0)),
    )
    agg = (
        fr.voice_onsets.select("piece_id", held.alias("held"))
        .groupBy("piece_id")
        .agg(F.avg("held").alias("axis_legato_ratio"), F.count(F.lit(1)).alias("n"))
    )
    return agg.join(fr.pieces.select("piece_id", "n_bars"), "piece_id").select(
        "piece_id", "axis_legato_ratio", num.ratio(F.col("n"), F.col("n_bars")).alias("axis_onset_density")
    )


def _leader_family(fr: Frames) -> DataFrame:
    """Busiest pitched voice per beat; the voice heard first in the beat wins a tie."""
    leaders = (
        fr.onsets.filter(~F.col("is_drum"))
        .groupBy("piece_id", F.floor("abs").alias("beat"), "voice")
        .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
        .groupBy("piece_id", "beat")
        .agg(F.max_by("voice", F.struct(F.col("n"), -F.col("first_seq"))).alias("voice"))
    )
    changed = F.col("voice") != F.lag("voice").over(W.partitionBy("piece_id").orderBy("beat"))
    return (
        leaders.select("piece_id", changed.cast("double").alias("changed"))
        .groupBy("piece_id")
        .agg(F.avg("changed").alias("axis_leader_turnover"))
    )


def _jitter_family(fr: Frames) -> DataFrame:
    """Mean absolute velocity change between consecutive notes in (abs, seq) order.

    The order is walked in three nested steps (within a sequence chunk, across the chunks of an
    onset, across onsets), so no task ever sorts all notes of a piece.
    """
    def walk(df, keys, order):
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn("jump", F.abs(F.col("first_vel") - F.lag("last_vel").over(w)))

    def roll_up(df, keys, order):
        key = order[0]
        return df.groupBy(*keys).agg(
            (F.sum("total") + F.coalesce(F.sum("jump"), F.lit(0))).alias("total"),
            (F.sum("pairs") + F.count("jump")).alias("pairs"),
            F.min_by("first_vel", key).alias("first_vel"),
            F.max_by("last_vel", key).alias("last_vel"),
            F.max("gaps").alias("gaps"),
        )

    notes = fr.events.select(
        "piece_id", "abs", F.shiftright("seq", SEQ_CHUNK_BITS).alias("chunk"), "seq",
        F.col("vel").alias("first_vel"), F.col("vel").alias("last_vel"),
        F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("pairs"),
        F.col("vel").isNull().cast("int").alias("gaps"),
    )
    df = notes
    for keys, order in (
        (["piece_id", "abs", "chunk"], ["seq"]),
        (["piece_id", "abs"], ["chunk"]),
        (["piece_id"], ["abs"]),
    ):
        df = roll_up(walk(df, keys, order), keys, order)
    return df.select(
        "piece_id",
        F.when(F.col("gaps") == 0, num.ratio(F.col("total"), F.col("pairs"))).alias("axis_velocity_jitter"),
    )


FAMILIES = {
    _note_family: (
        "axis_backbeat_emphasis", "axis_drum_ratio", "axis_duration_cv",
        "axis_mean_note_length", "axis_offbeat_onset_ratio", "axis_polyphony", "axis_register_center",
        "axis_swing_ratio", "axis_velocity_dynamic_range",
    ),
    _voice_family: (
        "axis_active_voice_count", "axis_voice_register_separation", "axis_instrument_diversity", "axis_bass_register_gap",
        "axis_drum_timbre_entropy",
    ),
    _tonal_family: ("axis_blue_note_content", "axis_mode_majorness", "axis_chromaticism", "axis_pc_entropy"),
    _bar_family: (
        "axis_bar_pitch_range_mean", "axis_pcs_per_bar", "axis_harmonic_rhythm", "axis_note_density_bar_variability",
    ),
    _instant_family: (
        "axis_chord_simultaneity_size", "axis_chord_type_diversity", "axis_dissonant_interval_ratio",
        "axis_onset_synchrony", "axis_power_chord_ratio", "axis_seventh_chord_ratio", "axis_tertian_stack_depth",
    ),
    _bass_family: ("axis_bass_walk_rate", "axis_bass_syncopation", "axis_tonic_pedal_fraction"),
    _line_family: ("axis_contour_reversal_rate", "axis_melodic_interval_mean", "axis_repeated_note_ratio"),
    _onset_family: ("axis_legato_ratio", "axis_onset_density"),
    _leader_family: ("axis_leader_turnover",),
    _jitter_family: ("axis_velocity_jitter",),
}
FAMILY_OF = {axis: family for family, names in FAMILIES.items() for axis in names}
AXES = tuple(sorted(FAMILY_OF))


def _or_zero(name: str):
    return F.when(F.isnan(name), 0.0).otherwise(F.coalesce(F.col(name).cast("double"), F.lit(0.0))).alias(name)


def axis_value(fr: Frames, axis: str) -> DataFrame:
    """One axis for every piece: (piece_id, value)."""
    family = FAMILY_OF[axis](fr).select("piece_id", axis)
    return (
        fr.pieces.select("piece_id").join(family, "piece_id", "left").select("piece_id", _or_zero(axis)).withColumnRenamed(axis, "value")
    )


def fingerprint_wide(fr: Frames, extra: tuple[str, ...] = ()) -> DataFrame:
    """All 39 axes, one row per piece."""
    df = fr.pieces.select("piece_id", *extra)
    for family in FAMILIES:
        # Kept one by one, so that a task holds the buffers of one family and not of all.
        df = df.join(fr.keep(family(fr)), "piece_id", "left")
    return df.select("piece_id", *extra, *[_or_zero(a) for a in AXES])


def to_long(wide: DataFrame, keep: tuple[str, ...] = ("piece_id",), axes: tuple[str, ...] = AXES) -> DataFrame:
    """Unpivot to (keep..., axis, value)."""
    return wide.unpivot(list(keep), list(axes), "axis", "value")


def fingerprint(fr: Frames, extra: tuple[str, ...] = ()) -> DataFrame:
    return to_long(fingerprint_wide(fr, extra), ("piece_id", *extra))
