"""The legacy metric bank: rhythm, harmony, melody, texture and form values per piece, and the candidate metrics.

Entropies here are normalized by the log of the number of nonzero classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.axes import MAJOR
from stavelake.operators.frames import Frames
from stavelake.operators.structure import AUG, DIM, DOM7, Structure, roots_holding


def _even_entropy(counts: DataFrame, name: str) -> DataFrame:
    """Normalized entropy of positive counts n per piece; 0.0 with fewer than two classes."""
    n, total = F.col("n").cast("double"), F.sum("n")
    h = F.log(total) - F.sum(n * F.log(n)) / total
    return counts.filter("n > 0").groupBy("piece_id").agg(
        F.when(F.count(F.lit(1)) > 1, h / F.log(F.count(F.lit(1)))).otherwise(0.0).alias(name)
    )


def _rhythm(st: Structure) -> DataFrame:
    fr = st.fr
    ql = fr.pieces.select("piece_id", "bar_ql")
    in_bar = F.pmod(F.col("abs"), F.col("bar_ql"))
    onsets = fr.voice_onsets.join(ql, "piece_id").groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n_on"),
        F.sum("n").alias("n"),
        num.count_if(F.pmod(in_bar, F.lit(1.0)) > 1e-6).alias("n_off"),
        F.max(F.when(F.col("n") >= 2, F.col("hi") - F.col("lo"))).alias("width"),
    )
    places = fr.onsets.join(ql, "piece_id").groupBy("piece_id", F.rint(in_bar / 0.25).alias("pos")).agg(F.sum("n").alias("n"))
    durs = fr.events.groupBy("piece_id").agg(F.avg("dur").alias("m"), F.stddev_pop("dur").alias("sd"))
    per_bar = fr.bar_levels.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("nb"), F.stddev_pop("n").alias("sd_n"), F.avg("n").alias("avg_n"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    trip = fr.bars.groupBy("piece_id").agg(F.avg(F.col("is_triplet").cast("double")).alias("rhy_triplet_share"))
    return (
        onsets.join(per_bar, "piece_id").join(durs, "piece_id")
        .join(_even_entropy(places, "rhy_onset_pos_entropy"), "piece_id", "left")
        .join(trip, "piece_id", "left")
        .select(
            "piece_id", "rhy_onset_pos_entropy", "rhy_triplet_share",
            (F.col("n_off") / F.col("n_on")).alias("rhy_syncopation_rate"),
            (F.col("n_on") / F.col("nb")).alias("rhy_onset_density_per_bar"),
            num.cv(F.col("sd"), F.col("m")).alias("rhy_dur_cv"),
            F.col("m").alias("rhy_mean_dur_beats"),
            num.cv(F.col("sd_n"), F.col("avg_n")).alias("rhy_density_variability"),
            (F.col("hi") - F.col("lo")).cast("double").alias("mel_pitch_range"),
            (F.col("n") / F.col("n_on")).alias("tex_mean_simultaneity"),
            F.col("width").cast("double").alias("tex_max_chord_width"),
        )
    )


def _harmony(st: Structure) -> DataFrame:
    fr = st.fr

    def major_mass(root):
        return reduce(lambda a, b: a + b, [F.element_at("w", ((root + d) % 12 + 1).cast("int")) for d in MAJOR])

    inside = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), major_mass))
    weights = fr.pc_weights.select(
        "piece_id",
        num.ratio(F.col("total") - inside, F.col("total")).alias("har_chromaticism"),
        F.size(F.filter("w", lambda x: x > 0)).cast("double").alias("har_distinct_pc"),
    )
    spread = _even_entropy(fr.pc_weights.select("piece_id", F.explode("w").alias("n")), "har_pc_entropy")
    order = W.partitionBy("piece_id").orderBy("bar", "half")
    # Silent halves of a sounding bar break adjacency: only half 0 -> 1 of a bar and 1 -> 0 of the next count.
    follows = (F.lag("bar").over(order) == F.col("bar")) | ((F.lag("half").over(order) == 1) & (F.col("half") == 0))
    halves = st.half_bars.select("piece_id", "bar", "pcs", (follows & (F.col("pcs") != F.lag("pcs").over(order))).alias("moved"))
    chords = halves.groupBy("piece_id").agg(
        num.count_if(F.col("moved")).alias("moves"), F.count_distinct("pcs").alias("vocab"), F.max("bar").alias("_")
    )
    nb = fr.bar_levels.groupBy("piece_id").agg(F.count(F.lit(1)).alias("nb"))
    motion = st.bass_bars.filter(F.col("prev").isNotNull()).select("piece_id", F.pmod(F.col("lo") - F.col("prev"), F.lit(12)).alias("t"))
    fourths = motion.groupBy("piece_id").agg(F.avg((F.col("t") == 5).cast("double")).alias("har_fourth_motion_rate"))
    turns = _even_entropy(motion.groupBy("piece_id", "t").agg(F.count(F.lit(1)).alias("n")), "har_root_motion_entropy")
    pcs = F.col("pcs")
    sonorities = st.prominent_bars.groupBy("piece_id").agg(
        num.count_if(roots_holding(pcs, DOM7) > 0).alias("dom"),
        num.count_if(roots_holding(pcs, DIM) > 0).alias("dim"),
        F.sum(roots_holding(pcs, AUG)).alias("aug"),
    )
    df = weights.join(spread, "piece_id", "left").join(chords, "piece_id", "left").join(nb, "piece_id")
    df = df.join(fourths, "piece_id", "left").join(turns, "piece_id", "left").join(sonorities, "piece_id", "left")
    return df.select(
        "piece_id", "har_chromaticism", "har_distinct_pc", "har_pc_entropy", "har_fourth_motion_rate", "har_root_motion_entropy",
        (F.col("moves") / F.greatest(F.lit(1), 2 * F.col("nb") - 1)).alias("har_chord_change_rate"),
        (F.col("vocab") / F.col("nb")).alias("har_vocab_density"),
        (F.col("dom") / F.col("nb")).alias("har_dom7_rate"),
        ((F.col("dim") + F.least("aug", "nb")) / F.col("nb")).alias("har_dimaug_rate"),
        (F.col("dom") > 0).cast("double").alias("har_has_dom7_ANY"),
        (F.col("dim") > 0).cast("double").alias("har_has_dim_ANY"),
    )


def _melody(st: Structure) -> DataFrame:
    fr = st.fr
    moves = fr.top_line(fr.role_voices, "melody").filter(F.col("step") != 0)
    size = F.abs("step")
    agg = moves.groupBy("piece_id").agg(
        F.avg((size <= 2).cast("double")).alias("mel_step_ratio"),
        F.avg(size).alias("mel_mean_abs_interval"),
        F.avg((F.col("step") > 0).cast("double")).alias("mel_up_ratio"),
    )
    kinds = moves.groupBy("piece_id", F.least(size, F.lit(12)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    reach = fr.voices.groupBy("piece_id", "voice").agg((F.max("hi") - F.min("lo")).cast("double").alias("mel_voice_range"))
    picked = fr.role_voices.select("piece_id", F.col("melody").alias("voice"))
    return (
        picked.join(reach, ["piece_id", "voice"]).drop("voice")
        .join(agg, "piece_id", "left")
        .join(_even_entropy(kinds, "mel_interval_entropy"), "piece_id", "left")
        .withColumn("mel_up_ratio", F.coalesce("mel_up_ratio", F.lit(0.5)))
    )


def _texture(st: Structure) -> DataFrame:
    fr = st.fr
    count = fr.voices.filter(F.col("voice_ix").isNotNull()).groupBy("piece_id").agg(
        F.count_distinct("voice").cast("double").alias("tex_voice_count")
    )
    active = (
        fr.onsets.groupBy("piece_id", "bar", "voice").agg(F.lit(1).alias("x"))
        .groupBy("piece_id", "bar").agg(F.count("x").alias("k"))
        .groupBy("piece_id").agg(F.avg("k").alias("tex_active_voice_density"))
    )
    pairs = st.voice_pairs.filter("shared >= 12").groupBy("piece_id").agg(
        F.avg((F.col("same") / F.col("shared") >= 0.9).cast("double")).alias("tex_doubling_ratio")
    )
    return count.join(active, "piece_id").join(pairs, "piece_id", "left")


def _form(st: Structure) -> DataFrame:
    n = F.col("n")
    sets = st.bar_sets.groupBy("piece_id").agg(F.max("n").alias("n"), F.count_distinct("sig").alias("kinds"))
    sims = st.similar_bars.groupBy("piece_id").agg(
        F.sum("sim").alias("all"), F.sum(F.when(F.col("j") == F.col("i") + 1, F.col("sim"))).alias("next")
    )
    blocks = st.four_bars.groupBy("piece_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("key").alias("block_kinds"))
    df = sets.join(sims, "piece_id", "left").join(blocks, "piece_id", "left").join(novelty_peaks(st), "piece_id", "left")
    zero = F.lit(0.0)
    return df.select(
        "piece_id",
        F.when(n >= 2, F.coalesce("all", zero) / (n * (n - 1) / 2)).otherwise(1.0).alias("form_self_similarity"),
        F.when(n >= 2, 1 - F.coalesce("next", zero) / (n - 1)).otherwise(0.0).alias("form_novelty_rate"),
        (F.col("kinds") / n).alias("form_distinct_bar_frac"),
        num.ratio(F.col("blocks") - F.col("block_kinds"), F.col("blocks")).alias("form_reprise_frac"),
        ((F.coalesce("peaks", F.lit(0)) + 1) / n * 100).alias("form_section_per100bars"),
    )


def novelty_peaks(st: Structure) -> DataFrame:
    """Peaks of the checkerboard novelty curve per piece.

    Only similar pairs and the diagonal carry weight; each spreads to the centres whose window holds it.
    """
    diagonal = st.bar_sets.select("piece_id", F.col("ix").alias("i"), F.col("ix").alias("j"), "n", F.lit(1.0).alias("sim"))
    pairs = st.similar_bars.select("piece_id", "i", "j", "n", "sim").unionByName(diagonal)
    half = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    lo = F.greatest(F.col("j") - F.col("L") + 1, F.lit(0))
    hi = F.least(F.col("i") + F.col("L"), F.col("n") - 1)
    spread = pairs.withColumn("L", half).filter(lo <= hi).withColumn("c", F.explode(F.sequence(lo, hi)))
    sign = F.when((F.col("i") < F.col("c")) == (F.col("j") < F.col("c")), 1).otherwise(-1)
    weight = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    valid = F.least(F.col("c") + F.col("L"), F.col("n")) - F.greatest(F.col("c") - F.col("L"), F.lit(0))
    curve = spread.groupBy("piece_id", "c", "n", "L").agg(F.sum(sign * weight * F.col("sim")).alias("s")).select(
        "piece_id", "c", "n", F.round(F.col("s") / (valid * valid), 9).alias("nov")
    )
    cut = curve.groupBy("piece_id").agg(F.round(F.avg("nov") + 0.5 * F.stddev_pop("nov"), 9).alias("cut"))
    w = W.partitionBy("piece_id").orderBy("c")
    nov = F.col("nov")
    peak = (F.col("c") >= 1) & (F.col("c") <= F.col("n") - 2) & (nov >= F.col("cut")) & (nov >= F.col("before")) & (nov >= F.col("after"))
    return (
        curve.withColumn("before", F.lag("nov").over(w)).withColumn("after", F.lead("nov").over(w))
        .join(cut, "piece_id").groupBy("piece_id").agg(num.count_if(peak).alias("peaks"))
    )


PARTS = {
    _rhythm: ("rhy_syncopation_rate", "rhy_onset_density_per_bar", "rhy_triplet_share", "rhy_onset_pos_entropy", "rhy_dur_cv",
              "rhy_mean_dur_beats", "rhy_density_variability", "mel_pitch_range", "tex_mean_simultaneity", "tex_max_chord_width"),
    _harmony: ("har_chromaticism", "har_distinct_pc", "har_pc_entropy", "har_chord_change_rate", "har_vocab_density",
               "har_root_motion_entropy", "har_fourth_motion_rate", "har_dom7_rate", "har_dimaug_rate", "har_has_dom7_ANY", "har_has_dim_ANY"),
    _melody: ("mel_step_ratio", "mel_mean_abs_interval", "mel_interval_entropy", "mel_up_ratio", "mel_voice_range"),
    _texture: ("tex_voice_count", "tex_active_voice_density", "tex_doubling_ratio"),
    _form: ("form_self_similarity", "form_novelty_rate", "form_distinct_bar_frac", "form_reprise_frac", "form_section_per100bars"),
}


def bank(fr: Frames, part=None) -> DataFrame:
    """(piece_id, metric, value) for every piece with notes; one family with ``part``."""
    st = Structure(fr)
    out = None
    for build, names in PARTS.items():
        if part is None or build is part:
            df = build(st).fillna(0.0).unpivot(["piece_id"], list(names), "metric", "value")
            out = df if out is None else out.unionByName(df)
    return out


def candidates(fr: Frames) -> DataFrame:
    """Dynamics, percussion and instrumentation candidates per piece."""
    vel = F.col("vel").cast("double")
    base = fr.events.groupBy("piece_id").agg(F.avg(vel).alias("m"), F.stddev_pop(vel).alias("sd"), F.max("vel").alias("hi"), F.min("vel").alias("lo"))
    # Velocities are at most 128 values, so accents are counted on the histogram.
    hist = fr.events.filter(F.col("vel").isNotNull()).groupBy("piece_id", "vel").agg(F.count(F.lit(1)).alias("n"))
    accents = hist.join(base, "piece_id").groupBy("piece_id").agg(
        (F.sum(F.when(F.col("vel") > F.col("m") + F.col("sd"), F.col("n")).otherwise(0)) / F.sum("n")).alias("dyn_accent_rate")
    )
    drums = fr.onsets.filter("is_drum").groupBy("piece_id", "bar", F.rint("onb").alias("pos")).agg(F.sum("n").alias("n"))
    places = drums.groupBy("piece_id", "pos").agg(F.sum("n").alias("n"))
    kit = drums.groupBy("piece_id").agg(
        F.count_distinct("bar").alias("bars"), F.sum("n").alias("hits"),
        (F.sum(F.when(F.col("pos").isin(1.0, 3.0), F.col("n")).otherwise(0)) / F.sum("n")).alias("perc_backbeat"),
    )
    prog = fr.voices.filter(F.col("program").isNotNull() & F.col("voice_ix").isNotNull()).groupBy("piece_id", "program").agg(
        F.sum(F.when(F.col("is_drum"), F.lit(1)).otherwise(F.col("n"))).alias("n"), F.count(F.lit(1)).alias("voices")
    )
    inst = prog.groupBy("piece_id").agg(
        (F.count(F.lit(1)) / 16.0).alias("inst_n_programs"),
        (F.count_distinct(F.floor(F.col("program") / 8)) / 16.0).alias("inst_family_spread"),
        (F.least(F.sum("voices"), F.lit(16)) / 16.0).alias("inst_pitched_voices"),
    )
    n_bars = F.greatest(F.lit(1), F.col("n_bars"))
    df = fr.pieces.select("piece_id", "n_bars").join(base, "piece_id", "left").join(accents, "piece_id", "left")
    df = df.join(kit, "piece_id", "left").join(_even_entropy(places, "perc_pos_entropy"), "piece_id", "left")
    df = df.join(inst, "piece_id", "left").join(_even_entropy(prog, "inst_program_entropy"), "piece_id", "left")
    wide = df.select(
        "piece_id",
        (F.col("m") / 127).alias("dyn_vel_mean"),
        num.cv(F.col("sd"), F.col("m")).alias("dyn_vel_cv"),
        ((F.col("hi") - F.col("lo")) / 127).alias("dyn_vel_range"),
        "dyn_accent_rate",
        (F.col("bars") / n_bars).alias("perc_present"),
        (F.col("hits") / n_bars).alias("perc_density"),
        "perc_pos_entropy", "perc_backbeat", "inst_n_programs", "inst_program_entropy", "inst_family_spread", "inst_pitched_voices",
    ).fillna(0.0)
    return wide.unpivot(["piece_id"], [c for c in wide.columns if c != "piece_id"], "metric", "value")
