"""Sequence-pattern catalogue: 22 detectors, each (piece_id, pattern, bar) with the first cited bar.

A null bar means the pattern is attested without a citation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.frames import Frames
from stavelake.operators.structure import AUG, DIM, DOM7, Structure, roots_holding

def _by_bar():
    return W.partitionBy("piece_id").orderBy("bar")


def _runs(df: DataFrame, keys: list[str], order: str, continues: Column, least: int) -> DataFrame:
    """Gaps and islands: runs of at least ``least`` rows where each row continues the one before.

    Returns (keys..., start, length).
    """
    w = W.partitionBy(*keys).orderBy(order)
    opened = F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    islands = df.withColumn("_open", opened).withColumn("_run", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return (
        islands.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))
        .filter(F.col("length") >= least).drop("_run")
    )


def _first(df: DataFrame, bar: str = "bar") -> DataFrame:
    return df.groupBy("piece_id").agg(F.min(bar).cast("int").alias("bar"))


# -- harmony ---------------------------------------------------------------------------------
def descending_bass(st: Structure) -> DataFrame:
    step = F.col("lo") - F.col("prev")
    return _first(_runs(st.bass_bars, ["piece_id"], "bar", step.between(-2, -1), 3), "start")


def fourth_root_motion(st: Structure) -> DataFrame:
    rise = F.pmod(F.col("lo") - F.col("prev"), F.lit(12)) == 5
    moves = st.bass_bars.select("piece_id", "bar", rise.alias("rise"), F.lag(rise).over(_by_bar()).alias("before"))
    return moves.groupBy("piece_id").agg(
        F.min(F.when(F.col("rise") & F.col("before"), F.col("bar"))).cast("int").alias("bar"),
        num.count_if(F.col("rise")).alias("n"),
    ).filter(F.col("bar").isNotNull() | (F.col("n") >= 3)).select("piece_id", "bar")


def _sonority(template):
    def detect(st: Structure) -> DataFrame:
        pcs = F.col("pcs")
        return _first(st.prominent_bars.filter((bits.size(pcs) >= 3) & (roots_holding(pcs, template) > 0)))

    return detect


def pedal_point(st: Structure) -> DataFrame:
    return _first(_runs(st.bass_bars, ["piece_id"], "bar", F.col("lo") % 12 == F.col("prev") % 12, 4), "start")


# -- melody ----------------------------------------------------------------------------------
def _melody(st: Structure) -> DataFrame:
    """Melody onsets with the interval to the next onset, and the bar of each onset."""
    w = W.partitionBy("piece_id").orderBy("abs")
    return (
        st.fr.top_line(st.fr.role_voices, "melody").join(st.fr.pieces.select("piece_id", "bar_ql"), "piece_id")
        .select(
            "piece_id", "abs", "max_dur",
            (F.floor(F.col("abs") / F.col("bar_ql")) + 1).cast("int").alias("bar"),
            F.lead("step").over(w).alias("iv"),
            F.lead("step", 2).over(w).alias("iv2"),
            F.lead("step", 3).over(w).alias("iv3"),
            F.lead("max_dur").over(w).alias("next_dur"),
        )
    )


def _cite_first(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(cond).groupBy("piece_id").agg(F.min_by("bar", "abs").alias("bar"))


def stepwise(st: Structure) -> DataFrame:
    iv = F.abs("iv")
    return (
        _melody(st).groupBy("piece_id").agg(
            F.avg(F.when(iv > 0, (iv <= 2).cast("double"))).alias("share"),
            F.min_by("bar", F.when(iv.isin(1, 2), F.col("abs"))).alias("bar"),
        ).filter("share >= 0.6").select("piece_id", "bar")
    )


def sigh(st: Structure) -> DataFrame:
    landed = (F.col("next_dur") >= F.col("max_dur") * 1.5) & (F.col("next_dur") >= 1.0)
    return _cite_first(_melody(st), F.col("iv").isin(-1, -2) & landed)


def motivic_cell(st: Structure) -> DataFrame:
    grams = _melody(st).filter(F.col("iv3").isNotNull()).groupBy("piece_id", "iv", "iv2", "iv3").agg(
        F.count(F.lit(1)).alias("n"), F.min("abs").alias("t"), F.min_by("bar", "abs").alias("bar")
    )
    top = grams.groupBy("piece_id").agg(F.max_by(F.struct("iv", "iv2", "iv3", "n", "bar"), F.struct(F.col("n"), -F.col("t"))).alias("g"))
    still = (F.col("g.iv") == 0) & (F.col("g.iv2") == 0) & (F.col("g.iv3") == 0)
    return top.filter((F.col("g.n") >= 3) & ~still).select("piece_id", F.col("g.bar").alias("bar"))


def leap_gapfill(st: Structure) -> DataFrame:
    iv, nxt = F.col("iv"), F.col("iv2")
    return _cite_first(_melody(st), (F.abs(iv) >= 7) & (iv * nxt < 0) & (F.abs(nxt) <= 2))


# -- rhythm ----------------------------------------------------------------------------------
def _grid_majority(triplet: bool):
    def detect(st: Structure) -> DataFrame:
        trip = num.count_if(F.col("is_triplet"))
        count = st.fr.bars.groupBy("piece_id").agg((trip > F.count(F.lit(1)) - trip).alias("major"))
        heard = st.fr.voices.filter(F.col("voice_ix").isNotNull()).select("piece_id").distinct()
        return count.join(heard, "piece_id", "left_semi").filter(F.col("major") == triplet).select("piece_id", F.lit(1).alias("bar"))

    return detect


def syncopation(st: Structure) -> DataFrame:
    off = F.pmod(F.col("onb"), F.lit(1.0)) > 1e-6
    return st.fr.onsets.groupBy("piece_id").agg(
        (F.sum(F.when(off, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        F.min_by("bar", F.when(off, F.col("first_seq"))).alias("bar"),
    ).filter("share >= 0.15").select("piece_id", "bar")


def ostinato(st: Structure) -> DataFrame:
    onset = F.round("onb", 3)
    shapes = (
        st.fr.onsets.filter(F.col("voice_ix").isNotNull()).select("piece_id", "voice_ix", "bar", onset.alias("o")).distinct()
        .groupBy("piece_id", "voice_ix", "bar")
        .agg(F.sort_array(F.collect_list("o")).alias("shape"))
    )
    w = W.partitionBy("piece_id", "voice_ix").orderBy("bar")
    same = shapes.select(
        "piece_id", "voice_ix", "bar",
        ((F.col("bar") == F.lag("bar").over(w) + 1) & (F.col("shape") == F.lag("shape").over(w)) & (F.size("shape") >= 2)).alias("same"),
    )
    runs = _runs(same, ["piece_id", "voice_ix"], "bar", F.col("same"), 8)
    return runs.groupBy("piece_id").agg(F.min_by("start", F.struct("voice_ix", "start")).alias("bar"))


def root_pulse_bass(st: Structure) -> DataFrame:
    bass = st.fr.role_voices.select("piece_id", F.col("bass").alias("voice"))
    beats = F.transform(F.sequence(F.lit(0), F.rint("bar_ql").cast("int") - 1), lambda b: b.cast("double"))
    full = (
        st.fr.onsets.join(bass, ["piece_id", "voice"]).select("piece_id", "bar", F.rint("onb").alias("b")).distinct()
        .groupBy("piece_id", "bar").agg(F.collect_list("b").alias("hit"))
        .join(st.fr.pieces.select("piece_id", "bar_ql"), "piece_id")
        .filter(F.size(F.array_except(beats, "hit")) == 0)
        .withColumn("next_to", F.col("bar") == F.lag("bar").over(_by_bar()) + 1)
    )
    runs = _runs(full, ["piece_id"], "bar", F.col("next_to"), 8)
    return runs.groupBy("piece_id").agg(F.max_by("start", F.struct(F.col("length"), -F.col("start"))).alias("bar"))


# -- form ------------------------------------------------------------------------------------
def verbatim_reprise(st: Structure) -> DataFrame:
    seen = F.min("bar").over(W.partitionBy("piece_id", "key"))
    again = st.four_bars.withColumn("seen", seen).filter(F.col("bar") - F.col("seen") >= 4)
    return again.groupBy("piece_id").agg(F.min_by("seen", "bar").alias("bar"))


def sparse_intro(st: Structure) -> DataFrame:
    w = W.partitionBy("piece_id")
    onsets = st.fr.onsets.groupBy("piece_id", "bar", "voice").agg(F.lit(1).alias("x"))
    first = onsets.withColumn("first", F.min("bar").over(w)).filter(F.col("bar") < F.col("first") + 4)
    return first.groupBy("piece_id").agg(F.count_distinct("voice").alias("k"), F.min("first").alias("bar")).filter("k = 1").select("piece_id", "bar")


def thinning_outro(st: Structure) -> DataFrame:
    bars = st.fr.bar_levels.select(
        "piece_id", "bar", "n", F.row_number().over(W.partitionBy("piece_id").orderBy(F.desc("bar"))).alias("from_end")
    )
    # Bars per piece are bounded by the header; the upper median is an element of the sorted counts.
    med = bars.groupBy("piece_id").agg(F.sort_array(F.collect_list("n")).alias("d")).select(
        "piece_id", F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("med")
    )
    tail = bars.filter("from_end <= 3").groupBy("piece_id").agg(F.max("n").alias("most"), F.min("bar").alias("bar"))
    return tail.join(med, "piece_id").filter((F.col("med") > 0) & (F.col("most") <= F.greatest(F.lit(1.0), F.col("med") * 0.5))).select("piece_id", "bar")


# -- texture ---------------------------------------------------------------------------------
def role_stratification(st: Structure) -> DataFrame:
    roles = st.fr.role_voices.filter(F.col("bass") != F.col("melody"))
    third = st.fr.voices.filter(F.col("voice_ix").isNotNull() & (F.col("chordality") >= 1.8)).join(roles, "piece_id").filter(
        (F.col("voice") != F.col("bass")) & (F.col("voice") != F.col("melody"))
    )
    return _first(st.fr.bar_levels.join(third.select("piece_id").distinct(), "piece_id", "left_semi"))


def _pair_bar(st: Structure, cond: Column) -> DataFrame:
    first = st.voice_pairs.filter(cond).groupBy("piece_id").agg(F.min_by("first_abs", F.struct("v1", "v2")).alias("t"))
    return first.join(st.fr.pieces.select("piece_id", "bar_ql"), "piece_id").select(
        "piece_id", (F.floor(F.col("t") / F.col("bar_ql")) + 1).cast("int").alias("bar")
    )


def doubling(st: Structure) -> DataFrame:
    return _pair_bar(st, (F.col("shared") >= 12) & (F.col("same") / F.col("shared") >= 0.9))


def parallel_3rd_6th(st: Structure) -> DataFrame:
    return _pair_bar(st, (F.col("shared") >= 6) & (F.greatest("thirds", "sixths") / F.col("shared") >= 0.8))


def wide_voicing(st: Structure) -> DataFrame:
    chordal = st.fr.voices.filter(F.col("voice_ix").isNotNull() & (F.col("chordality") >= 1.8)).select("piece_id", "voice")
    wide = (
        st.fr.onsets.groupBy("piece_id", "voice", "voice_ix", "abs")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first_seq").alias("s"))
        .filter((F.col("n") >= 3) & (F.col("hi") - F.col("lo") >= 19))
        .join(chordal, ["piece_id", "voice"], "left_semi")
        .groupBy("piece_id").agg(F.min_by("abs", F.struct("voice_ix", "s")).alias("t"))
    )
    return wide.join(st.fr.pieces.select("piece_id", "bar_ql"), "piece_id").select(
        "piece_id", (F.floor(F.col("t") / F.col("bar_ql")) + 1).cast("int").alias("bar")
    )


DETECTORS = {
    "H:descending_bass": descending_bass,
    "H:fourth_root_motion": fourth_root_motion,
    "H:augmented": _sonority(AUG),
    "H:diminished": _sonority(DIM),
    "H:dominant7": _sonority(DOM7),
    "H:pedal_point": pedal_point,
    "M:stepwise": stepwise,
    "M:sigh": sigh,
    "M:motivic_cell": motivic_cell,
    "M:leap_gapfill": leap_gapfill,
    "R:triplet": _grid_majority(True),
    "R:straight": _grid_majority(False),
    "R:syncopation": syncopation,
    "R:ostinato": ostinato,
    "R:root_pulse_bass": root_pulse_bass,
    "F:verbatim_reprise": verbatim_reprise,
    "F:sparse_intro": sparse_intro,
    "F:thinning_outro": thinning_outro,
    "T:role_stratification": role_stratification,
    "T:doubling": doubling,
    "T:parallel_3rd_6th": parallel_3rd_6th,
    "T:wide_voicing": wide_voicing,
}


def detect(fr: Frames, kinds: str = "HMRFT") -> DataFrame:
    """(piece_id, pattern, bar) for the chosen categories."""
    st = Structure(fr)
    parts = [
        d(st).select("piece_id", F.lit(k).alias("pattern"), F.col("bar").cast("int").alias("bar"))
        for k, d in DETECTORS.items() if k[0] in kinds
    ]
    return reduce(DataFrame.unionByName, parts)


def catalog(found: DataFrame, examples: int = 4) -> DataFrame:
    """Attestations per pattern and the first cited pieces in id order."""
    counts = found.groupBy("pattern").agg(F.count_distinct("piece_id").alias("n_pieces"))
    cited = found.filter(F.col("bar").isNotNull())
    # The k smallest ids by slices first: a pattern nearly every piece shows must not be one sort.
    sliced = W.partitionBy("pattern", F.pmod(F.xxhash64("piece_id"), F.lit(64))).orderBy("piece_id")
    final = W.partitionBy("pattern").orderBy("piece_id")
    top = (
        cited.withColumn("_r", F.row_number().over(sliced)).filter(F.col("_r") <= examples)
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= examples).drop("_r")
    )
    return counts.join(top, "pattern", "left")
