"""Measure of an extension: a region written before, inside or after a piece, against the piece it extends.

A case has one region and one source (the piece as it stands), both with bars from 1, and ``seam``: how many source bars
come before the region. The seam is judged between sounding bars, so silent bars at an edge do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators import gates, overlap, regions
from stavelake.operators.corpus import Corpus
from stavelake.operators.frames import Frames
from stavelake.operators.structure import Structure

# The bands of an extension.
COHERE_MAX = 22.0
MAX_EXTREMES = 3
NOVELTY_MAX = 0.30
MIN_BARS, MAX_BARS = 6, 40
SEAM_MIN = 0.10
VOICES_MIN = 0.5
SHARED_LOW, SHARED_HIGH = 15, 85

#: Axes that follow the length of a region more than its style; they count for neither coherence nor extremes.
LENGTH_AXES = ("axis_note_density_bar_variability",)


def voice_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(piece_id, voices): Jaccard similarity of the sounding voices of two event tables that share piece ids."""
    left = a.select("piece_id", "voice").distinct().withColumn("a", F.lit(1))
    right = b.select("piece_id", "voice").distinct().withColumn("b", F.lit(1))
    return left.join(right, ["piece_id", "voice"], "full").groupBy("piece_id").agg(
        (num.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1))).alias("voices")
    )


def seams(region: Frames, source: Frames, cases: DataFrame) -> DataFrame:
    """(piece_id, before, after): similarity of the prominent pitch classes on both sides of each seam.

    before: last sounding source bar up to the seam and first region bar; after: last region bar and first source bar past
    it. A side on which the source never sounds takes the nearest bar it has; a case that starts or ends the piece has one
    seam, the other is null.
    """
    bar, pcs = F.col("bar"), F.col("pcs")
    edges = Structure(region).prominent_bars.groupBy("piece_id").agg(F.min_by(pcs, bar).alias("first"), F.max_by(pcs, bar).alias("last"))
    left = bar <= F.col("seam")
    around = Structure(source).prominent_bars.join(cases.select("piece_id", "seam"), "piece_id").groupBy("piece_id").agg(
        F.coalesce(F.max_by(F.when(left, pcs), F.when(left, bar)), F.min_by(pcs, bar)).alias("till"),
        F.coalesce(F.min_by(F.when(~left, pcs), F.when(~left, bar)), F.max_by(pcs, bar)).alias("then"),
    )
    joined = cases.select("piece_id", "type").join(edges, "piece_id").join(around, "piece_id")
    return joined.select(
        "piece_id", F.when(F.col("type") != "start", bits.jaccard(F.col("till"), F.col("first"))).alias("before"),
        F.when(F.col("type") != "cont", bits.jaccard(F.col("last"), F.col("then"))).alias("after"),
    )


def measure(corpus: Corpus, region: Frames, source: Frames, cases: DataFrame, region_profile: DataFrame, source_profile: DataFrame,
            corpus_copy: DataFrame) -> DataFrame:
    """Coherence with the source, extremes that the source lacks, copies, seams and length of every extension.

    cases: (piece_id, type, seam); profiles as ``regions.scored_regions`` gives them; corpus_copy: (piece_id, vs_corpus).
    """
    style = ~F.col("axis").isin(*LENGTH_AXES)
    styled, base = region_profile.where(style), source_profile.where(style)
    cohere = regions.profile_distance(styled, base).withColumnRenamed("dist", "d_source")
    theirs = base.select("piece_id", "axis", F.col("percentile").alias("source_pct"))
    shared = ((F.col("percentile") <= 5) & (F.col("source_pct") <= SHARED_LOW)) | ((F.col("percentile") >= 95) & (F.col("source_pct") >= SHARED_HIGH))
    extremes = gates.genre_extremes(corpus, styled).join(theirs, ["piece_id", "axis"], "left").where(~F.coalesce(shared, F.lit(False)))
    extremes = extremes.groupBy("piece_id").agg(F.count(F.lit(1)).alias("extremes"))
    copied = overlap.case_overlap(region.events, source.events).select("piece_id", F.col("overlap_slid").alias("vs_source"))
    bars = region.events.groupBy("piece_id").agg(F.count_distinct("bar").alias("bars"))
    df = cases.join(cohere, "piece_id").join(extremes, "piece_id", "left").join(copied, "piece_id").join(corpus_copy, "piece_id")
    df = df.join(voice_agreement(region.events, source.events), "piece_id").join(seams(region, source, cases), "piece_id").join(bars, "piece_id")
    df = df.fillna({"extremes": 0}).withColumn("seam_pcs", F.least("before", "after"))
    checks = {
        "coheres": F.round("d_source", 9) <= COHERE_MAX,
        "nondegenerate": F.col("extremes") <= MAX_EXTREMES,
        "novel": (F.col("vs_source") < NOVELTY_MAX) & (F.col("vs_corpus") < NOVELTY_MAX),
        "boundary_ok": (F.col("voices") >= VOICES_MIN) & (F.col("seam_pcs") >= SEAM_MIN),
        "length_ok": F.col("bars").between(MIN_BARS, MAX_BARS),
    }
    df = df.withColumns(checks)
    rounded = [num.round_clean(F.col(c), k).alias(c) for c, k in (("d_source", 1), ("vs_source", 3), ("vs_corpus", 3), ("voices", 2), ("before", 2), ("after", 2))]
    verdict = F.col("coheres") & F.col("nondegenerate") & F.col("novel") & F.col("boundary_ok") & F.col("length_ok")
    return df.select("piece_id", "type", "bars", "extremes", *rounded, *checks, verdict.alias("verdict"))
