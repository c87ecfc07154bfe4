"""Sub-pieces: gap regions and their context, equal segments, within-piece variation, region grading.

A sub-piece is the same event table with a derived piece id ("id|part") and bars renumbered from 1, so
every metric runs on it unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators import axes, calibrate, gates, overlap, ranks, retrieval
from stavelake.operators.corpus import Corpus
from stavelake.operators.frames import Frames
from stavelake.session import cut_lineage

# Region cuts as shares of the bar count.
CUTS = {"start": (0.0, 0.20), "infill": (0.40, 0.60), "cont": (0.75, 1.0)}
WINDOWS = 6
LENGTH_SLACK = 2
OOB_CONVERGE = 6
REPLICATION = 0.30


def _cuts() -> Column:
    def edge(share):
        return F.rint(F.lit(share) * F.col("n_bars")).cast("int")

    return F.explode(F.array(*[
        F.struct(F.lit(t).alias("type"), edge(a).alias("lo"), edge(b).alias("hi")) for t, (a, b) in CUTS.items()
    ]))


def seam(kind: Column, n_bars: Column) -> Column:
    """How many bars of a piece of ``n_bars`` come before its region of that type."""
    return reduce(lambda other, t: F.when(kind == t, F.rint(F.lit(CUTS[t][0]) * n_bars).cast("int")).otherwise(other), CUTS, F.lit(None).cast("int"))


def _rebar(events: DataFrame, bar: Column) -> DataFrame:
    """Move events to new bar numbers, keeping the place inside the bar."""
    return events.withColumn("_bar", bar.cast("int")).withColumns({
        "abs": F.col("abs") + (F.col("_bar") - F.col("bar")) * F.col("bar_ql"), "bar": F.col("_bar")
    }).drop("_bar")


def _dealt(events: DataFrame, parts: int) -> DataFrame:
    """Sub-pieces dealt by their new ids, if the pieces were dealt."""
    return events.repartition(parts, "piece_id") if parts else events


def gap_regions(fr: Frames, context: bool = False) -> Frames:
    """The three gap regions of every piece (or what is visible around each of them)."""
    cases = fr.pieces.select("piece_id", "genre", "bar_ql", "n_bars", _cuts().alias("c")).select("piece_id", "genre", "bar_ql", "n_bars", "c.*")
    size = F.col("hi") - F.col("lo")
    cases = cases.filter((F.col("n_bars") >= 5) & (size > 0) & (size < F.col("n_bars")))
    case_id = F.concat_ws("|", "piece_id", "type")
    inside = (F.col("bar") > F.col("lo")) & (F.col("bar") <= F.col("hi"))
    joined = fr.events.join(cases.drop("genre"), "piece_id")
    if context:
        moved = _rebar(joined.filter(~inside), F.when(F.col("bar") > F.col("hi"), F.col("bar") - size).otherwise(F.col("bar")))
        n_bars = F.col("n_bars") - size
    else:
        moved = _rebar(joined.filter(inside), F.col("bar") - F.col("lo"))
        n_bars = size
    events = moved.withColumn("piece_id", case_id).drop("lo", "hi", "type", "n_bars", "bar_ql")
    pieces = cases.select(
        case_id.alias("piece_id"), F.col("piece_id").alias("source_id"), "type", "genre", "bar_ql", n_bars.alias("n_bars"), F.col("n_bars").alias("full_bars")
    )
    parts = 2 * fr.dealt if context else fr.dealt  # three contexts hold twice the notes
    return Frames(_dealt(events, parts), pieces, dealt=parts)


def segments(fr: Frames, count: Column) -> Frames:
    """Equal segments of ``count`` parts; the last one takes the remainder."""
    per = F.greatest(F.lit(1), F.floor(F.col("n_bars") / F.col("parts")).cast("int"))
    parts = fr.pieces.withColumn("parts", count.cast("int")).withColumn("per", per)
    events = fr.events.join(parts.select("piece_id", "bar_ql", "parts", "per"), "piece_id").withColumn(
        "part", F.least(F.floor((F.col("bar") - 1) / F.col("per")).cast("int"), F.col("parts") - 1)
    )
    events = _rebar(events, F.col("bar") - F.col("part") * F.col("per")).withColumn("piece_id", F.concat_ws("|", "piece_id", "part"))
    pieces = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.concat_ws("|", "piece_id", "part").alias("piece_id"), F.col("piece_id").alias("source_id"), "part", "genre", "bar_ql",
        F.when(F.col("part") == F.col("parts") - 1, F.col("n_bars") - F.col("part") * F.col("per")).otherwise(F.col("per")).alias("n_bars"),
    )
    return Frames(_dealt(events.drop("part", "per", "parts", "bar_ql"), fr.dealt), pieces, dealt=fr.dealt)


def within_song_variation(fr: Frames, corpus: Corpus) -> DataFrame:
    """Mean over axes of the spread across up to six windows, in corpus standard deviations."""
    windows = F.least(F.lit(WINDOWS), F.greatest(F.lit(2), F.floor(F.col("n_bars") / 6)))
    seg = segments(Frames(fr.events, fr.pieces.filter("n_bars >= 4"), dealt=fr.dealt), windows)
    fp = cut_lineage(axes.fingerprint(seg.kept_events(), ("source_id",)).withColumn("value", F.round("value", 6)))
    seg.release()
    sd = corpus.breakpoints.select("axis", F.when(F.col("sd") != 0, F.col("sd")).otherwise(1e-9).alias("corpus_sd"))
    spread = fp.groupBy("source_id", "axis").agg(F.stddev_pop("value").alias("sd")).join(sd, "axis")
    return spread.groupBy(F.col("source_id").alias("piece_id")).agg(F.avg(F.col("sd") / F.col("corpus_sd")).alias("wsv"))


def by_type(fr: Frames) -> list[tuple[Frames, Frames]]:
    """Of every region type the regions and what is visible around them, under the ids of their pieces.

    A piece has one region of a type, so notes dealt by piece stay where they are; the notes are kept until ``fr`` is released.
    """
    base = fr.keep(fr.events.join(fr.pieces.select("piece_id", "bar_ql", "n_bars"), "piece_id"))
    made, bar, n_bars = [], F.col("bar"), F.col("n_bars")
    for kind, shares in CUTS.items():
        lo, hi = (F.rint(F.lit(share) * n_bars).cast("int") for share in shares)
        size, inside = hi - lo, (bar > lo) & (bar <= hi)
        fits = (n_bars >= 5) & (size > 0) & (size < n_bars)
        region, around = _rebar(base.where(fits & inside), bar - lo), _rebar(base.where(fits & ~inside), F.when(bar > hi, bar - size).otherwise(bar))
        cases = fr.pieces.where(fits).withColumns({"source_id": F.col("piece_id"), "type": F.lit(kind)})
        made.append(tuple(
            Frames(events.drop("n_bars", "bar_ql"), cases.withColumn("n_bars", held), dealt=fr.dealt)
            for events, held in ((region, size), (around, n_bars - size))
        ))
    return made


def named(df: DataFrame) -> DataFrame:
    """Rows of one type, which carry it, under the ids of regions."""
    return df.withColumn("piece_id", F.concat_ws("|", "piece_id", "type"))


def all_types(tables: Iterable[DataFrame]) -> DataFrame:
    """Tables of one type each as one, under the ids of regions."""
    return named(reduce(DataFrame.unionByName, tables))


def scored_by_type(parts: list[Frames], corpus: Corpus) -> DataFrame:
    """``scored`` of frames of one type each; a fingerprint is written before the next one is made."""
    written = []
    for part in parts:
        values = axes.fingerprint(part, ("source_id", "type", "genre")).withColumn("value", F.round("value", 6))
        written.append(cut_lineage(named(values)))
        part.release()
    return corpus.score_written(reduce(DataFrame.unionByName, written))


def scored_regions(fr: Frames, corpus: Corpus, context: bool = False) -> DataFrame:
    """(piece_id, source_id, type, genre, axis, value, percentile) of every region or context."""
    fr = Frames(fr.events, fr.pieces, dealt=fr.dealt)
    made = scored_by_type([parts[context] for parts in by_type(fr)], corpus)
    fr.release()
    return made


def scored(regions: Frames, corpus: Corpus) -> DataFrame:
    """The same of given regions; what was kept for them is released, as the score stands on a written fingerprint."""
    made = corpus.score(axes.fingerprint(regions, ("source_id", "type", "genre")))
    regions.release()
    return made


def region_budget(corpus: Corpus, scored: DataFrame) -> DataFrame:
    """Extreme budget per genre: the admitted quantile of what real regions carry."""
    counts = gates.extreme_counts(corpus, scored)
    q = calibrate.small_quantile(F.col("extremes"), calibrate.ADMIT)
    return counts.groupBy("genre").agg(F.ceil(F.round(q, 9)).cast("int").alias("c1_budget"))


def region_reprise(fr: Frames) -> DataFrame:
    """How much of each region reappears in its own visible context."""
    return reprise(gap_regions(fr), gap_regions(fr, context=True))


def reprise(gap: Frames, ctx: Frames) -> DataFrame:
    """The same of regions and contexts that are already cut."""
    hits = overlap.case_overlap(gap.events, ctx.events)
    return hits.join(gap.pieces.select("piece_id", "source_id", "type"), "piece_id").select("piece_id", "source_id", "type", F.col("overlap_slid").alias("reprise"))


def reprise_gate(reprise: DataFrame) -> DataFrame:
    """Gate per region type: the 75th percentile of real reprise."""
    df = reprise.select("type", F.round("reprise", 9).alias("reprise"))
    q = ranks.quantiles(ranks.cumulative(df, ["type"], "reprise"), ["type"], "reprise", {"gate": calibrate.REPRISE_QUANTILE})
    return q.select("type", "n", num.round_clean(F.col("gate"), 3).alias("gate"))


def profile_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute percentile difference per piece id."""
    left = a.select("piece_id", "axis", F.col("percentile").alias("pa"))
    right = b.select("piece_id", "axis", F.col("percentile").alias("pb"))
    return left.join(right, ["piece_id", "axis"]).groupBy("piece_id").agg(F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("dist"))


def fitness(corpus: Corpus, region: DataFrame, context: DataFrame, reprise: DataFrame, sizes: DataFrame,
            budget: DataFrame, gate: DataFrame) -> DataFrame:
    """One round's structural signals and score (lower is closer to the gates).

    sizes: (piece_id, bars, target_bars). Nothing here reads the held-out answer.
    """
    d_ctx = profile_distance(region, context).withColumnRenamed("dist", "d_ctx")
    ext = gates.extreme_counts(corpus, region)
    targets = gates.genre_targets(corpus).select("axis", "genre", "lo", "hi")
    oob = region.join(targets, ["axis", "genre"]).groupBy("piece_id").agg(
        num.count_if(~F.col("value").between(F.col("lo"), F.col("hi"))).alias("n_oob")
    )
    df = ext.join(budget, "genre").join(d_ctx, "piece_id").join(reprise, "piece_id").join(gate.select("type", "gate"), "type")
    df = df.join(oob, "piece_id", "left").join(sizes, "piece_id").fillna({"n_oob": 0})
    len_err = F.abs(F.col("bars") - F.col("target_bars"))
    c1, c2, copy = F.col("extremes") <= F.col("c1_budget"), len_err <= LENGTH_SLACK, F.col("reprise") <= F.col("gate")
    score = (
        F.greatest(F.lit(0), F.col("extremes") - F.col("c1_budget")) * 40 + F.when(c2, 0).otherwise(50)
        + F.greatest(F.lit(0.0), F.col("reprise") - F.col("gate")) * 300 + F.col("n_oob") * 2 + len_err * 3 + F.col("d_ctx") * 0.5
    )
    return df.select(
        "piece_id", "type", "genre", "extremes", "c1_budget", "n_oob", num.round_clean(F.col("reprise"), 3).alias("reprise"), "gate",
        num.round_clean(F.col("d_ctx"), 1).alias("d_ctx"), c1.alias("c1_pass"), c2.alias("c2_pass"), copy.alias("copy_pass"),
        (c1 & c2 & copy & (F.col("n_oob") <= OOB_CONVERGE)).alias("converged"), num.round_clean(score, 1).alias("score"),
    )


def final_grade(region: DataFrame, real: DataFrame, context: DataFrame, corpus: Corpus, answer: DataFrame) -> DataFrame:
    """Distance to the held-out region, beat percentage against the corpus and the replication flag.

    answer: (piece_id, overlap_slid) of the region against the held-out one.
    """
    d_gr = profile_distance(region, real).withColumnRenamed("dist", "d_gr")
    d_cg = profile_distance(region, context).withColumnRenamed("dist", "d_cg")
    vec = retrieval.vectors(real).join(d_gr.withColumnRenamed("piece_id", "key"), "key")
    beat = retrieval.beat_percent(vec, retrieval.vectors(corpus.profile)).withColumnRenamed("key", "piece_id")
    df = d_gr.join(d_cg, "piece_id").join(beat, "piece_id").join(answer.select("piece_id", F.col("overlap_slid").alias("answer_overlap")), "piece_id")
    flag = (F.col("answer_overlap") >= REPLICATION) | ((F.col("d_gr") < 5) & (F.col("answer_overlap") >= 0.20))
    return df.select(
        "piece_id", num.round_clean(F.col("d_gr"), 1).alias("d_gr"), num.round_clean(F.col("d_cg"), 1).alias("d_cg"), "beat_pct",
        num.round_clean(F.col("answer_overlap"), 3).alias("answer_overlap"), flag.alias("replication"),
    )
