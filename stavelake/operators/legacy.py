"""Legacy measures of a filled gap: exact copies of whole bars, copied 8-bar harmony, genre-aware gates, winners per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators import gates, regions, retrieval
from stavelake.operators.corpus import Corpus
from stavelake.operators.frames import Frames
from stavelake.operators.structure import Structure

# Bars with fewer notes are not compared; length of a harmony run; gates in percent.
MIN_CELLS = 3
RUN = 8
BAR_COPY, RUN_COPY = 5, 10
REPLICA_BARS, REPLICA_RUNS, REPLICA_DIST = 20, 20, 5


def bar_cells(events: DataFrame) -> DataFrame:
    """(piece_id, bar, cells): the exact set of (onset, pitch) of every bar with at least three of them, voices aside.

    Cells are distinct before a bar is gathered, so an array is bounded by the bar's grid and the pitch range.
    """
    cell = (F.rint(F.col("onb") * 100) * 128 + F.col("midi")).cast("int")
    distinct = events.select("piece_id", "bar", cell.alias("cell")).distinct()
    return distinct.groupBy("piece_id", "bar").agg(F.sort_array(F.collect_list("cell")).alias("cells")).where(F.size("cells") >= MIN_CELLS)


def harmony_runs(fr: Frames) -> DataFrame:
    """(piece_id, bar, run): the prominent pitch classes of eight successive sounding bars, from ``bar`` on.

    Twelve bits a bar, so a run is two exact 48-bit numbers in order; nothing is hashed.
    """
    w = W.partitionBy("piece_id").orderBy("bar")
    at = [F.lead("pcs", k).over(w).cast("long") for k in range(RUN)]

    def packed(masks):
        return sum((F.call_function("shiftleft", m, F.lit(12 * i)) for i, m in enumerate(masks[1:], 1)), masks[0])

    half = RUN // 2
    runs = Structure(fr).prominent_bars.select("piece_id", "bar", F.struct(packed(at[:half]).alias("a"), packed(at[half:]).alias("b")).alias("run"))
    return runs.where("run.b is not null")


def _percent(hits: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """Whole percent of (piece_id, n) that the distinct rows of hits make up; 0 where there is nothing to compare."""
    k = hits.groupBy("piece_id").agg(F.count(F.lit(1)).alias("k"))
    share = F.rint(F.round(100 * F.coalesce("k", F.lit(0)) / F.col("n"), 9)).cast("int")
    return total.join(k, "piece_id", "left").select("piece_id", share.alias(name))


def copies(gen: Frames, real: Frames, corpus: Frames, neighbors: DataFrame) -> DataFrame:
    """(piece_id, copy_real, copy_neighbors, copy_harmony) in whole percent for every gen piece.

    Bars found anywhere in the held-out region, bars found in any neighbour song, 8-bar harmony runs found in the corpus.
    neighbors: (piece_id, song). Every lookup is a join on the exact set or run; the corpus is first made distinct.
    """
    own = bar_cells(gen.events)
    n_bars = own.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))
    in_real = own.join(bar_cells(real.events).select("piece_id", "cells").distinct(), ["piece_id", "cells"], "left_semi")
    wanted = neighbors.select("song").distinct()
    songs = bar_cells(corpus.events.withColumnRenamed("piece_id", "song").join(wanted, "song", "left_semi").withColumnRenamed("song", "piece_id"))
    theirs = songs.select(F.col("piece_id").alias("song"), "cells").distinct()
    in_near = own.join(neighbors.select("piece_id", "song").distinct(), "piece_id").join(theirs, ["song", "cells"], "left_semi").select("piece_id", "bar").distinct()
    runs = harmony_runs(gen)
    n_runs = runs.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))
    known = runs.join(harmony_runs(corpus).select("run").distinct(), "run", "left_semi")
    df = gen.pieces.select("piece_id")
    for part in (_percent(in_real, n_bars, "copy_real"), _percent(in_near, n_bars, "copy_neighbors"), _percent(known, n_runs, "copy_harmony")):
        df = df.join(part, "piece_id", "left")
    return df.fillna(0)


def measure(corpus: Corpus, gen: Frames, real: Frames, gen_profile: DataFrame, real_profile: DataFrame, context_profile: DataFrame,
            copied: DataFrame, budget: DataFrame) -> DataFrame:
    """Every gate of every case; profiles carry (piece_id, source_id, type, genre, axis, value, percentile).

    ``beat_pct`` is the share of other songs that lie farther from the held-out region than the candidate does.
    """
    d_gr = regions.profile_distance(gen_profile, real_profile).withColumnRenamed("dist", "d_gr")
    d_cg = regions.profile_distance(context_profile, gen_profile).withColumnRenamed("dist", "d_cg")
    source = real_profile.select("piece_id", "source_id", "type").distinct()
    song = corpus.profile.select(F.col("piece_id").alias("source_id"), "axis", "percentile").join(source.select("piece_id", "source_id"), "source_id")
    d_own = regions.profile_distance(song, real_profile).withColumnRenamed("dist", "d_own")
    cases = retrieval.vectors(real_profile).join(d_gr.withColumnRenamed("piece_id", "key"), "key")
    beat = retrieval.farther(cases, retrieval.vectors(corpus.profile)).withColumnRenamed("key", "piece_id")
    df = source.join(d_gr, "piece_id").join(d_cg, "piece_id").join(beat, "piece_id").join(d_own, "piece_id", "left")
    own = F.coalesce((F.round("d_own", 9) > F.round("d_gr", 9)).cast("int"), F.lit(0))
    others = F.col("n") - F.col("d_own").isNotNull().cast("int")
    beat_pct = F.when(others > 0, F.rint(F.round((F.col("farther") - own) / others * 100, 9)).cast("int"))
    bars = lambda fr, name: fr.events.groupBy("piece_id").agg(F.count_distinct("bar").alias(name))
    df = df.withColumn("beat_pct", beat_pct).join(gates.extreme_counts(corpus, gen_profile), "piece_id").join(budget, "genre")
    df = df.join(copied, "piece_id").join(bars(gen, "bars"), "piece_id").join(bars(real, "real_bars"), "piece_id")
    clean = (F.col("copy_real") < BAR_COPY) & (F.col("copy_neighbors") < BAR_COPY) & (F.col("copy_harmony") < RUN_COPY)
    replica = (F.col("copy_real") >= REPLICA_BARS) | ((F.round("d_gr", 9) < REPLICA_DIST) & (F.col("copy_harmony") >= REPLICA_RUNS))
    df = df.withColumns({
        "c1_pass": F.col("extremes") <= F.col("c1_budget"), "c2_pass": F.abs(F.col("bars") - F.col("real_bars")) <= regions.LENGTH_SLACK,
        "c3_pass": clean, "replication": replica,
    })
    passed = F.col("c1_pass") & F.col("c2_pass") & F.col("c3_pass") & ~F.col("replication")
    return df.select(
        "piece_id", "type", "genre", num.round_clean(F.col("d_gr"), 1).alias("d_gr"), num.round_clean(F.col("d_cg"), 1).alias("d_cg"), "beat_pct",
        "extremes", "copy_real", "copy_neighbors", "copy_harmony", "c1_pass", "c2_pass", "c3_pass", "replication", passed.alias("passed"),
    )


def winners(measured: DataFrame) -> DataFrame:
    """The best passing case of each type: farthest ahead of the other songs, then nearest to its context, then smallest id."""
    ranked = measured.where("passed").withColumn("behind", -F.col("beat_pct"))
    return retrieval.top_per_group(ranked, ["type"], ["behind", "d_cg", "piece_id"], 1).select("type", "piece_id", "beat_pct", "d_cg")
