"""Time lookups over notes: what sounds at an instant, the last pitch before it, where a copy sits.

Interval joins are equi-joins: a note is listed under every bar it sounds in, an instant under its own bar, and the exact
bounds are checked inside the bar. What sounds at a piece's own onsets is found so by one grouping, without a join. As-of lookups are one ordered pass per voice over notes and asked instants together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.operators.overlap import corpus_overlap, note_key

# Tolerances of "sounding at t": from its onset on, to just before its end.
ONSET_EPS, END_EPS = 1e-6, 1e-9


def sounding_at(notes: DataFrame, instants: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """(piece_id, t, voice, midi): distinct pitches that sound at the instants (piece_id, t)."""
    held = notes.select("piece_id", "voice", "midi", "abs", (F.col("abs") + F.col("dur")).alias("ends")).distinct()
    first, last = F.floor((F.col("abs") - ONSET_EPS) / bar_ql), F.floor(F.col("ends") / bar_ql)
    by_bar = held.withColumn("_bar", F.explode(F.sequence(first, last)))
    asked = instants.select("piece_id", "t").distinct().withColumn("_bar", F.floor(F.col("t") / bar_ql))
    inside = (F.col("abs") - ONSET_EPS <= F.col("t")) & (F.col("t") < F.col("ends") - END_EPS)
    return asked.join(by_bar, ["piece_id", "_bar"]).filter(inside).select("piece_id", "t", "voice", "midi").distinct()


def _heard(notes: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """(piece_id, t, at, struck): at every onset the distinct pitches that sound, as (voice, midi), and the voices that strike.

    One grouping by piece and bar, which leaves notes dealt by piece where they are: a bar gathers the notes that sound in it
    and its onsets, each distinct, and the exact bounds are checked inside the bar.
    """
    start, ends = F.col("abs"), F.col("abs") + F.col("dur")
    held = F.struct("voice", "midi", "abs", ends.alias("ends"))
    onset = F.struct(start.alias("t"), "voice")
    none = lambda x: F.when(F.lit(False), x)
    sounds = F.transform(
        F.sequence(F.floor((start - ONSET_EPS) / bar_ql), F.floor(ends / bar_ql)),
        lambda b: F.struct(b.alias("bar"), held.alias("held"), none(onset).alias("onset")),
    )
    struck = F.array(F.struct(F.floor(start / bar_ql).alias("bar"), none(held).alias("held"), onset.alias("onset")))
    listed = notes.where("piece_id is not null").select("piece_id", F.explode(F.concat(F.coalesce(sounds, F.filter(struck, lambda x: F.lit(False))), struck)).alias("x"))
    bars = listed.where("x.bar is not null").groupBy("piece_id", "x.bar").agg(F.collect_set("x.held").alias("held"), F.collect_set("x.onset").alias("onsets"))
    at = bars.select("piece_id", "held", "onsets", F.explode(F.array_distinct(F.col("onsets.t"))).alias("t"))
    t = F.col("t")
    inside = F.filter("held", lambda h: (h["abs"] - ONSET_EPS <= t) & (t < h["ends"] - END_EPS))
    return at.select(
        "piece_id", "t", F.array_distinct(F.transform(inside, lambda h: F.struct(h["voice"].alias("voice"), h["midi"].alias("midi")))).alias("at"),
        F.transform(F.filter("onsets", lambda o: o["t"] == t), lambda o: o["voice"]).alias("struck"),
    )


def voice_intervals(notes: DataFrame) -> DataFrame:
    """(piece_id, voice_a, voice_b, semis, n): at how many onsets of either voice the two sound so many semitones apart.

    A row means that the pair ever sounds the interval, which is what the interval claim asks for.
    """
    hit = lambda v: F.coalesce(F.array_contains("struck", v), F.lit(False))
    later = lambda a: F.filter("at", lambda b: (a["voice"] < b["voice"]) & (hit(a["voice"]) | hit(b["voice"])))
    pairs = F.transform("at", lambda a: F.transform(later(a), lambda b: F.struct(
        a["voice"].alias("voice_a"), b["voice"].alias("voice_b"), F.abs(a["midi"] - b["midi"]).alias("semis"))))
    each = _heard(notes).select("piece_id", F.explode(F.array_distinct(F.flatten(pairs))).alias("x"))
    return each.groupBy("piece_id", "x.voice_a", "x.voice_b", "x.semis").agg(F.count("*").alias("n"))


def ever_interval(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (piece_id, voice_a, voice_b, semis) of ``asked`` whose voices ever sound so many semitones apart at an onset
    of either. A voice asked against itself is compared with its own sounding pitches. Only asked voices are looked up."""
    wanted = asked.where("piece_id is not null").groupBy("piece_id").agg(F.collect_set(F.struct("voice_a", "voice_b", "semis")).alias("asked"))
    either = F.array_union("asked.voice_a", "asked.voice_b")
    ours = notes.join(wanted, "piece_id").where(F.array_contains(either, F.col("voice"))).select("piece_id", "voice", "midi", "abs", "dur")
    each = _heard(ours).join(wanted, "piece_id").select("piece_id", "at", "struck", F.explode("asked").alias("x"))
    of = lambda v: F.filter("at", lambda h: h["voice"] == v)
    met = F.exists(of(F.col("x.voice_a")), lambda a: F.exists(of(F.col("x.voice_b")), lambda b: F.abs(a["midi"] - b["midi"]) == F.col("x.semis")))
    struck = F.exists("struck", lambda v: (v == F.col("x.voice_a")) | (v == F.col("x.voice_b")))
    return each.where(struck & met).select("piece_id", "x.voice_a", "x.voice_b", "x.semis").distinct()


def pitch_at(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of join: for (piece_id, voice, t) the top pitch of the voice's last onset at or before t, and that onset."""
    tops = notes.groupBy("piece_id", "voice", F.col("abs").alias("t")).agg(F.max("midi").alias("midi"))
    marked = tops.select("piece_id", "voice", "t", F.struct("t", "midi").alias("note")).unionByName(
        asked.select("piece_id", "voice", "t", F.lit(None).cast("struct<t:double,midi:int>").alias("note"))
    )
    w = W.partitionBy("piece_id", "voice").orderBy("t", F.col("note").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = marked.withColumn("last", F.last("note", ignorenulls=True).over(w)).filter("note is null")
    return seen.select("piece_id", "voice", "t", F.col("last.midi").alias("midi"), F.col("last.t").alias("onset"))


def copy_bars(gen: DataFrame, corpus: DataFrame, exclude_self: bool = True) -> DataFrame:
    """(piece_id, song, gen_bar, src_bar, n, rank): shared notes per bar at the best alignment with the best partner."""
    best = corpus_overlap(gen, corpus, exclude_self).filter("song is not null").select("piece_id", "song", "bar_offset")
    own = gen.select("piece_id", F.col("bar").alias("gen_bar"), note_key().alias("k")).distinct().join(best, "piece_id")
    theirs = corpus.select(F.col("piece_id").alias("song"), F.col("bar").alias("src_bar"), note_key().alias("k")).distinct()
    shared = own.withColumn("src_bar", F.col("gen_bar") + F.col("bar_offset")).join(theirs, ["song", "src_bar", "k"])
    counted = shared.groupBy("piece_id", "song", "gen_bar", "src_bar").agg(F.count("*").alias("n"))
    w = W.partitionBy("piece_id").orderBy(F.desc("n"), "gen_bar")
    return counted.withColumn("rank", F.row_number().over(w))
