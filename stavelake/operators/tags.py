"""What a piece trains: keyword tags from its meter, tempo, key, rhythm, line, texture and chord labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.frames import Frames

# Tempo words by beats a minute, note values by length, bands of off-beat share.
TEMPO_WORDS = {"largo": 50, "adagio": 66, "andante": 84, "moderato": 100, "allegro": 138, "vivace": 156, "presto": 176}
NOTE_VALUES = {"dotted": 1.5, "eighths": 0.5, "halves": 2.0, "quarters": 1.0, "sixteenths": 0.25, "wholes": 4.0}
OFF_BANDS = {"straight": 0.08, "light": 0.32, "moderate": 0.55}
FLAT_NAMES = {"D#": "Eb", "G#": "Ab", "A#": "Bb"}
TOLERANCE = 0.05
RUN = 4


def tempo_word(bpm: Column) -> Column:
    """The nearest tempo word; the slower one wins a tie."""
    return F.array_min(F.array(*[F.struct(F.abs(bpm - v).alias("d"), F.lit(v).alias("v"), F.lit(k).alias("word")) for k, v in TEMPO_WORDS.items()]))["word"]


def beat_unit(meter: Column) -> Column:
    """The beat in quarter notes, from the denominator; 1 when there is none."""
    return F.coalesce(F.try_divide(F.lit(4.0), F.get(F.split(meter, "/"), F.lit(1)).try_cast("int")), F.lit(1.0))


def sixteenth_run(notes: DataFrame) -> DataFrame:
    """(piece_id, run): the most notes in a row, by bar, onset and order of writing, that are sixteenths.

    Only a bar's notes are ranked together; bars are then joined by where their first and last other note stand.
    """
    here = W.partitionBy("piece_id", "bar").orderBy("onb", "seq", "midi")
    other = F.abs(F.col("dur") - 0.25) >= TOLERANCE
    placed = notes.select("piece_id", "bar", other.alias("other"), F.row_number().over(here).alias("i"))
    breaks = placed.withColumn("at", F.when(F.col("other"), F.col("i")))
    before = F.last("at", ignorenulls=True).over(W.partitionBy("piece_id", "bar").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    bars = breaks.withColumn("gap", F.col("at") - before - 1).groupBy("piece_id", "bar").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("gap").alias("inner")
    )
    past = W.partitionBy("piece_id").orderBy("bar").rowsBetween(W.unboundedPreceding, -1)
    bars = bars.withColumn("off", F.coalesce(F.sum("n").over(past), F.lit(0)))
    bars = bars.withColumns({"first": F.col("off") + F.col("first"), "last": F.col("off") + F.col("last")})
    bars = bars.withColumn("cross", F.col("first") - F.coalesce(F.max("last").over(past), F.lit(0)) - 1)
    return bars.groupBy("piece_id").agg(
        F.greatest(F.max("inner"), F.max("cross"), F.sum("n") - F.coalesce(F.max("last"), F.lit(0))).cast("int").alias("run")
    )


def chord_quality(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.contains("maj7"), "maj7").when(label.endswith("7"), "dom7").when(low.contains("dim"), "diminished")
        .when(low.contains("aug"), "augmented").when(label.endswith("m") | (F.substring(label, 2, 1) == "m"), "minor").otherwise("major")
    )


def _qualities(chords: DataFrame) -> DataFrame:
    """(piece_id, qualities): kinds of chord by falling count, the one heard first on ties. There are six kinds."""
    each = chords.select("piece_id", "bar", F.posexplode(F.split("chord", r" \| ")).alias("half", "label")).where("label not in ('', '?')")
    counts = each.groupBy("piece_id", chord_quality(F.col("label")).alias("q")).agg(
        (-F.count(F.lit(1))).alias("k"), F.min(F.struct("bar", "half")).alias("since"))
    ordered = counts.groupBy("piece_id").agg(F.sort_array(F.collect_list(F.struct("k", "since", "q"))).alias("l"))
    return ordered.select("piece_id", F.array_join(F.transform("l", lambda x: x["q"]), ",").alias("qualities"))


def training_tags(fr: Frames, heads: DataFrame, keys: DataFrame, chords: DataFrame) -> DataFrame:
    """(piece_id, tag) of every piece with notes.

    heads: (piece_id, meter, tempo); keys: (piece_id, tonic, mode); chords: (piece_id, bar, chord). A piece without a row in
    keys or chords has no such tag; a missing tempo reads as 90.
    """
    c = F.col
    notes = fr.events.join(heads.select("piece_id", beat_unit(c("meter")).alias("unit")), "piece_id")
    dur, onb, unit = c("dur"), c("onb"), c("unit")
    next_beat = (F.floor(F.round(onb / unit, 6)) + 1) * unit
    base = notes.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n"), num.count_if(F.round(F.pmod(onb / unit, F.lit(1.0)), 3) != 0).alias("n_off"),
        F.max((onb < next_beat) & (next_beat < onb + dur - 1e-6)).alias("tie"),
        *[F.max(F.abs(F.round(dur, 3) - v) < TOLERANCE).alias(k) for k, v in NOTE_VALUES.items()],
    )
    at = fr.onsets.groupBy("piece_id", "bar", F.round("onb", 3).alias("o")).agg(F.sum("n").alias("k"), F.max("hi").alias("top"), F.bit_or("pcs").alias("pcs"))
    size = F.abs(c("top") - F.lag("top").over(W.partitionBy("piece_id").orderBy("bar", "o")))
    lines = at.withColumn("size", size).groupBy("piece_id").agg(
        F.max("k").alias("together"), F.avg((c("size") <= 2).cast("double")).alias("steps"), F.avg((c("size") >= 3).cast("double")).alias("leaps"), F.max("size").alias("widest"))
    chordal = at.groupBy("piece_id", "bar").agg(bits.size(F.bit_or("pcs")).alias("pcs")).groupBy("piece_id").agg(F.max("pcs").alias("bar_pcs"))
    df = heads.select("piece_id", "meter", F.col("tempo").alias("bpm")).join(base, "piece_id").join(lines, "piece_id").join(chordal, "piece_id").join(
        sixteenth_run(fr.events), "piece_id").join(keys.select("piece_id", "tonic", "mode"), "piece_id", "left").join(_qualities(chords), "piece_id", "left")
    if fr.bars is not None:
        df = df.join(fr.bars.groupBy("piece_id").agg(F.max((c("grid") == 12) & c("is_triplet")).alias("triplets")), "piece_id", "left")
    else:
        df = df.withColumn("triplets", F.lit(False))
    off = num.round_clean(c("n_off") / c("n"), 2)
    band = reduce(lambda other, kv: F.when(off < kv[1], kv[0]).otherwise(other), reversed(OFF_BANDS.items()), F.lit("heavy"))
    values = F.concat_ws("+", *[F.when(c(k), k) for k in (*NOTE_VALUES, "triplets")])
    tonic = reduce(lambda other, kv: F.when(c("tonic") == kv[0], kv[1]).otherwise(other), FLAT_NAMES.items(), c("tonic"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tags = F.array(
        text("meter:", c("meter")), text("tempo:", tempo_word(F.coalesce(c("bpm"), F.lit(90))), "(", F.coalesce(c("bpm").cast("string"), F.lit("?")), "bpm)"),
        text("key:", tonic, " ", c("mode")), text("syncopation:", band, "(", off, ")"), F.when(values != "", text("note-values:", values)),
        F.when(c("steps") >= 0.6, "melody:stepwise"), F.when((c("widest") >= 5) | (c("leaps") >= 0.3), "melody:leaps"),
        F.when(c("run") >= RUN, "device:sixteenth-runs"), F.when(c("tie"), "device:ties"),
        F.when(c("together") >= 3, "texture:block-chords").when(c("bar_pcs") >= 3, "texture:broken-chords/arpeggio").otherwise("texture:single-line"),
        text("chords:", c("qualities")),
    )
    return df.select("piece_id", F.explode(F.array_compact(tags)).alias("tag"))
