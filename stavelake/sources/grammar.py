"""Reader and writer of the piece notation ("grammar" text).

Reading is row-local: a file is one row, split into bar blocks, lines, tokens and pitches; only numbering a
file's pitches brings its rows together. Malformed bars, lines and tokens are skipped, and ``rejects`` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import pitch

# The notation's line and token patterns.
BAR = r"^@(\d+)\s+\[(.*?)\](?:\s+\(grid:(\w+)\))?\s*$"
TOKEN = r"^(.+?)@(\d+)>(\d+)(?:\^(\d+))?$"
VOICE = r"^(.*?)\s*\[(.*?)\]\s*$"
NEXT_BAR = r"\n(?=@\d+[^\S\n]+\[[^\n]*?\](?:[^\S\n]+\(grid:\w+\))?[^\S\n]*(?:\n|$))"


def read_files(spark: SparkSession, path: str, glob: str = "song_*.txt", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(piece_id, text), one row per file; the id is the file stem."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("piece_id"), F.col("value").alias("text")
    )
    return df.filter(~F.col("piece_id").isin(*exclude)) if exclude else df


def _header_field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\b{name}:\s*([^|]+?)\s*(?:\||$)", 1)


def _lines(texts: DataFrame) -> DataFrame:
    clean = F.regexp_replace("text", r"\r\n?", "\n")
    header = F.regexp_extract(clean, r"\A([^\n]*)", 1)
    second = F.regexp_extract(clean, r"\A[^\n]*\n([^\n]*)", 1)
    return texts.select("piece_id", clean.alias("text"), header.alias("header"), second.alias("second"))


def pieces(texts: DataFrame) -> DataFrame:
    """Header facts, with the defaults METER 4/4, GRID 16 and BARS 0."""
    df = _lines(texts)
    meter = _header_field(F.col("header"), "METER")
    num = F.coalesce(F.regexp_extract(meter, r"^(\d+)\s*/\s*(\d+)", 1).try_cast("int"), F.lit(4))
    den = F.coalesce(F.regexp_extract(meter, r"^(\d+)\s*/\s*(\d+)", 2).try_cast("int"), F.lit(4))
    labels = F.when(
        F.col("second").startswith("VOICES") & F.col("second").contains(":"),
        F.transform(F.split(F.regexp_extract("second", r"^[^:]*:(.*)$", 1), ","), lambda v: F.trim(v)),
    ).otherwise(F.array().cast("array<string>"))

    def annotation(v):
        return F.trim(F.lower(F.regexp_extract(v, VOICE, 2)))

    def bare(v):
        return F.when(v.rlike(VOICE), F.trim(F.regexp_extract(v, VOICE, 1))).otherwise(v)

    def program(v):
        return F.regexp_extract(annotation(v), r"^prog\s*=\s*(\d+)", 1).try_cast("int")

    voices = df.select(
        "piece_id",
        F.nullif(_header_field(F.col("header"), "KEY"), F.lit("")).alias("key"),
        num.alias("meter_num"),
        den.alias("meter_den"),
        (num * 4.0 / den).alias("bar_ql"),
        _header_field(F.col("header"), "TEMPO").try_cast("double").alias("tempo"),
        pitch.grid_int(_header_field(F.col("header"), "GRID")).alias("default_grid"),
        F.col("header").rlike(r"GRID:\s*\d+t\b").alias("default_triplet"),
        F.coalesce(F.regexp_extract(_header_field(F.col("header"), "BARS"), r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("n_bars"),
        labels.alias("labels"),
    )
    programs = F.filter(
        F.transform("labels", lambda v: F.struct(bare(v).alias("key"), program(v).bitwiseAND(F.lit(127)).alias("value"))),
        lambda e: e["value"].isNotNull(),
    )
    return voices.select(
        "*",
        F.transform("labels", bare).alias("voices"),
        # a later declaration of the same voice wins
        F.aggregate(
            programs,
            F.expr("cast(map() as map<string,int>)"),
            lambda m, e: F.map_concat(
                F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))
            ),
        ).alias("voice_programs"),
        F.transform(F.filter("labels", lambda v: annotation(v).isin("drums", "drum")), bare).alias("drum_voices"),
    ).drop("labels")


def bar_blocks(texts: DataFrame) -> DataFrame:
    clean = F.regexp_replace("text", r"\r\n?", "\n")
    body = F.regexp_replace(clean, r"\A[^\n]*\n?[^\n]*", "")  # the first two lines are header lines
    first = F.regexp_extract(F.regexp_extract(clean, r"\A([^\n]*)", 1), r"GRID:\s*([^|]+?)\s*(?:\||$)", 1)
    blocks = texts.select("piece_id", first.alias("default_label"), F.posexplode(F.split(body, NEXT_BAR)).alias("block_ix", "block"))
    top = F.regexp_extract("block", r"\A([^\n]*)", 1)
    label = F.regexp_extract(top, BAR, 3)
    return blocks.filter(top.rlike(BAR)).select(
        "piece_id",
        "block_ix",
        F.regexp_extract(top, BAR, 1).try_cast("int").alias("bar"),
        top.alias("top"),
        F.regexp_extract(top, BAR, 2).alias("chord"),
        F.when(label != "", pitch.grid_int(label)).otherwise(pitch.grid_int(F.col("default_label"))).alias("grid"),
        F.when(label != "", label.rlike(r"^\d+t")).otherwise(F.col("default_label").rlike(r"^\d+t\b")).alias("is_triplet"),
        "block",
    )


def _is_usable() -> Column:
    """A bar whose number fits and whose grid is not zero."""
    return F.col("bar").isNotNull() & F.col("grid").isNotNull()


def bars(texts: DataFrame) -> DataFrame:
    return bar_blocks(texts).filter(_is_usable()).drop("block", "top")


def voice_lines(texts: DataFrame) -> DataFrame:
    """Indented voice lines of recognised bars, with their raw text for citations."""
    lines = bar_blocks(texts).filter(_is_usable()).select(
        "piece_id", "block_ix", "bar", "grid", F.posexplode(F.split("block", "\n")).alias("line_ix", "line")
    )
    stripped = F.trim(F.col("line"))
    return lines.filter((F.col("line_ix") > 0) & F.col("line").startswith(" ")).select(
        "piece_id", "block_ix", "bar", "grid", "line_ix",
        F.trim(F.substring_index(stripped, ":", 1)).alias("voice"),
        F.when(stripped.contains(":"), F.trim(F.regexp_extract(stripped, r"^[^:]*:(.*)$", 1))).otherwise("").alias("raw"),
    )


def tokens(texts: DataFrame) -> DataFrame:
    return voice_lines(texts).select(
        "piece_id", "block_ix", "bar", "grid", "line_ix", "voice",
        F.posexplode(F.filter(F.split("raw", r"\s+"), lambda t: t != "")).alias("token_ix", "token"),
    )


def _number(group: int) -> Column:
    return F.regexp_extract("token", TOKEN, group).try_cast("int")


def rejects(texts: DataFrame) -> DataFrame:
    """Bars (by their first line), tokens and pitches the reader skips."""
    unusable = bar_blocks(texts).filter(~_is_usable()).select(
        "piece_id", "bar", F.lit(None).cast("string").alias("voice"), F.col("top").alias("token"),
        F.when(F.col("bar").isNull(), "bar").otherwise("grid").alias("reason"),
    )
    t = tokens(texts)
    oversized = t.filter(F.col("token").rlike(TOKEN) & (_number(2).isNull() | _number(3).isNull())).select(
        "piece_id", "bar", "voice", "token", F.lit("number").alias("reason")
    )
    bad_tokens = t.filter(~F.col("token").rlike(TOKEN)).select("piece_id", "bar", "voice", "token", F.lit("token").alias("reason"))
    names = t.filter(F.col("token").rlike(TOKEN)).select(
        "piece_id", "bar", "voice", F.explode(F.split(F.regexp_extract("token", TOKEN, 1), r"\+")).alias("token")
    )
    bad_names = names.filter(pitch.midi_of(F.col("token")).isNull()).withColumn("reason", F.lit("pitch"))
    return bad_tokens.unionByName(bad_names).unionByName(oversized).unionByName(unusable)


def events(texts: DataFrame) -> DataFrame:
    """Note events, one row per sounding pitch; ``seq`` counts a file's pitches in file order."""
    t = tokens(texts).filter(F.col("token").rlike(TOKEN) & _number(2).isNotNull() & _number(3).isNotNull())
    names = t.select(
        "*",
        _number(2).alias("slot"),
        _number(3).alias("slots"),
        F.regexp_extract("token", TOKEN, 4).try_cast("int").alias("vel"),
        F.posexplode(F.split(F.regexp_extract("token", TOKEN, 1), r"\+")).alias("pitch_ix", "name"),
    )
    head = pieces(texts).select("piece_id", "bar_ql", "voices", "voice_programs", "drum_voices")
    slot_ql = F.lit(4.0) / F.col("grid")
    onb = (F.col("slot") - 1) * slot_ql
    midi = pitch.midi_of(F.col("name"))
    place = F.array_position("voices", F.col("voice"))
    seq = F.row_number().over(W.partitionBy("piece_id").orderBy("block_ix", "line_ix", "token_ix", "pitch_ix")).cast("long")
    return (
        names.join(head, "piece_id")
        .withColumn("midi", midi)
        .filter(F.col("midi").isNotNull())
        .select(
            "piece_id",
            "voice",
            F.when(place > 0, place).cast("int").alias("voice_ix"),
            F.array_contains("drum_voices", F.col("voice")).alias("is_drum"),
            F.element_at("voice_programs", F.col("voice")).alias("program"),
            "bar",
            "grid",
            "slot",
            F.col("slots").alias("dur_slots"),
            F.bround(onb, 4).alias("onb"),
            F.bround((F.col("bar") - 1) * F.col("bar_ql") + onb, 4).alias("abs"),
            F.bround(F.col("slots") * slot_ql, 4).alias("dur"),
            F.col("midi").cast("int").alias("midi"),
            F.pmod("midi", F.lit(12)).cast("int").alias("pc"),
            "vel",
            seq.alias("seq"),
        )
    )


def render_lines(notes: DataFrame) -> DataFrame:
    """Voice lines of distinct notes: (piece_id, bar, grid, voice, voice_ix, line).

    Notes that share slot, length and velocity join into one chord token. A line is bounded by the
    grid of its bar, however often a note was repeated in the input.
    """
    chords = (
        notes.select("piece_id", "bar", "grid", "voice", "voice_ix", "slot", "dur_slots", "vel", "midi").distinct()
        .groupBy("piece_id", "bar", "grid", "voice", "voice_ix", "slot", "dur_slots", "vel")
        .agg(F.sort_array(F.collect_list("midi")).alias("midis"))
    )
    token = F.concat(
        F.array_join(F.transform("midis", pitch.midi_name), "+"),
        F.lit("@"), F.col("slot"), F.lit(">"), F.col("dur_slots"),
        F.when(F.col("vel").isNotNull(), F.concat(F.lit("^"), F.col("vel"))).otherwise(""),
    )
    return (
        chords.groupBy("piece_id", "bar", "grid", "voice", "voice_ix")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "dur_slots", "vel", token.alias("token")))).alias("t"))
        .select(
            "piece_id", "bar", "grid", "voice", "voice_ix",
            F.concat(F.lit("  "), "voice", F.lit(": "), F.array_join(F.transform("t", lambda x: x["token"]), " ")).alias("line"),
        )
    )


def render(notes: DataFrame, headers: DataFrame, chords: DataFrame | None = None, bars: DataFrame | None = None) -> DataFrame:
    """(piece_id, text). ``headers`` holds (piece_id, header, voices_line); chords (piece_id, bar, chord).

    With ``bars`` (piece_id, bar, grid, is_triplet) silent bars are written too and triplet grids carry their ``t``.
    """
    lines = render_lines(notes)
    bar_rows = lines.groupBy("piece_id", "bar", "grid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("voice_ix", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    if bars is None:
        bar_rows = bar_rows.withColumn("is_triplet", F.lit(False))
    else:
        bar_rows = bars.select("piece_id", "bar", "grid", "is_triplet").join(bar_rows, ["piece_id", "bar", "grid"], "left")
    if chords is None:
        bar_rows = bar_rows.withColumn("chord", F.lit(None).cast("string"))
    else:
        bar_rows = bar_rows.join(chords, ["piece_id", "bar"], "left")
    label = F.concat(F.col("grid").cast("string"), F.when(F.col("is_triplet"), "t").otherwise(""))
    block = F.concat(
        F.lit("@"), F.col("bar"), F.lit(" ["), F.coalesce("chord", F.lit("?")), F.lit("] (grid:"), label, F.lit(")"),
        F.coalesce(F.concat(F.lit("\n"), F.col("body")), F.lit("")),
    )
    bodies = bar_rows.groupBy("piece_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bar", block.alias("b")))), lambda x: x["b"]), "\n").alias("body")
    )
    return headers.join(bodies, "piece_id").select(
        "piece_id", F.concat_ws("\n", "header", "voices_line", "body").alias("text")
    )


def write_files(texts: DataFrame, path: str) -> None:
    """One partition folder per piece, one text record each."""
    texts.select("piece_id", F.col("text").alias("value")).write.partitionBy("piece_id").mode("overwrite").text(path)
