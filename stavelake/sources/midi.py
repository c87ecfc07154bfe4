"""MIDI files in and out. Only the byte format is Python; timing, grids, lanes and labels are Spark plans."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.functions import pitch

TICKS = 480  # per quarter note; divides every binary and triplet grid
# Candidate grids in slots per whole note, coarsest first.
BINARY, TRIPLET, FINEST = (4, 8, 16, 32), (6, 12, 24), 64
RAW = "piece_id string, track int, name string, channel int, program int, is_drum boolean, start double, dur double, midi int, vel int"


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value, at, more = (value << 7) | (data[at] & 127), at + 1, data[at] & 128
        if not more:
            return value, at


def read_bytes(data: bytes) -> list[tuple]:
    """(track, name, channel, program, start, dur, midi, vel) in beats. Data bytes are clipped to 0..127."""
    if data[:4] != b"MThd":
        return []
    header, division = struct.unpack(">I", data[4:8])[0], struct.unpack(">H", data[12:14])[0] or TICKS
    at, track, out = 8 + header, 0, []
    while at + 8 <= len(data):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        chunk, at = data[at + 8 : at + 8 + size], at + 8 + size
        pos = tick = status = 0
        name, program, sounding = "", {}, {}
        while pos < len(chunk):
            step, pos = _varlen(chunk, pos)
            tick += step
            if chunk[pos] & 128:
                status, pos = chunk[pos], pos + 1
            if status == 0xFF:
                kind, (length, body) = chunk[pos], _varlen(chunk, pos + 1)
                if kind == 3:
                    name = chunk[body : body + length].decode("utf-8", "replace")
                pos = body + length
            elif status in (0xF0, 0xF7):
                length, body = _varlen(chunk, pos)
                pos = body + length
            else:
                command, channel = status >> 4, status & 15
                a = chunk[pos] & 127
                b = chunk[pos + 1] & 127 if command not in (0xC, 0xD) else 0
                pos += 1 if command in (0xC, 0xD) else 2
                if command == 0xC:
                    program[channel] = a
                elif command == 9 and b:
                    sounding.setdefault((channel, a), []).append((tick, b))
                elif command in (8, 9) and sounding.get((channel, a)):
                    on, vel = sounding[channel, a].pop(0)
                    out.append((track, name, channel, program.get(channel, 0), on / division, (tick - on) / division, a, vel))
        track += 1
    return out


def read_files(spark: SparkSession, path: str, glob: str = "*.mid") -> DataFrame:
    """Note rows of every file; one file is one piece. A format-0 file's channels stay apart by ``channel``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("piece_id"), "content"
    )

    def decode(batches):
        cols = ["piece_id", "track", "name", "channel", "program", "is_drum", "start", "dur", "midi", "vel"]
        for pdf in batches:
            rows = [
                (pid, t, n, ch, p, ch == 9, s, d, m, v)
                for pid, data in zip(pdf["piece_id"], pdf["content"]) for t, n, ch, p, s, d, m, v in read_bytes(bytes(data))
            ]
            yield pd.DataFrame(rows, columns=cols)

    return files.mapInPandas(decode, RAW)


def voices(raw: DataFrame) -> DataFrame:
    """Adds ``voice``: the track name, made unique per (track, channel) inside a piece with "#n"."""
    from pyspark.sql import Window as W

    label = F.when(F.trim("name") != "", F.regexp_replace(F.trim("name"), r"[:,\[\]|]", " ")).when(F.col("is_drum"), "Drums").otherwise("Voice")
    parts = raw.select("piece_id", "track", "channel", label.alias("label")).distinct()
    n = F.row_number().over(W.partitionBy("piece_id", "label").orderBy("track", "channel"))
    ix = F.row_number().over(W.partitionBy("piece_id").orderBy("track", "channel"))
    named = parts.select(
        "piece_id", "track", "channel", ix.cast("int").alias("voice_ix"),
        F.when(n > 1, F.concat("label", F.lit("#"), n)).otherwise(F.col("label")).alias("voice"),
    )
    return raw.join(named, ["piece_id", "track", "channel"])


def bar_grids(onsets: DataFrame) -> DataFrame:
    """Grid per bar from (piece_id, bar, voice, onb): the coarsest binary grid that keeps every voice's onsets
    apart, or a triplet grid that fits at least twice as well where the binary one fits badly.

    Returns (piece_id, bar, grid, is_triplet).
    """
    grids = F.explode(F.array(*map(F.lit, (*BINARY, FINEST, *TRIPLET))))
    o = onsets.select("piece_id", "bar", "voice", "onb").distinct().withColumn("g", grids)
    slot = F.rint(F.col("onb") / (F.lit(4.0) / F.col("g")))
    per_voice = o.groupBy("piece_id", "bar", "g", "voice").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(slot).alias("slots"), F.sum(F.abs(F.col("onb") - slot * (F.lit(4.0) / F.col("g")))).alias("off")
    )
    per_grid = per_voice.groupBy("piece_id", "bar", "g").agg(
        F.max(F.col("slots") < F.col("n")).alias("merged"), F.round(F.sum("off") / F.sum("n"), 12).alias("miss")
    )
    binary = F.col("g").isin(*BINARY, FINEST)
    free = ~F.col("merged") | (F.col("g") == FINEST)
    first = per_grid.groupBy("piece_id", "bar").agg(F.min(F.when(binary & free, F.struct("g", "miss"))).alias("b"))
    fits = ~F.col("merged") & F.col("g").isin(*TRIPLET) & (F.col("b.miss") > 0.02) & (F.col("miss") < 0.5 * F.col("b.miss"))
    triple = per_grid.join(first, ["piece_id", "bar"]).groupBy("piece_id", "bar").agg(
        F.min(F.when(fits, F.col("g"))).alias("t"), F.first("b.g").alias("g")
    )
    return triple.select("piece_id", "bar", F.coalesce("t", "g").alias("grid"), F.col("t").isNotNull().alias("is_triplet"))


def to_events(raw: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Quantized note events of decoded files on adaptive grids, ready to render or to measure."""
    v = voices(raw).withColumns({"bar": (F.floor(F.col("start") / bar_ql) + 1).cast("int"), "bar_ql": F.lit(bar_ql)})
    v = v.withColumn("onb", F.round(F.col("start") - (F.col("bar") - 1) * bar_ql, 6))
    q = v.join(bar_grids(v), ["piece_id", "bar"]).withColumn("q", pitch.quantize(F.col("start"), F.col("dur"), F.col("bar_ql"), F.col("grid")))
    slot_ql = F.lit(4.0) / F.col("grid")
    onb = F.round((F.col("q.slot") - 1) * slot_ql, 4)
    return q.select(
        "piece_id", "voice", "voice_ix", "is_drum", F.when(~F.col("is_drum"), F.col("program")).alias("program"), F.col("q.bar").alias("bar"), "grid",
        F.col("q.slot").alias("slot"), F.col("q.slots").alias("dur_slots"), onb.alias("onb"),
        F.round((F.col("q.bar") - 1) * bar_ql + onb, 4).alias("abs"), F.round(F.col("q.slots") * slot_ql, 4).alias("dur"), "midi",
        (F.col("midi") % 12).alias("pc"), pitch.quantize_velocity(F.col("vel")).alias("vel"), (F.rint(F.col("start") * TICKS) * 128 + F.col("midi")).cast("long").alias("seq"),
    )


def lanes(events: DataFrame) -> DataFrame:
    """Adds ``lane``: the first lane of the voice where the same pitch no longer sounds.

    The input holds distinct notes, so a group is one voice on its grid.
    """
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in events.columns) + ", lane int"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["abs", "midi", "dur"])
        return pdf.assign(lane=_lanes(zip(pdf["abs"], pdf["midi"], pdf["dur"])))

    return events.groupBy("piece_id", "voice").applyInPandas(place, schema)


def _lanes(notes: Iterable[tuple]) -> list[int]:
    """The lane of each of a voice's notes (start, midi, dur, ...), which come in order."""
    ends, out = {}, []
    for start, note, dur, *_ in notes:
        sounding = ends.setdefault(note, [])
        lane = next((i for i, e in enumerate(sounding) if e <= start + 1e-9), len(sounding))
        sounding[lane : lane + 1] = [start + max(dur, 1e-3)]
        out.append(lane)
    return out


_SHORT = [bytes([n]) for n in range(128)]


def _number(n: int) -> bytes:
    if n < 128:
        return _SHORT[n]
    out = bytes([n & 127])
    while n > 127:
        n >>= 7
        out = bytes([(n & 127) | 128]) + out
    return out


def _chunk(events: list[tuple[int, bytes]]) -> bytes:
    parts, last = [], 0
    for tick, data in sorted(events, key=lambda e: (e[0], e[1][0] >> 4 == 9)):
        parts += _number(tick - last), data
        last = tick
    body = b"".join((*parts, b"\x00\xff\x2f\x00"))
    return b"MTrk" + struct.pack(">I", len(body)) + body


def _missing(value: object) -> bool:
    return value is None or value != value


def write_bytes(notes: pd.DataFrame, bpm: float) -> bytes:
    """A format-1 file of a piece's notes: tempo track, then one track per voice lane; pitch and velocity are clamped."""
    tracks = [_chunk([(0, b"\xff\x51\x03" + struct.pack(">I", int(60_000_000 / bpm))[1:])])]
    voices, parts = {}, {}
    cols = ("abs", "midi", "dur", "vel", "voice", "voice_ix", "is_drum", "program")
    for row in sorted(zip(*(notes[c].tolist() for c in cols)), key=lambda r: r[:3]):
        voices.setdefault(row[4], []).append(row)
    for voice, rows in voices.items():
        for row, lane in zip(rows, _lanes(rows)):
            last = _missing(row[5])
            parts.setdefault((last, 0 if last else row[5], voice, lane), []).append(row)
    channel = 0
    for (_, _, voice, _), part in sorted(parts.items(), key=lambda p: p[0]):
        drum, program = bool(part[0][6]), part[0][7]
        ch = 9 if drum else channel % 15 + (channel % 15 >= 9)
        channel += not drum
        name = voice.encode()
        events = [(0, b"\xff\x03" + _number(len(name)) + name), (0, bytes([0xC0 | ch, 0 if _missing(program) else int(program) & 127]))]
        for start, midi, dur, vel, *_ in part:
            p, v = min(127, max(0, int(midi))), min(127, max(1, 80 if _missing(vel) else int(vel)))
            on, off = round(start * TICKS), round((start + max(dur, 1e-3)) * TICKS)
            events += [(on, bytes([0x90 | ch, p, v])), (max(off, on + 1), bytes([0x80 | ch, p, 0]))]
        tracks.append(_chunk(events))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), TICKS) + b"".join(tracks)


def encode(events: DataFrame, bpm: float = 100.0) -> DataFrame:
    """(piece_id, content): one file per piece, from its distinct notes. A piece is one group; its voices and lanes are parted there."""
    cols = ["piece_id", "voice", "voice_ix", "is_drum", "program", "abs", "dur", "midi", "vel"]
    kind = dict(events.dtypes)["piece_id"]
    return events.select(*cols).distinct().groupBy("piece_id").applyInPandas(
        lambda key, pdf: pd.DataFrame({"piece_id": [key[0]], "content": [write_bytes(pdf, bpm)]}), f"piece_id {kind}, content binary"
    )


def write_files(encoded: DataFrame, folder: str) -> None:
    """Each task writes its pieces into a folder every executor shares."""
    def save(rows):
        from pathlib import Path

        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            (Path(folder) / f"{r['piece_id']}.mid").write_bytes(bytes(r["content"]))

    encoded.foreachPartition(save)


def abc_pitch(midi):
    """ABC token of a MIDI column: C4 is "C", C5 is "c"."""
    name = pitch.pc_name(midi)
    letter, octave = F.substring(name, 1, 1), F.floor(midi / 12) - 1
    body = F.when(octave >= 5, F.concat(F.lower(letter), F.repeat(F.lit("'"), (octave - 5).cast("int")))).otherwise(
        F.concat(letter, F.repeat(F.lit(","), F.greatest(F.lit(0), 4 - octave).cast("int"))))
    return F.concat(F.when(F.length(name) > 1, "^").otherwise(""), body)


def abc_lines(events: DataFrame) -> DataFrame:
    """(piece_id, voice, line): one ABC line per voice with rests and barlines, unit an eighth, bars of four beats."""
    from pyspark.sql import Window as W

    w = W.partitionBy("piece_id", "voice").orderBy("abs", "midi", "dur")
    notes = events.select("piece_id", "voice", "abs", "dur", "midi").distinct()
    bar = F.floor(F.col("abs") / 4)
    crossed = bar - F.coalesce(F.floor(F.lag("abs").over(w) / 4), F.lit(0))
    cursor = F.when(crossed > 0, bar * 4.0).otherwise(F.coalesce(F.lag("abs").over(w) + F.lag("dur").over(w), F.lit(0.0)))
    rest = F.rint((F.col("abs") - cursor) * 2).cast("int")
    unit = F.rint(F.col("dur") * 2).cast("int")

    def count(n):
        return F.when(n != 1, n.cast("string")).otherwise("")

    token = F.concat_ws(
        " ", F.when(crossed > 0, F.rtrim(F.repeat(F.lit("| "), crossed.cast("int")))),
        F.when(F.col("abs") > cursor + 1e-6, F.concat(F.lit("z"), count(rest))), F.concat(abc_pitch(F.col("midi")), count(unit)),
    )
    return notes.withColumn("t", token).groupBy("piece_id", "voice").agg(
        F.sort_array(F.collect_list(F.struct("abs", "midi", "dur", "t"))).alias("ts")
    ).select("piece_id", "voice", F.concat(F.lit("[V:"), "voice", F.lit("] "), F.array_join(F.transform("ts", lambda x: x["t"]), " "), F.lit(" |")).alias("line"))
