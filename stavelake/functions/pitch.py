"""Pitch names, grids and quantization as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch-class names and the natural letters' pitch classes.
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
LETTER_PC = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# Coarse velocity levels and note values in beats.
VELOCITIES = (32, 56, 80, 104)
NOTE_VALUES = (
    (4.0, "whole"), (3.0, "dotted half"), (2.0, "half"), (1.5, "dotted quarter"), (1.0, "quarter"),
    (0.75, "dotted eighth"), (2 / 3, "eighth triplet"), (0.5, "eighth"), (1 / 3, "eighth triplet"), (0.25, "sixteenth"),
)
PITCH = r"^([A-Ga-g])([#b]*)(-?\d+)$"
PITCH_CLASS = r"^([A-Ga-g])([#b]*)(?:-?\d+)?$"


def _letter_and_accidentals(name: Column, pattern: str) -> Column:
    letter = F.upper(F.regexp_extract(name, pattern, 1))
    accidentals = F.regexp_extract(name, pattern, 2)
    base = F.create_map(*[x for k, v in LETTER_PC.items() for x in (F.lit(k), F.lit(v))])
    sharps = F.length(F.regexp_replace(accidentals, "b", ""))
    flats = F.length(F.regexp_replace(accidentals, "#", ""))
    return F.element_at(base, letter) + sharps - flats


def midi_of(name: Column) -> Column:
    """Scientific pitch name to MIDI number; null when malformed. C4 is 60."""
    name = F.trim(name)
    octave = F.regexp_extract(name, PITCH, 3).try_cast("int")
    return F.when(name.rlike(PITCH), (octave + 1) * 12 + _letter_and_accidentals(name, PITCH))


def pc_of(name: Column) -> Column:
    """Pitch class of a name with or without octave; null when malformed."""
    name = F.trim(name)
    return F.when(name.rlike(PITCH_CLASS), F.pmod(_letter_and_accidentals(name, PITCH_CLASS), F.lit(12)))


def pc_name(pc: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SHARP_NAMES)), (F.pmod(pc, F.lit(12)) + 1).cast("int"))


def midi_name(midi: Column) -> Column:
    return F.concat(pc_name(midi), (F.floor(midi / 12) - 1).cast("string"))


def grid_int(label: Column) -> Column:
    """First whole number of a grid label, 16 when there is none; null when it is zero or no int."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(16)).otherwise(F.nullif(digits.try_cast("int"), F.lit(0)))


def grid_label(grid: Column, triplet: Column) -> Column:
    return F.concat(grid.cast("string"), F.when(triplet, F.lit("t")).otherwise(F.lit("th")))


def quantize_velocity(vel: Column) -> Column:
    """Nearest coarse level; a tie takes the lower one."""
    return F.array_min(F.array(*[F.struct(F.abs(vel - v).alias("d"), F.lit(v).alias("v")) for v in VELOCITIES]))["v"]


def quantize(start: Column, dur: Column, bar_ql: Column, grid: Column) -> Column:
    """Absolute beats to (bar, slot, slots); an onset that rounds past the barline opens the next bar."""
    slot_ql = F.lit(4.0) / grid
    per_bar = F.rint(bar_ql / slot_ql)
    bar = F.floor(start / bar_ql)
    slot = F.rint((start - bar * bar_ql) / slot_ql)
    spill = slot >= per_bar
    return F.struct(
        (F.when(spill, bar + 2).otherwise(bar + 1)).cast("int").alias("bar"),
        (F.when(spill, F.lit(1)).otherwise(slot + 1)).cast("int").alias("slot"),
        F.greatest(F.lit(1), F.rint(dur / slot_ql).cast("int")).alias("slots"),
    )


def note_value(dur: Column) -> Column:
    """Name of the nearest note value; the earlier table entry wins a tie."""
    return F.array_min(
        F.array(*[
            F.struct(F.abs(F.lit(v) - dur).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n"))
            for i, (v, n) in enumerate(NOTE_VALUES)
        ])
    )["n"]
