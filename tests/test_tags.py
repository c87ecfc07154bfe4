"""Training tags on planted pieces."""

import random

import pytest

from stavelake.operators import tags
from stavelake.operators.frames import Frames

COLS = "piece_id long, voice string, voice_ix int, is_drum boolean, program int, bar int, onb double, abs double, dur double, midi int, pc int, seq long"
KEYS = "piece_id long, tonic string, mode string"
CHORDS = "piece_id long, bar int, chord string"


def notes(spark, rows):
    return spark.createDataFrame([(p, "V1", 1, False, 0, b, float(o), (b - 1) * 4.0 + o, float(d), m, m % 12, i) for i, (p, b, o, d, m) in enumerate(rows)], COLS)


def tagged(spark, rows, heads, keys=(), chords=()):
    fr = Frames(notes(spark, rows), None)
    out = tags.training_tags(fr, spark.createDataFrame(heads, "piece_id long, meter string, tempo int"), spark.createDataFrame(list(keys), KEYS), spark.createDataFrame(list(chords), CHORDS))
    got = {}
    for r in out.collect():
        got.setdefault(r["piece_id"], set()).add(r["tag"])
    return got


def test_every_kind_of_tag(spark):
    scale = [(1, 1, i * 0.25, 0.25, 60 + i) for i in range(8)] + [(1, 1, 2, 1.5, 67), (1, 1, 3.5, 1.0, 66)]
    chord = [(2, b, 0, 4, m) for b in (1, 2) for m in (60, 64, 67, 72 + 7 * (b - 1))]
    broken = [(3, 1, i * 0.5, 0.5, m) for i, m in enumerate((48, 52, 55, 60))]
    got = tagged(
        spark, scale + chord + broken, [(1, "4/4", 140), (2, "3/4", None), (3, "6/8", 75)],
        [(1, "D#", "minor"), (2, "C", "major")],
        [(2, 1, "Cmaj7 | G7"), (2, 2, "Dm"), (2, 3, "Bdim | Dm"), (2, 4, "?"), (2, 5, "Caug"), (2, 6, "F")],
    )
    assert got[1] == {"meter:4/4", "tempo:allegro(140bpm)", "key:Eb minor", "syncopation:heavy(0.7)", "note-values:dotted+quarters+sixteenths", "melody:stepwise",
                      "device:sixteenth-runs", "device:ties", "texture:broken-chords/arpeggio"}
    assert got[2] == {"meter:3/4", "tempo:andante(?bpm)", "key:C major", "syncopation:straight(0.0)", "note-values:wholes", "melody:leaps", "device:ties",
                      "texture:block-chords", "chords:minor,maj7,dom7,diminished,augmented,major"}
    assert got[3] == {"meter:6/8", "tempo:adagio(75bpm)", "syncopation:straight(0.0)", "note-values:eighths", "melody:leaps", "texture:broken-chords/arpeggio"}


def test_sixteenth_runs_equal_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for p in range(40):
        mine = [(p, b, s / 4, rng.choice((0.25, 0.25, 0.25, 0.5)), 60) for b in sorted(rng.sample(range(1, 9), rng.randint(1, 6))) for s in sorted(rng.sample(range(16), rng.randint(1, 9)))]
        run = best = 0
        for n in mine:
            run = run + 1 if n[3] == 0.25 else 0
            best = max(best, run)
        want[p] = best
        rows += mine
    assert {r["piece_id"]: r["run"] for r in tags.sixteenth_run(notes(spark, rows)).collect()} == want


@pytest.mark.parametrize(("meter", "unit"), [("4/4", 1.0), ("6/8", 0.5), ("2/2", 2.0), ("x", 1.0), (None, 1.0), ("3/0", 1.0)])
def test_beat_unit(spark, meter, unit):
    df = spark.createDataFrame([(meter,)], "m string")
    assert df.select(tags.beat_unit(df["m"]).alias("u")).first()["u"] == unit
