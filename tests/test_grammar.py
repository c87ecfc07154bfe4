"""Reader, writer and axes on the hand-worked two-bar piece."""

import pytest
from pyspark.sql import functions as F

from stavelake.functions import pitch
from stavelake.operators import axes, facts, patterns
from stavelake.operators.frames import Frames
from stavelake.sources import grammar

GOLDEN = """KEY: C major | METER: 4/4 | TEMPO: 120 | GRID: 16th | BARS: 2
VOICES: Lead[prog=0], Low[prog=33], Kit[drums]
@1 [C]
  Lead: C4+E4@1>4^80 G4@5>8^104
  Low: C2@1>16^80
  Kit: C2@1>1^104 D2@5>1^56
@2 [G7] (grid:12t)
  Lead: G4@1>3^80 B4@4>1^80
"""
AXES = {
    "active_voice_count": 3, "chord_simultaneity_size": 1.25, "onset_density": 3.5, "onset_synchrony": 0.25, "drum_ratio": 0.25,
    "dissonant_interval_ratio": 0, "register_center": 54.875, "tonic_pedal_fraction": 1.0, "harmonic_rhythm": 0.8,
    "melodic_interval_mean": 2.333333, "offbeat_onset_ratio": 0, "repeated_note_ratio": 0.333333, "velocity_dynamic_range": 14.387495,
    "contour_reversal_rate": 0, "velocity_jitter": 13.714286, "polyphony": 1.84375,
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("g1", GOLDEN), ("g1b", GOLDEN.replace("^80", "", 1)), ("bad", GOLDEN.replace("G4@5>8^104", "junk H9@1>2"))]
    return spark.createDataFrame(rows, "piece_id string, text string")


def frames(texts):
    return Frames(grammar.events(texts), grammar.pieces(texts), grammar.bars(texts))


def test_events(texts):
    ev = grammar.events(texts).filter("piece_id = 'g1'").orderBy("seq").collect()
    assert [e["midi"] for e in ev] == [60, 64, 67, 36, 36, 38, 67, 71]
    assert [e["abs"] for e in ev] == [0, 0, 1, 0, 0, 1, 4, 5]
    assert [e["dur"] for e in ev] == [1, 1, 2, 4, 0.25, 0.25, 1, 0.3333]


def test_header_and_bars(texts):
    p = grammar.pieces(texts).filter("piece_id = 'g1'").first()
    assert (p["key"], p["bar_ql"], p["n_bars"], p["drum_voices"]) == ("C major", 4.0, 2, ["Kit"])
    assert p["voice_programs"] == {"Lead": 0, "Low": 33}
    assert [(b["bar"], b["grid"], b["is_triplet"]) for b in grammar.bars(texts).filter("piece_id = 'g1'").orderBy("bar").collect()] == [(1, 16, False), (2, 12, True)]


def test_rejects(texts):
    bad = {(r["token"], r["reason"]) for r in grammar.rejects(texts).collect()}
    assert bad == {("junk", "token"), ("H9", "pitch")}


def test_unusable_numbers_are_rejected_not_fatal(spark):
    text = GOLDEN + "@3 [C] (grid:0)\n  Lead: C4@1>1\n@99999999999 [C]\n  Lead: C4@1>1\n@4 [F]\n  Lead: C4@99999999999>3 D4@1>99999999999 E4@1>2^80\n"
    df = spark.createDataFrame([("x", text)], "piece_id string, text string")
    assert [e["midi"] for e in grammar.events(df).filter("bar > 2").collect()] == [64]
    assert sorted((r["reason"], r["token"]) for r in grammar.rejects(df).collect()) == [
        ("bar", "@99999999999 [C]"), ("grid", "@3 [C] (grid:0)"), ("number", "C4@99999999999>3"), ("number", "D4@1>99999999999")]
    assert sorted(b["bar"] for b in grammar.bars(df).collect()) == [1, 2, 4]


def test_order_has_no_width(spark):
    chord = "+".join(f"{n}{o}" for o in range(0, 8) for n in "C D E F G A B Bb Eb".split())
    line = " ".join(f"C4@{i}>1" for i in range(1, 9001))
    text = f"KEY: C major | METER: 4/4 | GRID: 16th | BARS: 1\nVOICES: A\n@1 [C]\n  A: {chord}@1>1 {line}\n  A: D4@1>1\n"
    rows = grammar.events(spark.createDataFrame([("x", text)], "piece_id string, text string")).orderBy("seq").collect()
    assert len({r["seq"] for r in rows}) == len(rows) == 72 + 9000 + 1
    assert [r["slot"] for r in rows[72:-1]] == list(range(1, 9001)) and rows[-1]["midi"] == 62


def test_roundtrip_keeps_bars_grids_and_chords(texts):
    one = texts.filter("piece_id = 'g1'")
    head = one.select("piece_id", F.lit(GOLDEN.splitlines()[0]).alias("header"), F.lit(GOLDEN.splitlines()[1]).alias("voices_line"))
    bars = grammar.bars(one)
    silent = bars.limit(1).select("piece_id", F.lit(7).alias("bar"), F.lit("Am").alias("chord"), F.lit(24).alias("grid"), F.lit(True).alias("is_triplet"))
    cols = ["bar", "chord", "grid", "is_triplet"]
    want = bars.select("piece_id", *cols).unionByName(silent)
    back = grammar.render(grammar.events(one), head, want.select("piece_id", "bar", "chord"), want)
    assert sorted(map(tuple, grammar.bars(back).select(*cols).collect())) == [(1, "C", 16, False), (2, "G7", 12, True), (7, "Am", 24, True)]
    assert grammar.events(back).select("bar", "slot", "midi", "vel").exceptAll(grammar.events(one).select("bar", "slot", "midi", "vel")).isEmpty()


def test_axes(texts):
    got = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(frames(texts)).collect()}
    for name, want in AXES.items():
        assert got["g1", f"axis_{name}"] == pytest.approx(want, abs=1e-4), name
    # one missing velocity silences every velocity axis
    assert got["g1b", "axis_velocity_jitter"] == got["g1b", "axis_velocity_dynamic_range"] == 0
    assert got["g1b", "axis_register_center"] == got["g1", "axis_register_center"]


def test_wide_and_single_axis_agree(texts):
    fr = frames(texts)
    wide = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(fr).collect()}
    for axis in ("axis_legato_ratio", "axis_polyphony", "axis_bass_walk_rate"):
        for r in axes.axis_value(fr, axis).collect():
            assert wide[r["piece_id"], axis] == r["value"]


def test_roundtrip(texts):
    ev = grammar.events(texts).filter("piece_id = 'g1'")
    head = ev.select("piece_id").distinct().withColumns(
        {"header": F.lit(GOLDEN.splitlines()[0]), "voices_line": F.lit(GOLDEN.splitlines()[1])})
    back = grammar.events(grammar.render(ev, head))
    cols = ["voice", "bar", "onb", "abs", "dur", "midi", "vel"]
    assert ev.select(cols).exceptAll(back.select(cols)).count() == 0
    assert back.select(cols).exceptAll(ev.select(cols)).count() == 0


def test_transposing_keeps_pitch_class_axes(texts):
    fr = frames(texts)
    up = Frames(fr.events.withColumn("midi", F.col("midi") + 12), fr.pieces)
    a = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(fr).collect()}
    b = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(up).collect()}
    for axis in ("axis_chromaticism", "axis_pc_entropy", "axis_dissonant_interval_ratio", "axis_harmonic_rhythm"):
        assert a["g1", axis] == pytest.approx(b["g1", axis])


def test_encoding_cost(spark):
    # six notes: four in the right hand, two in the left
    rows = [("x", v, 1, False, 0, 0, 1, 16, s, 1, (s - 1) / 4.0, (s - 1) / 4.0, 0.25, m, m % 12, 80, i)
            for i, (v, s, m) in enumerate([("RH", 1, 72), ("RH", 5, 74), ("RH", 9, 76), ("RH", 13, 77), ("LH", 1, 48), ("LH", 9, 50)])]
    ev = spark.createDataFrame(rows, "piece_id string, voice string, voice_ix int, is_drum boolean, program int, x int, bar int, grid int, slot int,"
                                     " dur_slots int, onb double, abs double, dur double, midi int, pc int, vel int, seq long")
    p = spark.createDataFrame([("x", 4.0, 1)], "piece_id string, bar_ql double, n_bars int")
    r = facts.encoding_cost(Frames(ev, p)).first()
    assert (r["n_notes"], r["n_voices"], r["n_bars"]) == (6, 2, 1)
    assert (r["onset_recovery"], r["edit_blast"], r["vertical_align"]) == (4, 7, 10)


def test_patterns_on_text(spark):
    bars = "\n".join(f"@{b} [C]\n  Mel: C5@1>4 D5@5>4 E5@9>4 D5@13>4\n  Bass: C2@1>4 C2@5>4 C2@9>4 C2@13>4" for b in range(1, 11))
    text = f"KEY: C major | METER: 4/4 | GRID: 16th | BARS: 10\nVOICES: Mel, Bass\n{bars}\n"
    found = {r["pattern"]: r["bar"] for r in patterns.detect(frames(spark.createDataFrame([("p", text)], "piece_id string, text string"))).collect()}
    assert found["H:pedal_point"] == 1 and found["R:root_pulse_bass"] == 1 and found["R:ostinato"] == 1
    assert found["F:verbatim_reprise"] == 1 and found["M:stepwise"] == 1 and found["R:straight"] == 1
    assert found["M:motivic_cell"] == 1
    assert "F:sparse_intro" not in found and "H:dominant7" not in found


def test_pitch_names(spark):
    df = spark.createDataFrame([("C4",), ("F##3",), ("Bb-1",), ("H2",)], "n string").select(pitch.midi_of(F.col("n")).alias("m"))
    assert [r["m"] for r in df.collect()] == [60, 55, 10, None]
    v = spark.createDataFrame([(44,), (1,), (127,)], "v int").select(pitch.quantize_velocity(F.col("v")).alias("q"))
    assert [r["q"] for r in v.collect()] == [32, 32, 104]
