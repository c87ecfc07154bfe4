"""MIDI files of whole pieces: one group a piece, and the same bytes whatever the order of the notes."""

from pyspark.sql import functions as F

from stavelake.plans import registry
from stavelake.sources import midi

NOTES = "piece_id long, voice string, voice_ix int, is_drum boolean, program int, abs double, dur double, midi int, vel int"


def _notes(spark):
    rows = [(k, f"V{v}", v, v == 3, None if v == 3 else 24, s / 2, 1.0, 60 + s % 2, 80) for k in (1, 2) for v in (1, 2, 3) for s in range(9)]
    return spark.createDataFrame([*rows, (None, "V1", 1, False, None, 0.0, 1.0, 60, None)], NOTES)


def test_a_piece_is_grouped_once(spark):
    plan = midi.encode(_notes(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_bytes_do_not_depend_on_the_order_of_notes(spark):
    notes = _notes(spark)
    ways = [{r["piece_id"]: bytes(r["content"]) for r in midi.encode(n).collect()} for n in (notes, notes.orderBy(F.desc("abs"), "voice").coalesce(1))]
    assert ways[0] == ways[1] and set(ways[0]) == {1, 2, None}
    voice = [(n[4], n[6]) for n in midi.read_bytes(ways[0][1]) if n[1] == "V1"]
    assert sorted(voice) == [(s / 2, 60 + s % 2) for s in range(9)]


def test_roundtrip_flushes_and_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "DECODED", 4)
    rows = [(i * 7 + 1, i * 13 % 101, None if i % 11 == 0 else i % 5, i % 7 + 1, float(i % 9 + 1), f"1995-01-{i % 28 + 1:02d}") for i in range(200)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["piece_id"]: tuple(r)[1:] for r in registry.midi_roundtrip(spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1, 2, 3, 4, None} and all(n > 0 and (lost, extra) == (0, 0) for n, lost, extra in found.values())
