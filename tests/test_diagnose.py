"""Bar attribution, copied runs and the saved distribution on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from stavelake.operators import axes, diagnose, saved
from stavelake.operators.corpus import Corpus
from stavelake.operators.frames import Frames
from stavelake.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def loaded(spark):
    return tables.notes(spark, SF), tables.pieces(spark, SF), tables.bars(spark, SF)


def test_attribution_equals_recomputation(spark, loaded):
    """Leaving a bar out by subtraction gives the axes of the piece without its notes."""
    notes, pieces, bars = loaded
    fr = Frames(notes, pieces, bars)
    rows = {(r["piece_id"], r["axis"]): r for r in diagnose.bar_attribution(fr).where("bar = 5").collect()}
    axes_here = {axis for _, axis in rows}
    assert len(axes_here) == 13 and axes_here <= set(axes.AXES)
    cut = Frames(notes.where("bar <> 5").withColumn("bar", F.when(F.col("bar") > 5, F.col("bar") - 1).otherwise(F.col("bar"))), pieces.withColumn("n_bars", F.col("n_bars") - 1), bars)
    whole = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(fr).collect()}
    rest = {(r["piece_id"], r["axis"]): r["value"] for r in axes.fingerprint(cut).collect()}
    for key, r in rows.items():
        assert r["value"] == pytest.approx(whole[key], abs=1e-9) and r["without"] == pytest.approx(rest[key], abs=1e-9)


def test_attribution_ranks_the_odd_bar_first(spark, loaded):
    notes, pieces, bars = loaded
    odd = notes.withColumn("midi", F.when(F.col("bar") == 9, F.lit(127)).otherwise(F.lit(40)).cast("int"))
    first = diagnose.bar_attribution(Frames(odd, pieces, bars)).where("axis = 'axis_register_center' AND rank = 1")
    heard = notes.where("bar = 9").select("piece_id").distinct()
    assert {r["bar"] for r in first.join(heard, "piece_id").collect()} == {9}


def test_copied_runs_are_maximal_and_placed(spark, loaded):
    notes = loaded[0]
    one = notes.where(f"piece_id = {notes.agg(F.min('piece_id')).first()[0]}")
    moved = one.where("bar BETWEEN 3 AND 6").withColumns({"piece_id": F.lit(-1).cast(one.schema["piece_id"].dataType), "bar": F.col("bar") + 10})
    runs = diagnose.copy_runs(moved, one, exclude_self=False).orderBy("from_bar").collect()
    onsets = moved.select("bar", F.rint(F.col("onb") * 100)).distinct().count()
    assert len(runs) == 1 and runs[0]["n_onsets"] == onsets and runs[0]["rank"] == 1
    assert runs[0]["src_bar"] == runs[0]["from_bar"] - 10
    spoiled = moved.withColumn("midi", F.when(F.col("bar") == 15, F.lit(3)).otherwise(F.col("midi")).cast("int"))
    parts = diagnose.copy_runs(spoiled, one, exclude_self=False).orderBy("from_bar").collect()
    assert len(parts) == 2 and all(not r["from_bar"] <= 15 <= r["to_bar"] for r in parts)


def test_saved_distribution(spark, loaded, tmp_path):
    notes, pieces, bars = loaded
    corpus = Corpus(axes.fingerprint(Frames(notes, pieces, bars), ("genre",)))
    path = str(tmp_path / "reference")
    first = saved.save(corpus, path)
    read = saved.SavedCorpus(spark, path)
    assert read.version == first
    assert sorted(map(tuple, read.report(corpus.fingerprint).collect())) == sorted(map(tuple, corpus.profile_report().collect()))
    second = saved.save(corpus, path)
    assert saved.SavedCorpus(spark, path).version == second != first
    assert read.breakpoints.count() == 39  # readers of the old version go on
    current = tmp_path / "reference" / "CURRENT"
    state = json.loads(current.read_text())
    for wrong in (state | {"format": 99}, state | {"tables": {}}):
        saved._replace(spark, f"{path}/CURRENT", json.dumps(wrong))
        with pytest.raises(ValueError):
            saved.SavedCorpus(spark, path)
