"""Levers that ask about a bar or a line read the notes where they were dealt by piece."""

import re

import pytest
from pyspark.sql import functions as F

from stavelake.operators import levers
from stavelake.sources import tables

METRICS = ("rhy_density_variability", "rhy_onset_density_per_bar", "tex_active_voice_density", "har_dimaug_rate", "tex_max_chord_width")


@pytest.fixture
def star(spark, tmp_path):
    rows = [(i * 7 + 1, i * 13 % 101, None if i % 11 == 0 else i % 5, i % 7 + 1, float(i % 9 + 1), f"1995-01-{i % 28 + 1:02d}") for i in range(400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("metric", METRICS)
def test_no_note_is_dealt_by_bar(spark, star, metric):
    edited = levers.perturb(tables.notes(spark, star), metric, 0.5)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", edited._jdf.queryExecution().executedPlan().toString())
    assert dealt and not [keys for keys in dealt if "bar#" in keys or "voice#" in keys]


def test_bars_keep_a_first_token(spark, star):
    notes = tables.notes(spark, star)
    edited = levers.perturb(notes, "rhy_onset_density_per_bar", 1.0)
    left = edited.groupBy("piece_id", "bar", "voice").agg(F.count_distinct("slot", "dur_slots").alias("n")).collect()
    want = notes.where("piece_id is not null").select("piece_id", "bar", "voice").distinct().count()
    assert len(left) == want and {r["n"] for r in left} == {1}
