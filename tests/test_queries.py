"""Registered queries against their SQL twins; STAVELAKE_FULL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
CORE = (
    "axis_velocity_jitter", "axis_legato_ratio", "fingerprint_axes", "corpus_breakpoints", "corpus_shapes", "percentile_profile",
    "band_summary", "genre_extremes", "copy_risk", "nearest_neighbors", "bank_form", "patterns_harmony", "ground_truth", "bar_chords",
    "anomaly_sites", "region_reprise", "lever_form_novelty_rate", "drift_verdict", "dose_response", "grammar_roundtrip",
)
NAMES = tuple(entry.oracle_sql()) if os.environ.get("STAVELAKE_FULL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, message, _ = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
