"""Ranks, overlap, retrieval, statistics and edits against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.operators import anomaly, dose, gates, levers, overlap, ranks, retrieval
from stavelake.sources import tables

SF = "/root/testdata/sf0.001"


def test_quantiles_and_cdf_match_numpy(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([0.0, 0.0, rng.gauss(0, 1)]))) for g in ("a", "b", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    cum = ranks.cumulative(df, ["g"], "v")
    got = {r["g"]: r for r in ranks.quantiles(cum, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    asked = spark.createDataFrame([(g, x) for g in "ab" for x in (-99.0, -0.3, 0.0, 0.41, 99.0)], "g string, v double")
    cdf = {(r["g"], r["v"]): r["cdf"] for r in ranks.cdf_scores(asked, cum, ["g"], "v").collect()}
    for g in "ab":
        vals = np.array([v for k, v in rows if k == g])
        for name, q in (("p5", 5), ("p50", 50), ("p95", 95)):
            assert got[g][name] == pytest.approx(np.percentile(vals, q))
        for x in (-99.0, -0.3, 0.0, 0.41, 99.0):
            assert cdf[g, x] == pytest.approx((vals <= x).mean())


def notes_frame(spark, rows):
    return spark.createDataFrame(rows, "piece_id string, bar int, onb double, midi int")


def slide(a, b):
    best = 0
    cells = {(bar, o, m) for bar, o, m in b}
    for off in range(-20, 21):
        best = max(best, len({(bar, o, m) for bar, o, m in a if (bar + off, o, m) in cells}))
    return best / len(a)


def test_overlap_matches_brute_force_and_ignores_shifts(spark):
    rng = random.Random(2)
    pieces = {p: [(rng.randint(1, 6), rng.randint(0, 7) / 2, rng.randint(60, 64)) for _ in range(40)] for p in "abcd"}
    pieces["e"] = [(bar + 3, o, m) for bar, o, m in pieces["a"]]
    df = notes_frame(spark, [(p, *n) for p, ns in pieces.items() for n in ns])
    got = {r["piece_id"]: r["overlap"] for r in overlap.corpus_overlap(df, df, top_k=None).collect()}
    for p, ns in pieces.items():
        assert got[p] == pytest.approx(max(slide(ns, o) for q, o in pieces.items() if q != p))
    assert got["a"] == got["e"]
    top = {r["piece_id"]: r["overlap"] for r in overlap.corpus_overlap(df, df, top_k=25).collect()}
    assert top == pytest.approx(got)  # five pieces: nothing is left out by the pre-filter


def test_overlap_has_no_limit_on_bars(spark):
    rows = [("a", bar, 0.5 * (bar % 7), 60 + bar % 5) for bar in range(1, 30)]
    far = [("b", bar + 5000, o, m) for _, bar, o, m in rows]
    wide = [("c", bar * 200_003, o, m) for _, bar, o, m in rows]
    df = notes_frame(spark, rows + far + wide)
    got = {r["piece_id"]: (r["song"], r["overlap"], r["bar_offset"]) for r in overlap.corpus_overlap(df, df).collect()}
    assert got["a"] == ("b", 1.0, 5000) and got["b"] == ("a", 1.0, -5000)


def test_a_piece_without_a_partner_has_no_risk(spark):
    df = notes_frame(spark, [("a", 1, 0.0, 60), ("a", 2, 0.0, 60)])
    rows = overlap.copy_risk(df, df).collect()
    assert [(r["piece_id"], r["song"], r["copy_risk"], r["passed"]) for r in rows] == [("a", None, 0.0, True)]


@pytest.mark.parametrize("k, n", [(0, 0), (0, 5), (1, 1), (3, 5), (8, 8), (7, 12), (5, 12), (60, 100), (600, 1100), (1500, 2900), (50_200, 100_001), (101_000, 200_500)])
def test_sign_test_is_exact_for_any_n(spark, k, n):
    from fractions import Fraction

    term, tail = math.comb(n, k), 0
    for i in range(k, n + 1):
        tail += term
        term = term * (n - i) // (i + 1)
    want = float(Fraction(tail, 2**n)) if k else 1.0
    got = spark.range(1).select(dose.sign_test(F.lit(k), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(want, rel=1e-8)


def test_poisson_counts_have_no_upper_end():
    cdf = dose._poisson_cdf()
    assert len(cdf) > 15 and cdf == sorted(cdf) and 1 - cdf[-1] < 1e-15
    assert cdf[1] - cdf[0] == pytest.approx(math.exp(-1)) and cdf[3] - cdf[2] == pytest.approx(math.exp(-1) / 6)


def test_small_genres_keep_their_pieces(spark):
    from stavelake.plans import registry

    fitness = registry.build()["piece_fitness"](spark, SF)
    assert fitness.count() == tables.pieces(spark, SF).count()
    states = registry.build()["genre_band_check"](spark, SF)
    assert states.select("piece_id").distinct().count() == fitness.count()


def test_overlap_is_the_same_for_any_block_size(spark, monkeypatch):
    n = tables.notes(spark, SF)
    whole = {r["piece_id"]: (r["song"], r["hits"]) for r in overlap.corpus_overlap(n, n).collect()}
    monkeypatch.setattr(overlap, "block_pairs", lambda *a, **k: __import__("stavelake.operators.blocks", fromlist=["x"]).block_pairs(*a, block_rows=3))
    assert {r["piece_id"]: (r["song"], r["hits"]) for r in overlap.corpus_overlap(n, n).collect()} == whole


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vec = {i: rng.integers(0, 5, 6).astype(float) for i in range(30)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "key long, vec array<double>")
    got = {}
    for r in retrieval.nearest(df, df, 3).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(r["neighbor"])
    for i, v in vec.items():
        want = sorted(((round(float(np.abs(v - o).mean()), 9), j) for j, o in vec.items() if j != i))[:3]
        assert got[i] == [j for _, j in want]


def test_sign_test_and_spearman(spark):
    df = spark.createDataFrame([(8, 8), (0, 0), (4, 8)], "k int, n int").select(dose.sign_test(F.col("k"), F.col("n")).alias("p"))
    assert [r["p"] for r in df.collect()] == pytest.approx([1 / 256, 1.0, 163 / 256])
    rows = [("up", i, float(i * i)) for i in range(5)] + [("down", i, -float(i)) for i in range(5)] + [("flat", i, 1.0) for i in range(5)]
    got = {r["g"]: r["rho"] for r in dose.spearman(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y").collect()}
    assert got == pytest.approx({"up": 1.0, "down": -1.0})


def test_dose_summary(spark):
    rows = [(f"p{i}", "ax", d, 5.0 - d * (1 + i), 2) for i in range(8) for d in (0.0, 0.5, 1.0)]
    r = dose.summarize(spark.createDataFrame(rows, "piece_id string, axis string, dose double, score double, entangled int")).first()
    assert (r["within_rho"], r["n"], r["n_neg"], r["validated"], r["entangled"]) == (-1.0, 8, 8, True, 2.0)
    assert r["sign_p"] == pytest.approx(1 / 256)
    flat = dose.summarize(spark.createDataFrame([("p", "flat", d, 1.0, 0) for d in (0.0, 1.0)], "piece_id string, axis string, dose double, score double, entangled int"))
    assert [tuple(r) for r in flat.collect()] == [("flat", None, 0, 0, None, 1.0, 0.0, False)]


def test_bootstrap_interval_holds_the_mean(spark):
    rows = [("a", i, float(i % 10)) for i in range(200)]
    r = dose.poisson_bootstrap_mean(spark.createDataFrame(rows, "g string, row_id long, v double"), ["g"], "v", draws=400).first()
    assert r["lo"] < r["mean"] == 4.5 < r["hi"] and r["hi"] - r["lo"] == pytest.approx(2 * 1.96 * 2.872 / math.sqrt(200), rel=0.25)


@pytest.mark.parametrize("metric", sorted(levers.LEVERS))
def test_levers_are_pure_and_dose_zero_is_identity(spark, metric):
    n = tables.notes(spark, SF)
    cols = ["piece_id", "bar", "voice", "slot", "dur_slots", "midi", "grid"]
    same = levers.perturb(n, metric, 0.0)
    assert same is n
    a, b = levers.perturb(n, metric, 0.6).select(cols), levers.perturb(n.repartition(5), metric, 0.6).select(cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not a.exceptAll(n.select(cols)).unionAll(n.select(cols).exceptAll(a)).isEmpty()


def test_triplet_lever_moves_bars_and_their_notes_together(spark):
    n, b = tables.notes(spark, SF), tables.bars(spark, SF)
    notes = levers.perturb(n, "rhy_triplet_share", 0.5).select("piece_id", "bar", "grid").distinct()
    bars = levers.perturb_bars(b, "rhy_triplet_share", 0.5)
    assert 0 < bars.filter("is_triplet").count() < bars.count()
    assert notes.join(bars.filter("is_triplet = (grid = 12)"), ["piece_id", "bar", "grid"], "left_anti").isEmpty()


@pytest.mark.parametrize("kind", [k for k in anomaly.KINDS if k != "parallel_fifths"])
def test_injection_changes_one_token(spark, kind):
    n = tables.notes(spark, SF)
    keys = n.select("piece_id").distinct().withColumn("key", F.lit(0b101010110101))
    sites = anomaly.site(n, kind, 1, keys).persist()
    edited = anomaly.inject(n, sites)
    token = ["piece_id", "bar", "voice", "slot", "dur_slots", "midi"]
    lost = n.select(token).distinct().exceptAll(edited.select(token).distinct())
    gained = edited.select(token).distinct().exceptAll(n.select(token).distinct())
    places = lost.unionByName(gained).select("piece_id", "bar", "voice", "slot").distinct()
    assert places.count() <= sites.count()
    assert places.join(sites, ["piece_id", "bar", "voice", "slot"], "left_anti").isEmpty()
    assert not gained.isEmpty()


def test_parallel_fifths_site(spark):
    n = tables.notes(spark, SF)
    s = anomaly.parallel_site(n)
    e = anomaly.inject_parallel(n, s)
    assert e.count() == n.count()
    hit = e.join(s, ["piece_id", "bar", "voice"]).filter("slot = s1 and midi <> new1 or slot = s2 and midi <> new2")
    assert hit.isEmpty()


def test_verifier_flags(spark):
    rows = [("p", b, v, i, False, s, d, m) for b, v, i, s, d, m in [
        (1, "Bass", 1, 1, 16, 48), (1, "Tenor", 2, 1, 16, 55), (1, "Alto", 3, 1, 16, 64), (1, "Soprano", 4, 1, 16, 72),
        (2, "Bass", 1, 1, 16, 50), (2, "Tenor", 2, 1, 16, 57), (2, "Alto", 3, 1, 16, 65), (2, "Soprano", 4, 1, 20, 74),
        (3, "Bass", 1, 1, 16, 60), (3, "Tenor", 2, 1, 16, 59), (3, "Alto", 3, 1, 16, 64), (3, "Soprano", 4, 1, 16, 66)]]
    df = spark.createDataFrame(rows, "piece_id string, bar int, voice string, voice_ix int, is_drum boolean, slot int, dur_slots int, midi int")
    keys = spark.createDataFrame([("p", 0b101010110101)], "piece_id string, key int")
    flags = {(r["bar"], r["kind"]) for r in anomaly.verify(df, keys).collect()}
    assert {(2, "parallel_fifths"), (2, "meter_glitch"), (3, "voice_crossing"), (3, "dissonance"), (3, "out_of_key")} <= flags
    assert not [f for f in flags if f[0] == 1]


def test_drift_kinds(spark):
    rows = [("p", "a", 3, 20), ("p", "b", 80, 99), ("p", "c", 30, 48), ("p", "d", 40, 41)]
    mk = lambda i: spark.createDataFrame([(r[0], r[1], r[i]) for r in rows], "piece_id string, axis string, percentile int")
    got = {r["axis"]: r["kind"] for r in gates.drift(mk(2), mk(3)).collect()}
    assert got == {"a": "toward-band", "b": "AWAY", "c": "centering", "d": "in-band"}
