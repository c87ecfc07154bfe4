"""Disjoint exemplars, legacy gap measures and extension seams against brute force and planted cases."""

import hashlib
from itertools import groupby
from types import SimpleNamespace

import pytest

from stavelake.operators import extend, legacy, retrieval
from stavelake.operators.frames import Frames

NOTE = "piece_id string, voice string, bar int, onb double, midi int, pc int, dur double"


def made(spark, notes):
    """Frames of (piece, voice, bar, onset, pitch) notes, each one beat long."""
    rows = [(p, v, b, float(o), m, m % 12, 1.0) for p, v, b, o, m in notes]
    pieces = sorted({(r[0], 0, 4.0, 32) for r in rows})
    return Frames(spark.createDataFrame(rows, NOTE), spark.createDataFrame(pieces, "piece_id string, genre int, bar_ql double, n_bars int"))


def test_disjoint_exemplars_equal_a_greedy_draw(spark):
    axes = ("x", "y")
    at = {(g, g * 100 + i): {"x": (i * 37 + g * 11) % 101, "y": (i * 53) % 97} for g, n in ((1, 13), (2, 5), (3, 1)) for i in range(n)}
    rows = [(g, p, a, v[a]) for (g, p), v in at.items() for a in axes]
    got = retrieval.disjoint_exemplars(spark.createDataFrame(rows, "genre int, piece_id long, axis string, percentile int"), 4, 2).collect()
    want, free = set(), dict(at)
    for draw in range(1, 5):
        picked = []
        for genre, group in groupby(sorted(free), key=lambda k: k[0]):
            group = list(group)
            center = {a: sum(free[k][a] for k in group) / len(group) for a in axes}
            near = sorted(group, key=lambda k: (round(sum(abs(free[k][a] - center[a]) for a in axes) / 2, 9), k[1]))[:6]
            lot = lambda k: (int(hashlib.md5(f"draw0|{draw}|{k[1]}".encode()).hexdigest()[:8], 16), k[1])
            picked += [(genre, draw, k[1], place) for place, k in enumerate(sorted(near, key=lot)[:2], 1)]
        want |= set(picked)
        free = {k: v for k, v in free.items() if k[1] not in {p[2] for p in picked}}
    assert {(r["genre"], r["draw"], r["piece_id"], r["place"]) for r in got} == want
    assert len({r["piece_id"] for r in got}) == len(got) == 8 + 5 + 1


def test_without_pieces_nothing_is_drawn(spark):
    assert retrieval.disjoint_exemplars(spark.createDataFrame([], "genre int, piece_id long, axis string, percentile int"), 2).count() == 0


def chords(piece, roots, lift=0, voice="V1"):
    return [(piece, voice, bar, i, 48 + lift + root + step) for bar, root in enumerate(roots, 1) for i, step in enumerate((0, 4, 7))]


def test_planted_bars_and_progression_are_found(spark):
    song = [0, 5, 7, 0, 9, 2, 7, 0, 4, 5]
    corpus = made(spark, chords("7", song) + chords("8", [1, 3, 6, 8, 10, 11, 1, 3, 6, 8]))
    # a: the progression an octave higher; b: half of its bars taken from a neighbour; c: seven bars, no run; d: the held-out region
    gen = made(spark, chords("a", song[1:9], 12) + chords("b", [1, 3, 6, 8]) + [("b", "V1", b, 0.5 * i, 90 + i) for b in range(5, 9) for i in range(4)]
               + chords("c", song[:7], 24) + chords("d", song))
    real = made(spark, chords("a", song[1:9]) + chords("b", song) + chords("c", song) + chords("d", song))
    near = spark.createDataFrame([("a", "8"), ("b", "7"), ("b", "8"), ("c", "8"), ("d", "8")], "piece_id string, song string")
    got = {r["piece_id"]: (r["copy_real"], r["copy_neighbors"], r["copy_harmony"]) for r in legacy.copies(gen, real, corpus, near).collect()}
    assert got == {"a": (0, 0, 100), "b": (0, 50, 0), "c": (0, 0, 0), "d": (100, 0, 100)}


def test_order_of_bars_matters_to_a_run(spark):
    song = [0, 5, 7, 0, 9, 2, 7, 0]
    runs = {r["piece_id"]: tuple(r["run"]) for r in legacy.harmony_runs(made(spark, chords("a", song) + chords("b", song[::-1]) + chords("c", song, 24))).collect()}
    assert runs["a"] == runs["c"] != runs["b"]


def test_thin_bars_are_not_compared(spark):
    thin = made(spark, [("a", "V1", 1, 0, 60), ("a", "V2", 1, 0, 60), ("a", "V1", 1, 1, 62)])
    assert legacy.bar_cells(thin.events).count() == 0  # two cells, one of them in two voices


def test_seams_use_sounding_bars(spark):
    c, g, f_sharp = [0, 4, 7], [7, 11, 14], [6, 10, 13]
    bar = lambda p, b, pcs: [(p, "V1", b, i, 48 + x) for i, x in enumerate(pcs)]
    # The source is silent in bars 1 and 4; it sounds C major in 2 and 3, F sharp major in 5.
    source = made(spark, [n for p in ("s", "i", "e", "x") for b, pcs in ((2, c), (3, c), (5, f_sharp)) for n in bar(p, b, pcs)])
    region = made(spark, [n for p in ("s", "i", "e", "x") for n in bar(p, 1, g) + bar(p, 2, c)])
    cases = spark.createDataFrame([("s", "start", 0), ("i", "infill", 4), ("e", "cont", 5), ("x", "infill", 1)], "piece_id string, type string, seam int")
    got = {r["piece_id"]: (r["before"], r["after"]) for r in extend.seams(region, source, cases).collect()}
    third = pytest.approx(1 / 5)
    assert got["s"] == (None, 1.0)  # the region's last bar against bar 2
    assert got["i"] == (third, 0.0)  # bar 3 against G major, C major against bar 5
    assert got["e"] == (0.0, None)
    assert got["x"] == (third, 1.0)  # nothing sounds up to bar 1, so the first sounding bar stands in


def test_voice_agreement(spark):
    a = made(spark, [("p", "V1", 1, 0, 60), ("p", "V2", 1, 0, 60)]).events
    b = made(spark, [("p", "V2", 1, 0, 60), ("p", "V3", 1, 0, 60), ("p", "V4", 1, 0, 60)]).events
    assert extend.voice_agreement(a, b).first()["voices"] == pytest.approx(1 / 4)


def test_extension_gates_both_ways(spark):
    """A region that passes every gate, and one that fails all of them."""
    song = [0, 5, 7, 0, 9, 2]
    source = made(spark, chords("good", song) + chords("bad", song))
    region = made(spark, chords("good", song[::-1], 12) + [("bad", f"X{b}", b, i, 48 + [1, 3, 6][i]) for b in range(1, 6) for i in range(3)] + chords("bad", song[:1])[:1])
    extremes = [(f"axis_{i}", 99, 90) for i in range(4)]  # beyond 95 here, from 85 on in the source: shared

    def profile(side):
        pick = lambda rows: [(a, float(p[side]), p[side]) for a, *p in rows]
        good = pick([("axis_a", 40, 50), ("axis_banded", 2, 20), ("axis_note_density_bar_variability", 100, 0), *extremes])
        bad = pick([(f"axis_{i}", 98, 50) for i in range(4)])
        return spark.createDataFrame([("good", 0, *r) for r in good] + [("bad", 0, *r) for r in bad], "piece_id string, genre int, axis string, value double, percentile int")

    corpus = SimpleNamespace(genre_bands=spark.createDataFrame([("axis_banded", 0, 1.0, 3.0)], "axis string, genre int, p25 double, p75 double"))
    cases = spark.createDataFrame([("good", "cont", 6), ("bad", "start", 0)], "piece_id string, type string, seam int")
    copy = spark.createDataFrame([("good", 0.1), ("bad", 0.3)], "piece_id string, vs_corpus double")
    rows = {r["piece_id"]: r for r in extend.measure(corpus, region, source, cases, profile(0), profile(1), copy).collect()}
    checks = ("coheres", "nondegenerate", "novel", "boundary_ok", "length_ok", "verdict")
    assert [rows["good"][c] for c in checks] == [True] * 6 and (rows["good"]["extremes"], rows["good"]["d_source"]) == (0, 10.7)
    assert [rows["bad"][c] for c in checks] == [False] * 6 and (rows["bad"]["extremes"], rows["bad"]["bars"]) == (4, 5)
