"""Interval and parallel claims against brute force on a small fixture."""

from itertools import product

from stavelake.operators import claims, lookups
from stavelake.operators.frames import Frames

COLS = ("piece_id long, voice string, voice_ix int, is_drum boolean, program int, bar int, onb double, abs double, dur double, midi int, pc int, seq long")


def notes(spark, rows):
    return spark.createDataFrame(
        [(p, f"V{v}", v, False, 0, int(t // 4) + 1, float(t % 4), float(t), float(d), m, m % 12, i) for i, (p, v, t, d, m) in enumerate(rows)], COLS
    )


NOTES = [
    (1, 1, 0, 2, 60), (1, 1, 0, 2, 64), (1, 1, 3, 1, 62), (1, 2, 1, 0.5, 67), (1, 2, 1.5, 4, 55), (1, 3, 9, 1, 40),
    (2, 1, 0, 1, 60), (2, 2, 0, 1, 50), (2, 1, 1, 1, 62), (2, 2, 1, 1, 52), (2, 3, 0, 1, 70), (2, 3, 1, 1, 69),
]


def brute(piece, a, b, semis):
    mine = [n for n in NOTES if n[0] == piece]
    at = lambda v, t: [m for _, w, s, d, m in mine if w == v and s <= t < s + d]
    return any(abs(x - y) == semis for t in {n[2] for n in mine if n[1] in (a, b)} for x, y in product(at(a, t), at(b, t)))


def test_every_asked_interval(spark):
    asked = [(p, a, b, s) for p in (1, 2) for a, b in product((1, 2, 3, 9), repeat=2) for s in range(13)]
    rows = spark.createDataFrame([(p, f"V{a}", f"V{b}", s) for p, a, b, s in asked], "piece_id long, voice_a string, voice_b string, semis int")
    got = {tuple(r) for r in lookups.ever_interval(notes(spark, NOTES), rows.union(rows)).collect()}
    assert got == {(p, f"V{a}", f"V{b}", s) for p, a, b, s in asked if brute(p, a, b, s)}
    assert (1, "V1", "V1", 4) in got and (1, "V2", "V1", 7) in got


def test_no_claims_no_rows(spark):
    empty = spark.createDataFrame([], "piece_id long, voice_a string, voice_b string, semis int")
    assert lookups.ever_interval(notes(spark, NOTES), empty).count() == 0


def test_parallel_voices(spark):
    pieces = spark.createDataFrame([(1, 4.0), (2, 4.0)], "piece_id long, bar_ql double")
    asked = spark.createDataFrame([(2, "V1", "V2"), (2, "V2", "V1"), (2, "V1", "V3"), (2, "V1", "V1"), (1, "V1", "V3")], "piece_id long, voice_a string, voice_b string")
    got = {tuple(r)[:3]: r["ever"] for r in claims.parallel_pairs(Frames(notes(spark, NOTES), pieces), asked).collect()}
    # A voice that moves is parallel to itself; voices without a shared onset have no row.
    assert got == {(2, "V1", "V2"): True, (2, "V2", "V1"): True, (2, "V1", "V3"): False, (2, "V1", "V1"): True}


def test_intervals_leave_dealt_notes_where_they_are(spark):
    """Notes, instants and sounding pairs were dealt anew by bar, instant and voice, ten times and more in all."""
    dealt = notes(spark, NOTES).repartition(3, "piece_id")
    found = lookups.voice_intervals(dealt)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    ever = {(r["piece_id"], r["voice_a"], r["voice_b"], r["semis"]): r["n"] for r in found.collect()}
    for p, a, b, s in product((1, 2), (1, 2, 3), (1, 2, 3), range(30)):
        assert ((p, f"V{a}", f"V{b}", s) in ever) == (a < b and brute(p, a, b, s))
    assert ever[2, "V1", "V2", 10] == 2
    asked = spark.createDataFrame([(1, "V1", "V2", 7)], "piece_id long, voice_a string, voice_b string, semis int")
    plan = lookups.ever_interval(dealt, asked)._jdf.queryExecution().executedPlan().toString()
    assert "voice" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line and "REPARTITION" not in line).split("hashpartitioning", 1)[-1].split("voice_a")[0]
