"""Shared CTEs: the note adapter and the 39 axes, each from its definition."""

from __future__ import annotations

NOTES = """
n AS (
  SELECT l_suppkey AS piece_id, 'V' || l_linenumber AS voice, CAST(l_linenumber AS INTEGER) AS voice_ix,
         l_linenumber = 7 AS is_drum,
         CASE WHEN l_linenumber < 7 THEN ((l_linenumber - 1) // 2) * 24 END AS program,
         CAST(1 + ((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 32) + 32) % 32 AS INTEGER) AS bar,
         CAST(1 + l_partkey % 16 AS INTEGER) AS slot,
         1 + CAST(trunc(l_quantity) AS INTEGER) % 8 AS dur_slots,
         CAST(36 + l_orderkey % 48 AS INTEGER) AS midi,
         CAST((36 + l_orderkey % 48) % 12 AS INTEGER) AS pc,
         [32, 56, 80, 104][1 + l_orderkey % 4] AS vel,
         l_orderkey * 64 + l_linenumber * 8 + CAST(trunc(l_quantity) AS INTEGER) % 8 AS seq,
         (l_partkey % 16) / 4.0::DOUBLE AS onb,
         (((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 32) + 32) % 32) * 4.0::DOUBLE
           + (l_partkey % 16) / 4.0::DOUBLE AS abs,
         (1 + CAST(trunc(l_quantity) AS INTEGER) % 8) / 4.0::DOUBLE AS dur
  FROM lineitem),
p AS (SELECT s_suppkey AS piece_id, CAST(s_nationkey AS INTEGER) AS genre, 32 AS n_bars, 4.0::DOUBLE AS bar_ql FROM supplier)
"""

LEVELS = """
voicemean AS (SELECT piece_id, voice, voice_ix, is_drum, avg(midi::DOUBLE) AS m, min(seq) AS s, count(*) AS n,
              count(DISTINCT abs) AS n_on FROM n GROUP BY ALL),
bass AS (SELECT piece_id, voice FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY m, s) AS r
         FROM voicemean WHERE NOT is_drum) WHERE r = 1),
lead AS (SELECT piece_id, voice FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY n_on DESC, voice_ix) AS r
         FROM voicemean) WHERE r = 1),
line AS (SELECT piece_id, abs, max(midi) AS top FROM n JOIN lead USING (piece_id, voice) GROUP BY ALL),
step AS (SELECT piece_id, abs, top - lag(top) OVER (PARTITION BY piece_id ORDER BY abs) AS d FROM line),
sgn AS (SELECT piece_id, abs, sign(d) AS s FROM step WHERE d <> 0),
pcw AS (SELECT piece_id, pc, sum(dur) AS w FROM n GROUP BY ALL),
tot AS (SELECT piece_id, sum(w) AS t FROM pcw GROUP BY ALL),
grid12 AS (SELECT piece_id, r.root AS root, d.pc AS pc, (d.pc - r.root + 12) % 12 AS deg, coalesce(w, 0) AS w
           FROM tot CROSS JOIN (SELECT unnest(range(12)) AS root) r CROSS JOIN (SELECT unnest(range(12)) AS pc) d
           LEFT JOIN pcw USING (piece_id, pc)),
inst AS (SELECT piece_id, round_even(abs * 4, 0) AS q, pc, min(midi) AS lo FROM n WHERE NOT is_drum GROUP BY ALL),
instb AS (SELECT piece_id, q, pc, min(lo) OVER (PARTITION BY piece_id, q) % 12 AS b,
          count(*) OVER (PARTITION BY piece_id, q) AS k, min(pc) OVER (PARTITION BY piece_id, q) AS mn FROM inst),
ch AS (SELECT piece_id, q, max(k) AS k, list_sort(list((pc - mn + 12) % 12)) AS shape,
       list((pc - b + 12) % 12) AS iv FROM instb GROUP BY ALL),
barpc AS (SELECT DISTINCT piece_id, bar, pc FROM n),
barset AS (SELECT piece_id, bar, list(pc) AS s FROM barpc GROUP BY ALL),
spine AS (SELECT piece_id, bar, coalesce(s, []) AS s FROM (SELECT piece_id, unnest(range(1, n_bars + 1)) AS bar FROM p) b
          LEFT JOIN barset USING (piece_id, bar)),
barn AS (SELECT b.piece_id, b.bar, count(n.bar) AS k, max(midi) - min(midi) AS span FROM (SELECT piece_id, unnest(range(1, n_bars + 1)) AS bar FROM p) b
         LEFT JOIN n ON n.piece_id = b.piece_id AND n.bar = b.bar GROUP BY ALL)
"""

MAJOR = "[0,2,4,5,7,9,11]"
MINOR = "[0,2,3,5,7,8,10]"


def _entropy(inner: str) -> str:
    """inner: (piece_id, c) rows."""
    return (
        "SELECT piece_id, -sum(c / t * ln(c / t)) AS v FROM (SELECT piece_id, c::DOUBLE AS c,"
        f" sum(c) OVER (PARTITION BY piece_id)::DOUBLE AS t FROM ({inner})) WHERE c > 0 GROUP BY ALL"
    )


_BEAT = "least(onb - floor(onb), 1 - (onb - floor(onb)))"
_FR = "(onb - floor(onb))"

# axis -> SQL returning (piece_id, v)
AXIS = {
    "active_voice_count": "SELECT piece_id, count(DISTINCT voice)::DOUBLE AS v FROM n GROUP BY ALL",
    "backbeat_emphasis": "SELECT piece_id, sum(CASE WHEN round_even(onb,0) IN (1,3) THEN vel END) / sum(CASE WHEN"
    " round_even(onb,0) IN (0,1,2,3) THEN vel END)::DOUBLE AS v FROM n WHERE abs(onb - round_even(onb,0)) < 0.12 GROUP BY ALL",
    "bar_pitch_range_mean": "SELECT piece_id, avg(span::DOUBLE) AS v FROM barn WHERE k >= 2 GROUP BY ALL",
    "bass_register_gap": "SELECT piece_id, median(midi::DOUBLE) - min(midi) AS v FROM n GROUP BY ALL HAVING count(*) >= 2",
    "bass_syncopation": f"SELECT piece_id, avg(CASE WHEN {_BEAT} > 0.08 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM n"
    " JOIN bass USING (piece_id, voice) GROUP BY ALL HAVING count(*) >= 2",
    "bass_walk_rate": "SELECT piece_id, avg(k::DOUBLE) AS v FROM (SELECT piece_id, bar, count(DISTINCT pc) AS k FROM n"
    " JOIN bass USING (piece_id, voice) GROUP BY ALL) GROUP BY ALL",
    "blue_note_content": "SELECT piece_id, sum(CASE WHEN deg IN (3,6,10) THEN w ELSE 0 END) / sum(w) AS v FROM grid12 JOIN"
    " (SELECT piece_id, root FROM (SELECT piece_id, root, row_number() OVER (PARTITION BY piece_id ORDER BY"
    " sum(CASE WHEN deg IN (0,4,7) THEN w ELSE 0 END) DESC, root) AS r FROM grid12 GROUP BY piece_id, root) WHERE r = 1)"
    " USING (piece_id, root) GROUP BY ALL",
    "chord_simultaneity_size": "SELECT piece_id, avg(k::DOUBLE) AS v FROM ch GROUP BY ALL",
    "chord_type_diversity": "SELECT piece_id, count(DISTINCT shape) / count(*)::DOUBLE AS v FROM ch WHERE k >= 2 GROUP BY ALL",
    "chromaticism": "SELECT piece_id, 1 - max(m) / max(t) AS v FROM (SELECT piece_id, root, scale, sum(CASE WHEN"
    " list_contains(scale, deg) THEN w ELSE 0 END) AS m FROM grid12 CROSS JOIN (SELECT unnest(["
    f"{MAJOR},{MINOR}]) AS scale) GROUP BY ALL) JOIN tot USING (piece_id) GROUP BY ALL",
    "contour_reversal_rate": "SELECT piece_id, sum(CASE WHEN s <> p THEN 1 ELSE 0 END) / count(p)::DOUBLE AS v FROM"
    " (SELECT piece_id, s, lag(s) OVER (PARTITION BY piece_id ORDER BY abs) AS p FROM sgn) GROUP BY ALL HAVING count(p) > 0",
    "dissonant_interval_ratio": "SELECT a.piece_id, avg(CASE WHEN least(b.pc - a.pc, 12 - b.pc + a.pc) IN (1,2,6) THEN"
    " 1.0::DOUBLE ELSE 0 END) AS v FROM inst a JOIN inst b ON a.piece_id = b.piece_id AND a.q = b.q AND a.pc < b.pc GROUP BY ALL",
    "drum_ratio": "SELECT piece_id, avg(CASE WHEN is_drum THEN 1.0::DOUBLE ELSE 0 END) AS v FROM n GROUP BY ALL",
    "drum_timbre_entropy": _entropy("SELECT piece_id, midi, count(*) AS c FROM n WHERE is_drum GROUP BY ALL"),
    "duration_cv": "SELECT piece_id, stddev_pop(dur) / avg(dur) AS v FROM n GROUP BY ALL HAVING count(*) >= 2",
    "harmonic_rhythm": "SELECT piece_id, avg(1 - len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q)))::DOUBLE) AS v"
    " FROM (SELECT piece_id, s, lag(s) OVER (PARTITION BY piece_id ORDER BY bar) AS q FROM spine)"
    " WHERE q IS NOT NULL AND len(s) + len(q) > 0 GROUP BY ALL",
    "instrument_diversity": _entropy("SELECT piece_id, program, count(*) AS c FROM n WHERE program IS NOT NULL GROUP BY ALL"),
    "leader_turnover": "SELECT piece_id, avg(CASE WHEN voice <> q THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT piece_id,"
    " voice, lag(voice) OVER (PARTITION BY piece_id ORDER BY beat) AS q FROM (SELECT piece_id, floor(abs) AS beat, voice,"
    " row_number() OVER (PARTITION BY piece_id, floor(abs) ORDER BY count(*) DESC, min(seq)) AS r FROM n WHERE NOT is_drum"
    " GROUP BY piece_id, floor(abs), voice) WHERE r = 1) WHERE q IS NOT NULL GROUP BY ALL",
    "legato_ratio": "SELECT piece_id, avg(least(dur / gap, 3)) AS v FROM (SELECT piece_id, dur, lead(abs) OVER (PARTITION BY"
    " piece_id, voice ORDER BY abs, seq, dur) - abs AS gap FROM n WHERE NOT is_drum) WHERE gap > 1e-6 GROUP BY ALL",
    "mean_note_length": "SELECT piece_id, avg(dur) AS v FROM n WHERE dur > 0 GROUP BY ALL",
    "melodic_interval_mean": "SELECT piece_id, avg(abs(d)::DOUBLE) AS v FROM step WHERE d IS NOT NULL GROUP BY ALL",
    "mode_majorness": "SELECT piece_id, sum(CASE WHEN deg = 4 THEN w WHEN deg = 3 THEN -w ELSE 0 END) / sum(w) AS v FROM grid12"
    " JOIN (SELECT piece_id, root FROM (SELECT piece_id, root, row_number() OVER (PARTITION BY piece_id ORDER BY"
    " sum(CASE WHEN deg IN (0,7) THEN w ELSE 0 END) DESC, root) AS r FROM grid12 GROUP BY piece_id, root) WHERE r = 1)"
    " USING (piece_id, root) GROUP BY ALL",
    "note_density_bar_variability": "SELECT piece_id, stddev_pop(k) / avg(k) AS v FROM barn GROUP BY ALL HAVING avg(k) > 0",
    "offbeat_onset_ratio": f"SELECT piece_id, avg(CASE WHEN {_BEAT} > 0.08 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM n GROUP BY ALL",
    "onset_density": "SELECT piece_id, count(DISTINCT (voice, abs)) / any_value(n_bars)::DOUBLE AS v FROM n JOIN p USING (piece_id) GROUP BY piece_id",
    "onset_synchrony": "SELECT piece_id, avg(CASE WHEN k >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT piece_id,"
    " count(DISTINCT voice) AS k FROM n WHERE NOT is_drum GROUP BY piece_id, round_even(abs * 4, 0)) GROUP BY ALL",
    "pc_entropy": "SELECT piece_id, -sum(CASE WHEN w > 0 THEN w / t * ln(w / t) ELSE 0 END) / ln(12) AS v FROM pcw"
    " JOIN tot USING (piece_id) GROUP BY ALL",
    "pcs_per_bar": "SELECT piece_id, avg(len(s)::DOUBLE) AS v FROM spine WHERE len(s) > 0 GROUP BY ALL",
    "polyphony": "SELECT piece_id, sum(dur) / (max(abs + dur) - min(abs)) AS v FROM n GROUP BY ALL",
    "power_chord_ratio": "SELECT piece_id, avg(CASE WHEN list_contains(iv, 7) AND NOT list_has_any(iv, [3,4]) THEN 1.0::DOUBLE"
    " ELSE 0 END) AS v FROM ch WHERE k >= 2 GROUP BY ALL",
    "register_center": "SELECT piece_id, avg(midi::DOUBLE) AS v FROM n GROUP BY ALL",
    "repeated_note_ratio": "SELECT piece_id, avg(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM step"
    " WHERE d IS NOT NULL GROUP BY ALL",
    "seventh_chord_ratio": "SELECT piece_id, avg(CASE WHEN list_has_any(iv, [3,4]) AND list_has_any(iv, [10,11]) THEN"
    " 1.0::DOUBLE ELSE 0 END) AS v FROM ch WHERE k >= 3 GROUP BY ALL",
    "swing_ratio": f"SELECT piece_id, avg(CASE WHEN least(abs({_FR} - 0.667), abs({_FR} - 0.333)) < abs({_FR} - 0.5) THEN"
    f" 1.0::DOUBLE ELSE 0 END) AS v FROM n WHERE {_FR} >= 0.12 AND {_FR} <= 0.88 GROUP BY ALL",
    "tertian_stack_depth": "SELECT piece_id, avg(" + " + ".join(
        f"list_has_any(iv, [{d}])::INTEGER" for d in ("3,4", "7", "10,11", "1,2", "5,6", "8,9"))
    + ") AS v FROM ch WHERE k >= 2 GROUP BY ALL",
    "tonic_pedal_fraction": "SELECT piece_id, max(w) / sum(w) AS v FROM (SELECT piece_id, pc, sum(dur) AS w FROM n JOIN bass"
    " USING (piece_id, voice) GROUP BY ALL) GROUP BY ALL",
    "velocity_dynamic_range": "SELECT piece_id, stddev_pop(vel) AS v FROM n GROUP BY ALL HAVING count(*) >= 2",
    "velocity_jitter": "SELECT piece_id, avg(abs(vel - q)::DOUBLE) AS v FROM (SELECT piece_id, vel, lag(vel) OVER (PARTITION BY"
    " piece_id ORDER BY abs, seq, dur) AS q FROM n) WHERE q IS NOT NULL GROUP BY ALL",
    "voice_register_separation": "SELECT piece_id, stddev_pop(m) AS v FROM voicemean WHERE NOT is_drum GROUP BY ALL"
    " HAVING count(*) >= 2",
}
AXIS_NAMES = sorted(f"axis_{a}" for a in AXIS)

PRELUDE = f"WITH {NOTES.strip()},\n{LEVELS.strip()}"


def axis_sql(axis: str) -> str:
    return (
        f"{PRELUDE}, a AS ({AXIS[axis]})\nSELECT piece_id, round(coalesce(v, 0), 6) AS value FROM p LEFT JOIN a USING (piece_id)"
    )


def fingerprint_cte() -> str:
    """raw(piece_id, genre, axis, value) over all 39 axes."""
    union = " UNION ALL ".join(f"SELECT piece_id, 'axis_{a}' AS axis, v FROM ({sql})" for a, sql in AXIS.items())
    names = ",".join(f"'{a}'" for a in AXIS_NAMES)
    return (
        f"allv AS ({union}),\nraw AS MATERIALIZED (SELECT p.piece_id, genre, x.axis, round(coalesce(v, 0), 6) AS value FROM p CROSS JOIN"
        f" (SELECT unnest([{names}]) AS axis) x LEFT JOIN allv USING (piece_id, axis))"
    )


FINGERPRINT = f"{PRELUDE},\n{fingerprint_cte()}"


def derived_fingerprint(notes: str, pieces: str) -> str:
    """A nested query: raw(piece_id, genre, axis, value) of notes derived from the adapter.

    ``notes`` and ``pieces`` are SELECTs over n0 and p0, the original adapter CTEs.
    """
    source = NOTES.strip().replace("n AS (", "n0 AS (", 1).replace("\np AS (", "\np0 AS (", 1)
    return f"WITH {source},\nn AS ({notes}),\np AS ({pieces}),\n{LEVELS.strip()},\n{fingerprint_cte()}\nSELECT * FROM raw"
