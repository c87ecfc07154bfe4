"""SQL twins for the diagnosis: every bar is really left out, and copied onsets are walked note by note."""

from __future__ import annotations

from oracle import reference
from oracle.base import PRELUDE
from oracle.overlap import CELLS

_BEAT = "least(onb - floor(onb), 1 - (onb - floor(onb)))"
_FR = "(onb - floor(onb))"

# axis -> (value, source); sources have one row set per (piece_id, cut), cut 0 leaving nothing out.
CUTS = {
    "backbeat_emphasis": ("sum(CASE WHEN round_even(onb,0) IN (1,3) THEN vel END) FILTER (abs(onb - round_even(onb,0)) < 0.12)"
                          " / sum(CASE WHEN round_even(onb,0) IN (0,1,2,3) THEN vel END) FILTER (abs(onb - round_even(onb,0)) < 0.12)::DOUBLE", "left_n"),
    "bar_pitch_range_mean": ("avg(span::DOUBLE) FILTER (k >= 2)", "left_b"),
    "drum_ratio": ("avg(CASE WHEN is_drum THEN 1.0::DOUBLE ELSE 0 END)", "left_n"),
    "duration_cv": ("CASE WHEN count(*) >= 2 THEN stddev_pop(dur) / avg(dur) END", "left_n"),
    "mean_note_length": ("avg(dur)", "left_n"),
    "note_density_bar_variability": ("CASE WHEN avg(k) > 0 THEN stddev_pop(k) / avg(k) END", "left_b"),
    "offbeat_onset_ratio": (f"avg(CASE WHEN {_BEAT} > 0.08 THEN 1.0::DOUBLE ELSE 0 END)", "left_n"),
    "onset_density": ("count(DISTINCT (voice, abs)) / (32 - (cut > 0)::INTEGER)::DOUBLE", "left_n"),
    "pc_entropy": ("-sum(CASE WHEN w > 0 THEN w / t * ln(w / t) ELSE 0 END) / ln(12)", "left_w"),
    "pcs_per_bar": ("avg(len(s)::DOUBLE) FILTER (len(s) > 0)", "left_s"),
    "register_center": ("avg(midi::DOUBLE)", "left_n"),
    "swing_ratio": (f"avg(CASE WHEN least(abs({_FR} - 0.667), abs({_FR} - 0.333)) < abs({_FR} - 0.5) THEN 1.0::DOUBLE ELSE 0 END)"
                    f" FILTER ({_FR} >= 0.12 AND {_FR} <= 0.88)", "left_n"),
    "velocity_dynamic_range": ("CASE WHEN count(*) >= 2 THEN stddev_pop(vel) END", "left_n"),
}

ATTRIBUTION = PRELUDE + """,
c AS (SELECT unnest(range(0, 33)) AS cut),
left_n AS (SELECT cut, n.* FROM n JOIN c ON n.bar <> cut),
left_b AS (SELECT cut, b.* FROM barn b JOIN c ON b.bar <> cut),
left_s AS (SELECT cut, s.* FROM spine s JOIN c ON s.bar <> cut),
left_w AS (SELECT *, sum(w) OVER (PARTITION BY piece_id, cut) AS t FROM (SELECT piece_id, cut, pc, sum(dur) AS w FROM left_n GROUP BY ALL)),
v AS (""" + " UNION ALL ".join(
    f"SELECT piece_id, cut, 'axis_{axis}' AS axis, {value} AS v FROM {source} GROUP BY piece_id, cut" for axis, (value, source) in CUTS.items()
) + """),
bo AS (SELECT p.piece_id, b.cut AS bar, a.axis, coalesce(w.v, 0) AS value, coalesce(r.v, 0) AS rest FROM p CROSS JOIN (SELECT cut FROM c WHERE cut > 0) b
  CROSS JOIN (SELECT DISTINCT axis FROM v) a LEFT JOIN v w ON w.piece_id = p.piece_id AND w.axis = a.axis AND w.cut = 0
  LEFT JOIN v r ON r.piece_id = p.piece_id AND r.axis = a.axis AND r.cut = b.cut)
SELECT piece_id, bar, axis, round(value, 6) AS value, round(rest, 6) AS without, round(round(rest, 6) - round(value, 6), 6) AS delta,
  row_number() OVER (PARTITION BY piece_id, axis ORDER BY round(abs(rest - value), 9) DESC, bar) AS rank FROM bo
"""

RUNS = CELLS + """,
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, song ORDER BY hits DESC, o) AS r FROM (
  SELECT a.piece_id, b.piece_id AS song, b.bar - a.bar AS o, count(*) AS hits FROM cell a JOIN cell b USING (onb, midi) WHERE a.piece_id <> b.piece_id GROUP BY ALL)) WHERE r = 1),
on_ AS (SELECT a.piece_id, al.song, a.bar, a.onb, any_value(a.bar + al.o) AS src_bar, count(b.midi) AS notes FROM allb JOIN al ON al.piece_id = allb.piece_id AND al.song = allb.song
  JOIN cell a ON a.piece_id = al.piece_id LEFT JOIN cell b ON b.piece_id = al.song AND b.bar = a.bar + al.o AND b.onb = a.onb AND b.midi = a.midi GROUP BY ALL),
mk AS (SELECT *, coalesce(lag(notes) OVER (PARTITION BY piece_id ORDER BY bar, onb), 0) = 0 AS opens FROM on_),
rn AS (SELECT *, sum(opens::INTEGER) FILTER (notes > 0) OVER (PARTITION BY piece_id ORDER BY bar, onb) AS run FROM mk),
ag AS (SELECT piece_id, song, run, min((bar, onb)) AS a, max((bar, onb)) AS z, min(src_bar) AS src_bar, count(*) AS n_onsets, sum(notes)::BIGINT AS n_notes
  FROM rn WHERE notes > 0 GROUP BY ALL)
SELECT piece_id, song, a[1] AS from_bar, a[2] AS from_onset, z[1] AS to_bar, z[2] AS to_onset, src_bar, n_onsets, n_notes,
  row_number() OVER (PARTITION BY piece_id ORDER BY n_notes DESC, a) AS rank FROM ag
"""


def build() -> dict[str, str]:
    saved = reference.build()["percentile_profile"]  # what was saved scores like what was fitted
    return {"bar_attribution": ATTRIBUTION, "copy_runs": RUNS, "saved_profile": saved}
