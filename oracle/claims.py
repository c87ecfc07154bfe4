"""SQL twin of claim grading, category by category from the notes."""

from __future__ import annotations

from oracle.edits import TRUTH

CLAIMS = TRUTH + """,
cl AS (SELECT CASE WHEN piece_id = (SELECT max(piece_id) FROM truth) THEN (SELECT min(piece_id) FROM truth) ELSE piece_id + 1 END AS piece_id, piece_id AS o, highest_midi AS hi, lowest_midi AS lo,
  most_active_voice AS act, active_span AS span, longest_beats AS longest, any_longer_than_bar AS over_bar, densest_bar AS dense, piece_id % 3 > 0 AS no_repeat,
  CASE WHEN piece_id % 6 = 0 THEN densest_bar ELSE piece_id % 32 + 1 END AS bar_b, piece_id % 12 AS root, distinct_pc_count AS pcs, subdivision AS sub, syncopation AS syn, note_value AS val,
  'V' || (piece_id % 7 + 1) AS va, 'V' || ((piece_id + 2) % 7 + 1) AS vb, 'V' || ((piece_id + 1) % 7 + 1) AS ia, 'V' || ((piece_id + 5) % 7 + 1) AS ib, piece_id * 7 % 48 AS semis FROM truth),
sm AS (SELECT o, max(sim) AS sim FROM cl JOIN ssm ON ssm.piece_id = cl.piece_id AND b1 = dense AND b2 = bar_b GROUP BY o),
ln AS (SELECT piece_id, voice, abs, max(midi) AS top FROM n GROUP BY ALL),
pl AS (SELECT o, bool_or(da <> 0 AND da = db) AS ever FROM (SELECT o, a.top - lag(a.top) OVER w AS da, b.top - lag(b.top) OVER w AS db FROM cl JOIN ln a ON a.piece_id = cl.piece_id AND a.voice = va
  JOIN ln b ON b.piece_id = cl.piece_id AND b.voice = vb AND a.abs = b.abs WINDOW w AS (PARTITION BY o ORDER BY a.abs)) GROUP BY o),
iv AS (SELECT DISTINCT o FROM cl JOIN n a ON a.piece_id = cl.piece_id AND a.voice = ia JOIN n b ON b.piece_id = cl.piece_id AND b.voice = ib AND abs(a.midi - b.midi) = semis
  WHERE (a.abs <= b.abs AND b.abs < a.abs + a.dur - 1e-9) OR (b.abs <= a.abs AND a.abs < b.abs + b.dur - 1e-9)),
pw AS (SELECT piece_id, pc, sum(dur) AS w FROM n GROUP BY ALL),
inside AS (SELECT o, sum(CASE WHEN list_contains(CASE o % 3 WHEN 0 THEN [0,2,4,5,7,9,11] WHEN 1 THEN range(12) ELSE [0,3,5,6,7,10] END, (pc - root + 12) % 12) THEN w ELSE 0 END) / sum(w) AS mass,
  arg_max(pc, (w, -pc)) AS top FROM cl JOIN pw USING (piece_id) GROUP BY o),
hp1 AS (SELECT DISTINCT o, pc FROM cl JOIN n USING (piece_id)),
hb1 AS (SELECT DISTINCT o, pc FROM cl JOIN n ON n.piece_id = cl.piece_id AND n.bar = dense),
g AS (SELECT cl.piece_id, {
  'range:highest': (hi = t.highest_midi), 'range:lowest': (lo = t.lowest_midi), 'range:active_voice': (act = t.most_active_voice), 'range:span': abs(span - t.active_span) <= 1,
  'rhythm_basic:longest': abs(longest - t.longest_beats) <= 0.25, 'rhythm_basic:over_bar': (over_bar = t.any_longer_than_bar), 'rhythm_basic:densest': (dense = t.densest_bar),
  'repetition': CASE WHEN no_repeat THEN NOT t.near_identical_bars ELSE coalesce(sim, 0) >= 0.9 OR dense = bar_b END,
  'voice_rel:parallel': coalesce(ever, false) = (cl.o % 5 > 0), 'voice_rel:interval': (cl.o IN (SELECT o FROM iv)) = (cl.o % 4 > 0),
  'pitch_content:present': ((cl.o, root) IN (SELECT o, pc FROM hp1)) = (cl.o % 2 = 0), 'pitch_content:count': (pcs = t.distinct_pc_count),
  'rhythm_type:subdivision': (sub = t.subdivision), 'rhythm_type:syncopation': (syn = t.syncopation), 'rhythm_type:note_value': (val = t.note_value),
  'chord_constituents': (cl.o, root) IN (SELECT o, pc FROM hb1) AND (cl.o, (root + 4) % 12) IN (SELECT o, pc FROM hb1) } AS marks,
  CASE WHEN mass < 0.9 THEN 0.0 WHEN top = root THEN 1.0 ELSE 0.5 END AS scale
  FROM cl JOIN truth t ON t.piece_id = cl.piece_id LEFT JOIN sm ON sm.o = cl.o LEFT JOIN pl ON pl.o = cl.o JOIN inside ON inside.o = cl.o)
"""

CATEGORIES = (
    "range:highest", "range:lowest", "range:active_voice", "range:span", "rhythm_basic:longest", "rhythm_basic:over_bar", "rhythm_basic:densest", "repetition", "voice_rel:parallel",
    "voice_rel:interval", "pitch_content:present", "pitch_content:count", "rhythm_type:subdivision", "rhythm_type:syncopation", "rhythm_type:note_value", "chord_constituents",
)


def build() -> dict[str, str]:
    rows = [f"SELECT piece_id, '{c}' AS category, coalesce(marks['{c}'], false)::INTEGER::DOUBLE AS score FROM g" for c in CATEGORIES]
    return {"claim_grades": CLAIMS + " UNION ALL ".join([*rows, "SELECT piece_id, 'scale_mode', scale::DOUBLE FROM g"])}
