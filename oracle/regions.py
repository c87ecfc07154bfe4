"""SQL twins for sub-pieces and region grading."""

from __future__ import annotations

from oracle.base import derived_fingerprint
from oracle.edits import pick
from oracle.reference import CORPUS

CUTS = "(SELECT 'start' AS type, 0 AS lo, 6 AS hi UNION ALL SELECT 'infill', 13, 19 UNION ALL SELECT 'cont', 24, 32) c"
REST = "voice, voice_ix, is_drum, program, slot, dur_slots, midi, pc, vel, seq, onb, dur"
GAP_N = f"SELECT piece_id || '|' || type AS piece_id, CAST(bar - lo AS INTEGER) AS bar, abs - lo * 4 AS abs, {REST} FROM n0 CROSS JOIN {CUTS} WHERE bar > lo AND bar <= hi"
CTX_N = f"SELECT piece_id || '|' || type AS piece_id, CAST(CASE WHEN bar > hi THEN bar - (hi - lo) ELSE bar END AS INTEGER) AS bar, CASE WHEN bar > hi THEN abs - (hi - lo) * 4 ELSE abs END AS abs, {REST} FROM n0 CROSS JOIN {CUTS} WHERE NOT (bar > lo AND bar <= hi)"
GAP_P = f"SELECT piece_id || '|' || type AS piece_id, genre, hi - lo AS n_bars, bar_ql FROM p0 CROSS JOIN {CUTS}"
CTX_P = f"SELECT piece_id || '|' || type AS piece_id, genre, 32 - (hi - lo) AS n_bars, bar_ql FROM p0 CROSS JOIN {CUTS}"
GEN_N = GAP_N.replace("midi, pc,", "CASE WHEN pk THEN least(127, midi + 1) ELSE midi END AS midi, CASE WHEN pk THEN (midi + 1) % 12 ELSE pc END AS pc,").replace(
    "FROM n0", f"FROM (SELECT *, {pick('har_chromaticism')} < 0.25 AS pk FROM n0)")


def scored(name: str, notes: str, pieces: str) -> str:
    return f""",
{name}_raw AS MATERIALIZED ({derived_fingerprint(notes, pieces)}),
{name} AS MATERIALIZED (SELECT f.piece_id, f.genre, f.axis, f.value, CAST(round_even(coalesce(c.u, 0) / (SELECT max(t) FROM cdf)::DOUBLE * 100, 0) AS INTEGER) AS percentile
  FROM {name}_raw f ASOF LEFT JOIN cdf c ON f.axis = c.axis AND f.value >= c.value)"""


EXT = """,
gx AS (SELECT f.piece_id, f.genre, count(*) FILTER ((f.percentile <= 5 OR f.percentile >= 95) AND NOT coalesce(f.value BETWEEN g.p25 AND g.p75, false)) AS extremes
  FROM gap f LEFT JOIN gb g USING (axis, genre) GROUP BY ALL),
bud AS (SELECT genre, CAST(ceil(round(quantile_cont(extremes::DOUBLE, 0.85), 9)) AS INTEGER) AS c1_budget FROM gx GROUP BY genre)"""

CASES = f"""
WITH_SOURCE
gapn AS ({GAP_N.replace('n0', 'n')}),
ctxn AS ({CTX_N.replace('n0', 'n')}),
slid AS (SELECT piece_id, max(k) AS k FROM (SELECT g.piece_id, r.bar - g.bar AS o, count(*) AS k FROM (SELECT DISTINCT piece_id, bar, onb, midi FROM gapn) g
  JOIN (SELECT DISTINCT piece_id, bar, onb, midi FROM ctxn) r ON g.piece_id = r.piece_id AND g.onb = r.onb AND g.midi = r.midi GROUP BY ALL) GROUP BY ALL),
rep AS (SELECT piece_id, split_part(piece_id, '|', 2) AS type, coalesce(k, 0) / c::DOUBLE AS reprise FROM (SELECT piece_id, count(*) AS c FROM gapn GROUP BY ALL) LEFT JOIN slid USING (piece_id)),
gate AS (SELECT type, count(*) AS n, round(CAST(quantile_cont(round(reprise, 9), 0.75) AS DECIMAL(28,9)), 3)::DOUBLE AS gate FROM rep GROUP BY type)"""

SEG_N = f"SELECT piece_id || '|' || least((bar - 1) // 6, 4) AS piece_id, CAST(bar - least((bar - 1) // 6, 4) * 6 AS INTEGER) AS bar, abs - least((bar - 1) // 6, 4) * 24 AS abs, {REST} FROM n0"
SEG_P = "SELECT piece_id || '|' || s AS piece_id, genre, CASE WHEN s = 4 THEN 8 ELSE 6 END AS n_bars, bar_ql FROM p0 CROSS JOIN (SELECT unnest(range(5)) AS s) s"

DIST = "SELECT a.piece_id, avg(abs(a.percentile - b.percentile)::DOUBLE) AS d FROM {0} a JOIN {1} b USING (piece_id, axis) GROUP BY ALL"


def build() -> dict[str, str]:
    gap = CORPUS + scored("gap", GAP_N, GAP_P)
    cases = CASES.replace("WITH_SOURCE\n", "").strip()
    ctx = scored("ctx", CTX_N, CTX_P)
    return {
        "within_song_variation": CORPUS + f", seg AS MATERIALIZED ({derived_fingerprint(SEG_N, SEG_P)})\nSELECT CAST(piece_id AS BIGINT) AS piece_id, round(avg(s / CASE WHEN sd <> 0 THEN sd ELSE 1e-9 END), 6) AS wsv"
        " FROM (SELECT split_part(piece_id, '|', 1) AS piece_id, axis, stddev_pop(value) AS s FROM seg GROUP BY ALL) JOIN bps USING (axis) GROUP BY piece_id",
        "region_profile": gap + "\nSELECT piece_id, axis, value, percentile FROM gap",
        "region_budget": gap + EXT + "\nSELECT genre, c1_budget FROM bud",
        "region_reprise": gap + ",\n" + cases + "\nSELECT piece_id, type, round(reprise, 6) AS reprise FROM rep",
        "reprise_gate": gap + ",\n" + cases + "\nSELECT type, n, gate FROM gate",
        "region_fitness": gap + EXT + ctx + ",\n" + cases + f""",
dc AS ({DIST.format('gap', 'ctx')}),
ob AS (SELECT piece_id, count(*) FILTER (NOT value BETWEEN lo AND hi) AS n_oob FROM gap JOIN tgt USING (axis, genre) GROUP BY piece_id),
nbar AS (SELECT piece_id, count(DISTINCT bar) AS b, CASE type WHEN 'cont' THEN 8 ELSE 6 END AS t FROM (SELECT *, split_part(piece_id, '|', 2) AS type FROM gapn) GROUP BY ALL),
z AS (SELECT gx.piece_id, type, gx.genre, extremes, c1_budget, coalesce(n_oob, 0) AS n_oob, reprise, gate, d, abs(b - t) AS le FROM gx JOIN bud USING (genre) JOIN dc USING (piece_id) JOIN rep USING (piece_id)
  JOIN gate USING (type) JOIN nbar USING (piece_id) LEFT JOIN ob USING (piece_id))
SELECT piece_id, type, genre, extremes, c1_budget, n_oob, round(CAST(reprise AS DECIMAL(28,9)), 3)::DOUBLE AS reprise, gate, round(CAST(d AS DECIMAL(28,9)), 1)::DOUBLE AS d_ctx, extremes <= c1_budget AS c1_pass,
 le <= 2 AS c2_pass, reprise <= gate AS copy_pass, extremes <= c1_budget AND le <= 2 AND reprise <= gate AND n_oob <= 6 AS converged,
 round(CAST(greatest(0, extremes - c1_budget) * 40 + CASE WHEN le <= 2 THEN 0 ELSE 50 END + greatest(0, reprise - gate) * 300 + n_oob * 2 + le * 3 + d * 0.5 AS DECIMAL(28,9)), 1)::DOUBLE AS score FROM z""",
        "channel_check": CORPUS + ",\n" + cases + f""",
genn AS ({GEN_N.replace('n0', 'n')}),
g AS (SELECT DISTINCT piece_id, bar, onb, midi FROM genn),
o AS (SELECT g.* FROM g JOIN (SELECT DISTINCT piece_id, bar, onb, midi FROM gapn) USING (piece_id, bar, onb, midi)),
e AS (SELECT o.piece_id, count(*) AS n_overlap, count(*) FILTER (EXISTS (SELECT 1 FROM ctxn c WHERE c.piece_id = o.piece_id AND c.onb = o.onb AND c.midi = o.midi)) AS x FROM o GROUP BY o.piece_id),
c AS (SELECT piece_id, count(*) AS n FROM g GROUP BY ALL)
SELECT piece_id, n, coalesce(n_overlap, 0) AS n_overlap, round(coalesce(n_overlap, 0) / n::DOUBLE, 6) AS rate, round(coalesce(x / n_overlap::DOUBLE, 1), 6) AS innocent,
  1 - coalesce(x / n_overlap::DOUBLE, 1) > 0.10 AND coalesce(n_overlap, 0) / n::DOUBLE >= 0.20 AS leak FROM c LEFT JOIN e USING (piece_id)""",
        "final_grade": gap + ctx + scored("gen", GEN_N, GAP_P) + ",\n" + cases + f""",
genn AS ({GEN_N.replace('n0', 'n')}),
gr AS ({DIST.format('gen', 'gap')}),
cg AS ({DIST.format('gen', 'ctx')}),
far AS (SELECT g.piece_id, f.piece_id AS other, round(avg(abs(g.percentile - f.percentile)::DOUBLE), 9) AS d FROM gap g JOIN prof f USING (axis) GROUP BY ALL),
bt AS (SELECT far.piece_id, CAST(round_even(count(*) FILTER (far.d > round(gr.d, 9)) / count(*)::DOUBLE * 100, 0) AS INTEGER) AS beat_pct FROM far JOIN gr USING (piece_id) GROUP BY far.piece_id),
an AS (SELECT piece_id, max(k) AS k FROM (SELECT g.piece_id, r.bar - g.bar AS o, count(*) AS k FROM (SELECT DISTINCT piece_id, bar, onb, midi FROM genn) g JOIN (SELECT DISTINCT piece_id, bar, onb, midi FROM gapn) r
  ON g.piece_id = r.piece_id AND g.onb = r.onb AND g.midi = r.midi GROUP BY ALL) GROUP BY ALL),
ax AS (SELECT piece_id, coalesce(k, 0) / c::DOUBLE AS a FROM (SELECT piece_id, count(*) AS c FROM genn GROUP BY ALL) LEFT JOIN an USING (piece_id))
SELECT piece_id, round(CAST(gr.d AS DECIMAL(28,9)), 1)::DOUBLE AS d_gr, round(CAST(cg.d AS DECIMAL(28,9)), 1)::DOUBLE AS d_cg, beat_pct, round(CAST(a AS DECIMAL(28,9)), 3)::DOUBLE AS answer_overlap,
  a >= 0.3 OR (gr.d < 5 AND a >= 0.2) AS replication FROM gr JOIN cg USING (piece_id) JOIN bt USING (piece_id) JOIN ax USING (piece_id)""",
    }
