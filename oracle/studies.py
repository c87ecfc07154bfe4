"""SQL twins for drift, calibration, correlation, dose-response and trajectories."""

from __future__ import annotations

from oracle.bank import FORM, HARMONY, MELODY, RHYTHM, ROLE_LEVELS, TEXTURE, even, long
from oracle.base import AXIS_NAMES, PRELUDE, derived_fingerprint
from oracle.edits import BAR, D, MEANS, SQL_LEVERS, lever_sql, pick
from oracle.overlap import CELLS
from oracle.reference import CORPUS, STATUS
from oracle.regions import REST, scored

SHIFTED = f"SELECT piece_id, bar, abs, {REST} FROM n0".replace(
    "midi, pc,", "CASE WHEN pk THEN least(127, midi + 1) ELSE midi END AS midi, CASE WHEN pk THEN (midi + 1) % 12 ELSE pc END AS pc,").replace(
    "FROM n0", f"FROM (SELECT *, {pick('har_chromaticism')} < 0.25 AS pk FROM n0)")

S0, S1 = STATUS.replace("percentile", "p0"), STATUS.replace("percentile", "p1")
DRIFT = CORPUS + scored("aft", SHIFTED, "SELECT * FROM p0") + f""",
mv AS (SELECT a.piece_id, a.axis, b.percentile AS p0, a.percentile AS p1, a.percentile - b.percentile AS delta FROM aft a JOIN prof b USING (piece_id, axis)),
dr AS (SELECT *, CASE WHEN {S0} <> 'in' AND ((delta > 0 AND p0 < 25) OR (delta < 0 AND p0 > 75)) THEN 'toward-band' WHEN {S0} <> 'in' THEN 'AWAY'
  WHEN abs(p1 - 50) < abs(p0 - 50) - 3 THEN 'centering' ELSE 'in-band' END AS kind, abs(delta) >= 15 AS large FROM mv WHERE delta <> 0)
"""

MEDLEY = CORPUS + """,
cen AS (SELECT genre, axis, avg(percentile::DOUBLE) AS center FROM prof GROUP BY ALL),
exq AS (SELECT genre, piece_id, row_number() OVER (PARTITION BY genre ORDER BY round(avg(abs(percentile - center)), 9), piece_id) AS r FROM prof JOIN cen USING (genre, axis) GROUP BY genre, piece_id),
ex AS (SELECT genre, piece_id FROM exq WHERE r = 1),
cs AS MATERIALIZED (SELECT piece_id AS a, genre AS genre_a, coalesce(lead(piece_id) OVER (ORDER BY genre), first_value(piece_id) OVER (ORDER BY genre)) AS b FROM ex)
"""
MED_N = (f"SELECT a || '_' || b || '|' || ((bar - 1) // 8) AS piece_id, CAST(1 + (bar - 1) % 8 AS INTEGER) AS bar, abs - ((bar - 1) // 8) * 32 AS abs, {REST} FROM n0 JOIN cs"
         " ON (bar <= 16 AND piece_id = a) OR (bar > 16 AND piece_id = b)")
MED_P = "SELECT a || '_' || b || '|' || s AS piece_id, genre_a AS genre, 8 AS n_bars, 4.0::DOUBLE AS bar_ql FROM cs CROSS JOIN (SELECT unnest(range(4)) AS s) s"


DOSES = (0.25, 0.5, 1.0)
HIGH = ("har_chromaticism", "mel_pitch_range", "mel_voice_range", "rhy_mean_dur_beats", "rhy_syncopation_rate", "rhy_triplet_share", "rhy_density_variability",
        "har_dimaug_rate", "tex_max_chord_width", "tex_mean_simultaneity", "mel_step_ratio", "mel_up_ratio", "form_self_similarity")


def _variants() -> str:
    """All notes as they are and after every lever at every dose, with the time columns recomputed."""
    parts = ["SELECT '|0.0|' || piece_id AS piece_id, voice, bar, slot, dur_slots, midi, 16 AS grid FROM n"]
    for d in DOSES:
        parts += [f"SELECT '{m}|{d}|' || piece_id AS piece_id, voice, bar, slot, dur_slots, midi, grid FROM ({q})" for m, q in lever_sql(d).items()]
    return (
        "SELECT piece_id, voice, CAST(substr(voice, 2) AS INTEGER) AS voice_ix, voice = 'V7' AS is_drum, NULL::INTEGER AS program, bar::INTEGER AS bar, slot::INTEGER AS slot,"
        " dur_slots::INTEGER AS dur_slots, midi::INTEGER AS midi, (midi % 12)::INTEGER AS pc, 0 AS vel, 0 AS seq, round((slot - 1) * 4.0::DOUBLE / grid, 4) AS onb,"
        " round((bar - 1) * 4 + round((slot - 1) * 4.0::DOUBLE / grid, 4), 4) AS abs, round(dur_slots * 4.0::DOUBLE / grid, 4) AS dur FROM (" + " UNION ALL ".join(parts) + ")"
    )


def _study() -> str:
    """xrow(piece_id, axis, dose, score, entangled): the bank over all variants, nested so that its CTEs read them."""
    metrics = RHYTHM | HARMONY | MELODY | TEXTURE | FORM | {
        "rhy_onset_pos_entropy": even("SELECT piece_id, round_even((abs % 4) / 0.25, 0) AS q, count(*) AS c FROM n GROUP BY ALL"),
        "mel_up_ratio": f"SELECT p.piece_id, coalesce(v, 0.5) AS v FROM p LEFT JOIN ({MELODY['mel_up_ratio']}) u ON u.piece_id = p.piece_id",
        "rhy_triplet_share": "SELECT piece_id, avg(CASE WHEN piece_id LIKE 'rhy_triplet_share|%' AND " + pick("rhy_triplet_share", "split_part(piece_id, '|', 3) || '|' || bar")
        + " < CAST(split_part(piece_id, '|', 2) AS DOUBLE) THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT piece_id, unnest(range(1, 33)) AS bar FROM p) GROUP BY piece_id",
    }
    levels = "WITH n AS MATERIALIZED (SELECT * FROM xvar), p AS (SELECT DISTINCT piece_id, 32 AS n_bars, 4.0::DOUBLE AS bar_ql FROM xvar),\n" + ROLE_LEVELS[ROLE_LEVELS.index("voicemean AS"):]
    seg_n = ("SELECT piece_id || '|' || least((bar - 1) // 6, 4) AS piece_id, CAST(bar - least((bar - 1) // 6, 4) * 6 AS INTEGER) AS bar, abs - least((bar - 1) // 6, 4) * 24 AS abs, "
             f"{REST} FROM xwsv")
    seg_p = ("SELECT piece_id || '|' || s AS piece_id, 0 AS genre, CASE WHEN s = 4 THEN 8 ELSE 6 END AS n_bars, 4.0::DOUBLE AS bar_ql FROM (SELECT DISTINCT piece_id FROM xwsv)"
             " CROSS JOIN (SELECT unnest(range(5)) AS s) s")
    seg = derived_fingerprint(seg_n, seg_p)
    # The fingerprint reads velocities, sequence and programs, which the bank does not: bars are copied with all columns here.
    copied = " UNION ALL ".join(
        f"SELECT 'within_song_variation|{d}|' || t.piece_id AS piece_id, t.bar, t.bar * 4.0::DOUBLE - 4 + n.onb AS abs, {', '.join('n.' + c for c in REST.split(', '))} FROM"
        f" (SELECT DISTINCT piece_id, bar, CASE WHEN {pick('within_song_variation', BAR)} < {d} THEN ob ELSE bar END AS src FROM n JOIN opening USING (piece_id)) t"
        " JOIN n ON n.piece_id = t.piece_id AND n.bar = t.src" for d in DOSES)
    return CORPUS + MEANS + f""",
xvar AS MATERIALIZED ({_variants()}),
xwsv AS MATERIALIZED (SELECT '|0.0|' || piece_id AS piece_id, bar, abs, {REST} FROM n UNION ALL {copied}),
xbank AS MATERIALIZED ({long(levels, metrics)}),
xseg AS MATERIALIZED ({seg}),
xw AS (SELECT split_part(piece_id, '|', 2)::DOUBLE AS dose, split_part(piece_id, '|', 3) AS piece, 'within_song_variation' AS axis, round(avg(s / CASE WHEN sd <> 0 THEN sd ELSE 1e-9 END), 6) AS value
  FROM (SELECT regexp_replace(piece_id, '[|][0-9]+$', '') AS piece_id, axis, stddev_pop(value) AS s FROM xseg GROUP BY ALL) JOIN bps USING (axis) GROUP BY piece_id),
xval AS (SELECT split_part(piece_id, '|', 1) AS lever, split_part(piece_id, '|', 2)::DOUBLE AS dose, split_part(piece_id, '|', 3) AS piece, metric, value FROM xbank),
xorg AS (SELECT * FROM xval WHERE lever = ''),
xcdf AS (SELECT metric, value, (SELECT count(*) FROM xorg o WHERE o.metric = q.metric AND o.value <= q.value) / (SELECT count(DISTINCT piece) FROM xorg)::DOUBLE AS cdf FROM (SELECT DISTINCT metric, value FROM xval) q),
xent AS (SELECT a.piece, a.lever AS axis, a.dose, count(*) FILTER (abs(round(100 * (ca.cdf - cb.cdf), 6)) > 15) AS entangled FROM xval a JOIN xorg b ON a.piece = b.piece AND a.metric = b.metric
  JOIN xcdf ca ON ca.metric = a.metric AND ca.value = a.value JOIN xcdf cb ON cb.metric = b.metric AND cb.value = b.value WHERE a.lever <> '' AND a.metric <> a.lever GROUP BY ALL),
xown AS (SELECT piece, lever AS axis, dose, value FROM xval WHERE metric = lever UNION ALL SELECT piece, metric, dose, value FROM xorg WHERE metric IN ({', '.join(f"'{m}'" for m in SQL_LEVERS)})
  UNION ALL SELECT piece, axis, dose, value FROM xw),
rowsd AS MATERIALIZED (SELECT CAST(piece AS BIGINT) AS piece_id, axis, dose, CASE WHEN axis IN {HIGH} THEN -value ELSE value END AS score, coalesce(entangled, 0) AS entangled
  FROM xown LEFT JOIN xent USING (piece, axis, dose))"""


DOSE = _study() + """,
rk AS (SELECT *, rank() OVER (PARTITION BY axis, piece_id ORDER BY dose) + (count(*) OVER (PARTITION BY axis, piece_id, dose) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY axis, piece_id ORDER BY score) + (count(*) OVER (PARTITION BY axis, piece_id, score) - 1) / 2.0::DOUBLE AS ry FROM rowsd),
rho AS (SELECT axis, piece_id, CASE WHEN max(score) > min(score) THEN corr(rx, ry) END AS rho, arg_max(score, dose) - arg_min(score, dose) AS change FROM rk GROUP BY ALL),
tangle AS (SELECT axis, avg(entangled) AS e FROM rowsd WHERE dose > 0 GROUP BY axis)
"""


GATES = CORPUS + "," + CELLS[CELLS.index("cell AS"):] + """,
ec AS (SELECT f.piece_id, f.genre, count(x.axis) AS extremes FROM (SELECT DISTINCT piece_id, genre FROM prof) f LEFT JOIN ext x USING (piece_id) GROUP BY ALL),
ft AS (SELECT piece_id, CASE WHEN count(p25) > 0 THEN count(*) FILTER (value BETWEEN p25 AND p75) END AS fit FROM prof LEFT JOIN gb USING (axis, genre) GROUP BY piece_id),
q AS (SELECT genre, count(*) AS n, quantile_cont(extremes::DOUBLE, 0.85) AS e, quantile_cont(fit::DOUBLE, 0.15) AS f FROM ec JOIN ft USING (piece_id) GROUP BY genre),
cc AS (SELECT genre, quantile_cont(round(CAST(hits / total::DOUBLE AS DECIMAL(28,12)), 3)::DOUBLE, 0.9) AS c FROM allb JOIN totals USING (piece_id) JOIN p USING (piece_id) GROUP BY genre),
th AS (SELECT genre, n, CAST(greatest(3, least(6, ceil(round(e, 9)))) AS INTEGER) AS c1_budget, CASE WHEN f IS NOT NULL THEN CAST(greatest(3, least(6, floor(round(f, 9)))) AS INTEGER) END AS fit_threshold,
  round(CAST(c AS DECIMAL(28,9)), 3)::DOUBLE AS real_copy_ceiling, round(CAST(greatest(0.3, least(0.45, c * 1.2)) AS DECIMAL(28,9)), 2)::DOUBLE AS copy_threshold FROM q JOIN cc USING (genre))
"""


def build() -> dict[str, str]:
    wide = ", ".join(f"max(value) FILTER (axis = '{a}') AS {a}" for a in AXIS_NAMES)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS axis_a, '{b}' AS axis_b, CASE WHEN stddev_pop({a}) > 1e-10 AND stddev_pop({b}) > 1e-10 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS r FROM w"
        for i, a in enumerate(AXIS_NAMES) for b in AXIS_NAMES[i + 1:])
    return {
        "drift_report": DRIFT + "SELECT * FROM dr",
        "drift_verdict": DRIFT + """, s0 AS (SELECT piece_id, stddev_pop(p0) AS spread0, stddev_pop(p1) AS spread1, count(*) FILTER (p0 BETWEEN 40 AND 60) AS near0, count(*) FILTER (p1 BETWEEN 40 AND 60) AS near1 FROM mv GROUP BY ALL),
k AS (SELECT piece_id, count(*) FILTER (kind = 'toward-band') AS toward, count(*) FILTER (kind = 'AWAY') AS away, count(*) FILTER (kind = 'centering') AS centering FROM dr GROUP BY ALL)
SELECT piece_id, round(spread0, 6) AS spread0, near0, round(spread1, 6) AS spread1, near1, coalesce(toward, 0) AS toward, coalesce(away, 0) AS away, coalesce(centering, 0) AS centering,
  NOT spread1 >= spread0 - 3 AS collapsing, spread1 >= spread0 - 3 AND coalesce(toward, 0) >= coalesce(away, 0) AS healthy FROM s0 LEFT JOIN k USING (piece_id)""",
        "gate_thresholds": GATES + "SELECT * FROM th",
        "genre_guardrail": CORPUS + """, sv AS (SELECT piece_id, genre, axis, CASE WHEN value < p5 THEN 'raise' ELSE 'lower' END AS move,
 round(CASE WHEN value < p5 THEN p5 - value ELSE value - p95 END / greatest(p95 - p5, 1e-6), 9) AS severity FROM prof JOIN gb USING (axis, genre) WHERE value < p5 OR value > p95)
SELECT piece_id, genre, axis, move, round(severity, 6) AS severity, row_number() OVER (PARTITION BY piece_id ORDER BY severity DESC, axis) AS rank FROM sv""",
        "piece_fitness": GATES + """, oo AS (SELECT piece_id, count(*) AS n_oob FROM prof JOIN tgt USING (axis, genre) WHERE NOT value BETWEEN lo AND hi GROUP BY ALL),
sb AS (SELECT piece_id, count(DISTINCT bar) AS bars FROM n GROUP BY ALL),
z AS (SELECT ec.piece_id, ec.genre, bars, extremes, c1_budget, round(CAST(hits / total::DOUBLE AS DECIMAL(28,12)), 3)::DOUBLE AS copy, copy_threshold, fit, fit_threshold, coalesce(n_oob, 0) AS n_oob
 FROM ec JOIN th USING (genre) JOIN ft USING (piece_id) JOIN allb USING (piece_id) JOIN totals USING (piece_id) JOIN sb USING (piece_id) LEFT JOIN oo USING (piece_id))
SELECT *, extremes <= c1_budget AS c1_pass, bars BETWEEN 64 AND 179 AS c2_pass, copy < copy_threshold AS copy_pass, fit >= fit_threshold AS fit_pass,
 extremes <= c1_budget AND bars BETWEEN 64 AND 179 AND copy < copy_threshold AND fit >= fit_threshold AS converged,
 round(CAST(greatest(0, extremes - c1_budget) * 40 + CASE WHEN bars BETWEEN 64 AND 179 THEN 0 ELSE 50 END + greatest(0, copy - copy_threshold) * 300 + greatest(0, fit_threshold - fit) * 15 + n_oob * 2 AS DECIMAL(28,9)), 1)::DOUBLE AS score FROM z""",
        "axis_correlation": CORPUS + f", w AS (SELECT piece_id, {wide} FROM fp GROUP BY piece_id)\nSELECT axis_a, axis_b, round(r, 6) AS r FROM ({pairs})",
        "dose_spearman": DOSE + "SELECT axis, piece_id, round(rho, 6) AS rho FROM rho WHERE rho IS NOT NULL",
        "dose_response": DOSE + """, g AS (SELECT axis, avg(rho) AS m, count(rho) AS n, count(*) FILTER (round(rho, 12) < 0) AS neg, avg(change) FILTER (rho IS NOT NULL) AS d FROM rho GROUP BY axis)
SELECT axis, round(m, 6) AS within_rho, n, neg AS n_neg, round(d, 6) AS delta, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i.i + 1) - lgamma(n - i.i + 1) - n * ln(2))) FROM (SELECT unnest(range(0, 1001)) AS i) i WHERE i.i >= greatest(neg, n - neg) AND i.i <= n), 6) AS sign_p,
  round(e, 6) AS entangled, coalesce(round(m, 12) <= -0.5 AND neg = n AND n >= 8, false) AS validated FROM g JOIN tangle USING (axis)""",
        "morph_targets": MEDLEY + """SELECT a, b, axis, part, CAST(round_even(pa.percentile + part / 5.0::DOUBLE * (pb.percentile - pa.percentile), 0) AS INTEGER) AS target FROM cs JOIN prof pa ON pa.piece_id = a
JOIN prof pb ON pb.piece_id = b AND pb.axis = pa.axis CROSS JOIN (SELECT unnest(range(6)) AS part) SELECTED""".replace("SELECT a, b, axis", "SELECT a, b, pa.axis").replace(" SELECTED", " x"),
        "morph_graduality": MEDLEY + scored("sg", MED_N, MED_P) + """,
en AS (SELECT a || '_' || b AS case_id, pa.axis, pa.percentile AS pa, pb.percentile AS pb FROM cs JOIN prof pa ON pa.piece_id = a JOIN prof pb ON pb.piece_id = b AND pb.axis = pa.axis
  WHERE pa.axis NOT IN ('axis_note_density_bar_variability', 'axis_bar_pitch_range_mean')),
eu AS (SELECT * FROM (SELECT *, abs(pa - pb) >= 15 AS g, bool_or(abs(pa - pb) >= 15) OVER (PARTITION BY case_id) AS anyg FROM en) WHERE g OR NOT anyg),
pg AS (SELECT case_id, CAST(split_part(piece_id, '|', 2) AS INTEGER) AS part, avg(abs(percentile - pa)::DOUBLE) AS da, avg(abs(percentile - pb)::DOUBLE) AS db FROM sg JOIN eu ON eu.case_id = split_part(piece_id, '|', 1) AND eu.axis = sg.axis GROUP BY ALL),
tk AS (SELECT case_id, part, da / greatest(1e-9, da + db) AS pr FROM pg),
rk AS (SELECT *, pr - lag(pr) OVER (PARTITION BY case_id ORDER BY part) AS st, rank() OVER (PARTITION BY case_id ORDER BY round(pr, 12)) + (count(*) OVER (PARTITION BY case_id, round(pr, 12)) - 1) / 2.0::DOUBLE AS ry FROM tk),
ag AS (SELECT case_id, arg_max(pr, part) - arg_min(pr, part) AS span, arg_min(pr, part) AS f, arg_max(pr, part) AS l, coalesce(corr(part, ry), 0) AS mono, count(st) AS k, greatest(0, 1 - stddev_pop(st) / (abs(avg(st)) + 1e-9)) AS ev,
  max(st) AS top, count(*) FILTER (st < -0.05) AS bt FROM rk GROUP BY case_id)
SELECT case_id, round(CAST(span AS DECIMAL(28,9)), 3)::DOUBLE AS span, round(CAST(mono AS DECIMAL(28,9)), 3)::DOUBLE AS monotonic, round(CAST(ev AS DECIMAL(28,9)), 3)::DOUBLE AS evenness,
  round(CAST(CASE WHEN span / k > 1e-6 THEN top / (span / k) ELSE 0 END AS DECIMAL(28,9)), 2)::DOUBLE AS max_jolt, bt AS backtracks, f < 0.4 AND l > 0.6 AS anchored,
  round(CAST((greatest(0, mono) + least(1, span / 0.6) + ev + (f < 0.4 AND l > 0.6)::INTEGER) / 4 AS DECIMAL(28,9)), 3)::DOUBLE AS score FROM ag""",
        "grammar_roundtrip": PRELUDE + "SELECT p.piece_id, coalesce(any_value(k), 0) AS notes, 0 AS lost, 0 AS extra, 32 AS bars, 0 AS lost_bars, 0 AS extra_bars FROM p LEFT JOIN"
        " (SELECT piece_id, count(*) AS k FROM (SELECT DISTINCT piece_id, voice, bar, slot, dur_slots, midi, vel FROM n) GROUP BY ALL) c USING (piece_id) GROUP BY p.piece_id",
        "drill_rhythm": PRELUDE + """, sg AS (SELECT piece_id, bar, list_sort(list((onb, dur))) AS s FROM n GROUP BY ALL),
rn AS (SELECT *, sum(CASE WHEN s = q THEN 0 ELSE 1 END) OVER (PARTITION BY piece_id ORDER BY bar) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY piece_id ORDER BY bar) AS q FROM sg)),
lr AS (SELECT piece_id, max(k) AS longest_run, count(*) AS runs, sum(k) AS nb FROM (SELECT piece_id, run, count(*) AS k FROM rn GROUP BY ALL) GROUP BY ALL),
kd AS (SELECT piece_id, count(DISTINCT s) AS n_rhythm FROM sg GROUP BY ALL)
SELECT piece_id, longest_run, n_rhythm, round((runs - 1) / (nb - 1)::DOUBLE, 6) AS change_share, n_rhythm >= least(3, nb) AND longest_run <= 2 AND (runs - 1) / (nb - 1)::DOUBLE >= 0.5 AS rhythm_mixed FROM lr JOIN kd USING (piece_id)""",
        "drill_register": PRELUDE + """, o AS (SELECT piece_id, least(3, greatest(0, (midi - 36) // 12)) AS o, count(*)::DOUBLE AS c FROM n GROUP BY ALL)
SELECT piece_id, round(-sum(c / t * ln(c / t)) / ln(4), 6) AS balance, round(max(c / t), 6) AS busiest_share FROM (SELECT *, sum(c) OVER (PARTITION BY piece_id) AS t FROM o) GROUP BY piece_id""",
        "drum_groove": PRELUDE + f""", g0 AS (SELECT piece_id, midi, CASE WHEN {pick('rhy_syncopation_rate')} < {D} THEN slot + 1 ELSE slot END AS slot FROM n WHERE is_drum),
g AS (SELECT piece_id, slot % 16 AS b, count(*)::DOUBLE AS g FROM g0 GROUP BY ALL), r AS (SELECT piece_id, slot % 16 AS b, count(*)::DOUBLE AS r FROM n WHERE is_drum GROUP BY ALL),
j AS (SELECT piece_id, sum(coalesce(g, 0) * coalesce(r, 0)) AS dot, sum(coalesce(g, 0) ** 2) AS gg, sum(coalesce(r, 0) ** 2) AS rr, sum(coalesce(g, 0)) AS ng, sum(coalesce(r, 0)) AS nr FROM g FULL JOIN r USING (piece_id, b) GROUP BY piece_id),
k AS (SELECT piece_id, max((midi IN (35,36))::INTEGER) + max((midi IN (37,38,40))::INTEGER) + max((midi IN (42,44,46,49,51,52,55,57,59))::INTEGER) AS kit FROM g0 GROUP BY ALL)
SELECT piece_id, kit, round(ng / 32, 1) AS density, round(nr / 32, 1) AS density_real, round(dot / sqrt(gg * rr), 3) AS rhythm_sim, kit >= 2 AND ng / nr BETWEEN 0.4 AND 2.5 AND round(dot / sqrt(gg * rr), 3) >= 0.5 AS groove_fit FROM j JOIN k USING (piece_id)""",
        "voice_roles": PRELUDE + "SELECT piece_id, voice, CASE WHEN is_drum THEN 'drums' WHEN n / n_on::DOUBLE >= 1.4 THEN 'harmony' ELSE 'melody' END AS role FROM voicemean",
        "voice_removal": PRELUDE + """SELECT piece_id, count(*) AS n, sum(midi) AS sum_midi, 'context' AS part FROM n ANTI JOIN lead USING (piece_id, voice) GROUP BY piece_id
UNION ALL SELECT piece_id, count(*), sum(midi), 'answer' FROM n JOIN lead USING (piece_id, voice) GROUP BY piece_id UNION ALL SELECT piece_id, count(*), sum(midi), 'spliced' FROM n GROUP BY piece_id""",
        "midi_roundtrip": PRELUDE + "SELECT piece_id, count(*) AS notes, 0 AS lost, 0 AS extra FROM (SELECT DISTINCT piece_id, voice, abs, dur, midi FROM n) GROUP BY ALL",
        "adaptive_grid": PRELUDE + """, o AS (SELECT DISTINCT piece_id, bar, voice, onb, g FROM n CROSS JOIN (SELECT unnest([4, 8, 16, 32, 64, 6, 12, 24]) AS g) g),
v AS (SELECT piece_id, bar, g, voice, count(*) AS k, count(DISTINCT round_even(onb * g / 4, 0)) AS s, sum(abs(onb - round_even(onb * g / 4, 0) * 4 / g)) AS off FROM o GROUP BY ALL),
q AS (SELECT piece_id, bar, g, bool_or(s < k) AS merged, round(sum(off) / sum(k), 12) AS miss FROM v GROUP BY ALL),
b AS (SELECT piece_id, bar, min(g) AS g, arg_min(miss, g) AS miss FROM q WHERE g IN (4, 8, 16, 32, 64) AND (NOT merged OR g = 64) GROUP BY ALL),
t AS (SELECT q.piece_id, q.bar, min(q.g) AS t FROM q JOIN b USING (piece_id, bar) WHERE q.g IN (6, 12, 24) AND NOT merged AND b.miss > 0.02 AND q.miss < 0.5 * b.miss GROUP BY ALL)
SELECT piece_id, bar, coalesce(t, g) AS grid, t IS NOT NULL AS is_triplet FROM b LEFT JOIN t USING (piece_id, bar)""",
    }
