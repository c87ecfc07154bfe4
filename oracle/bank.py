"""SQL twins for the legacy bank and the candidate metrics."""

from __future__ import annotations

from oracle.base import MAJOR, PRELUDE


def even(inner: str) -> str:
    """Normalized entropy of (piece_id, c) rows."""
    return (
        "SELECT piece_id, CASE WHEN count(*) > 1 THEN -sum(c / t * log2(c / t)) / log2(count(*)) ELSE 0 END AS v FROM (SELECT piece_id,"
        f" c::DOUBLE AS c, sum(c) OVER (PARTITION BY piece_id)::DOUBLE AS t FROM ({inner}) WHERE c > 0) GROUP BY piece_id"
    )


ROLES = """,
vs AS (SELECT piece_id, voice, voice_ix, avg(midi::DOUBLE) AS m, count(*) AS n, count(DISTINCT abs) AS n_on, max(midi) - min(midi) AS span FROM n GROUP BY ALL),
rbass AS (SELECT piece_id, voice FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY m, voice_ix) AS r FROM vs) WHERE r = 1),
rmel AS (SELECT piece_id, voice, span FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY (n / n_on::DOUBLE < 1.4 AND n_on >= 8) DESC, m DESC, voice_ix) AS r FROM vs) WHERE r = 1),
mline AS (SELECT piece_id, abs, max(midi) AS top, max(dur) AS dmax FROM n JOIN rmel USING (piece_id, voice) GROUP BY ALL),
mstep AS (SELECT piece_id, abs, d FROM (SELECT *, top - lag(top) OVER (PARTITION BY piece_id ORDER BY abs) AS d FROM mline) WHERE d <> 0),
nbar AS (SELECT piece_id, count(DISTINCT bar) AS nb FROM n GROUP BY ALL),
hw AS (SELECT piece_id, bar, CASE WHEN onb < 2 THEN 0 ELSE 1 END AS half, pc, sum(dur) AS w FROM n GROUP BY ALL),
hp AS (SELECT piece_id, bar, half, list_sort(list(pc)) AS s FROM (SELECT *, max(w) OVER (PARTITION BY piece_id, bar, half) AS mx FROM hw) WHERE w >= 0.3 * mx GROUP BY ALL),
hl AS (SELECT b.piece_id, b.bar, h.half, hp.s, row_number() OVER (PARTITION BY b.piece_id ORDER BY b.bar, h.half) AS k FROM (SELECT DISTINCT piece_id, bar FROM n) b
       CROSS JOIN (SELECT unnest([0, 1]) AS half) h LEFT JOIN hp USING (piece_id, bar, half)),
bp AS (SELECT piece_id, bar, list_sort(list(pc)) AS s FROM (SELECT *, max(w) OVER (PARTITION BY piece_id, bar) AS mx FROM
       (SELECT piece_id, bar, pc, sum(w) AS w FROM hw GROUP BY ALL)) WHERE w >= 0.3 * mx GROUP BY ALL),
br AS (SELECT piece_id, bar, lo, lag(lo) OVER (PARTITION BY piece_id ORDER BY bar) AS prev FROM (SELECT piece_id, bar, min(midi) AS lo FROM n
       JOIN rbass USING (piece_id, voice) GROUP BY ALL)),
tr AS (SELECT piece_id, (lo - prev + 120) % 12 AS t FROM br WHERE prev IS NOT NULL),
tpl AS (SELECT bp.piece_id, bp.bar, r.r, list_has_all(s, [r.r, (r.r+4)%12, (r.r+7)%12, (r.r+10)%12]) AS dom, list_has_all(s, [r.r, (r.r+3)%12, (r.r+6)%12]) AS dim,
        list_has_all(s, [r.r, (r.r+4)%12, (r.r+8)%12]) AS aug, len(s) AS k FROM bp CROSS JOIN (SELECT unnest(range(12))::INTEGER AS r) r),
bset AS (SELECT piece_id, bar, list_sort(list(DISTINCT (voice, onb, midi))) AS s FROM n GROUP BY ALL),
bix AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY bar) - 1 AS ix, count(*) OVER (PARTITION BY piece_id) AS nb FROM bset),
ssm AS MATERIALIZED (SELECT a.piece_id, a.ix AS i, b.ix AS j, a.bar AS b1, b.bar AS b2, a.nb, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS sim
        FROM bix a JOIN bix b ON a.piece_id = b.piece_id),
win AS (SELECT piece_id, bar, [s, lead(s, 1) OVER w, lead(s, 2) OVER w, lead(s, 3) OVER w] AS key, lead(bar, 3) OVER w - bar AS gap FROM bset WINDOW w AS (PARTITION BY piece_id ORDER BY bar)),
nov AS (SELECT c.piece_id, c.ix AS c, c.nb, round(sum(CASE WHEN (i < c.ix) = (j < c.ix) THEN sim ELSE -sim END) / count(*), 9) AS nov FROM bix c JOIN ssm ON ssm.piece_id = c.piece_id
        AND i >= c.ix - least(4, greatest(1, c.nb // 4)) AND i < c.ix + least(4, greatest(1, c.nb // 4)) AND j >= c.ix - least(4, greatest(1, c.nb // 4)) AND j < c.ix + least(4, greatest(1, c.nb // 4)) GROUP BY ALL),
pk AS (SELECT piece_id, sum(CASE WHEN c >= 1 AND c <= nb - 2 AND nov >= round(m + 0.5 * sd, 9) AND nov >= b AND nov >= a THEN 1 ELSE 0 END) AS peaks, max(nb) AS nb FROM
       (SELECT *, avg(nov) OVER (PARTITION BY piece_id) AS m, stddev_pop(nov) OVER (PARTITION BY piece_id) AS sd, lag(nov) OVER (PARTITION BY piece_id ORDER BY c) AS b,
        lead(nov) OVER (PARTITION BY piece_id ORDER BY c) AS a FROM nov) GROUP BY ALL),
vline AS (SELECT piece_id, voice_ix, abs, max(midi) AS top FROM n GROUP BY ALL),
vp AS (SELECT a.piece_id, a.voice_ix AS v1, b.voice_ix AS v2, count(*) AS sh, sum(CASE WHEN abs(a.top - b.top) % 12 = 0 THEN 1 ELSE 0 END) AS same,
       sum(CASE WHEN abs(a.top - b.top) % 12 IN (3,4) THEN 1 ELSE 0 END) AS th, sum(CASE WHEN abs(a.top - b.top) % 12 IN (8,9) THEN 1 ELSE 0 END) AS sx, min(a.abs) AS t0
       FROM vline a JOIN vline b ON a.piece_id = b.piece_id AND a.abs = b.abs AND a.voice_ix < b.voice_ix GROUP BY ALL)
"""
ROLE_LEVELS = PRELUDE + ROLES

RHYTHM = {
    "rhy_syncopation_rate": "SELECT piece_id, avg(CASE WHEN abs - floor(abs) > 1e-6 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM (SELECT DISTINCT piece_id, voice, abs FROM n) GROUP BY ALL",
    "rhy_onset_density_per_bar": "SELECT piece_id, count(DISTINCT (voice, abs)) / count(DISTINCT bar)::DOUBLE AS v FROM n GROUP BY ALL",
    "rhy_triplet_share": "SELECT piece_id, 0.0::DOUBLE AS v FROM p",
    "rhy_onset_pos_entropy": even("SELECT piece_id, onb, count(*) AS c FROM n GROUP BY ALL"),
    "rhy_dur_cv": "SELECT piece_id, stddev_pop(dur) / avg(dur) AS v FROM n GROUP BY ALL",
    "rhy_mean_dur_beats": "SELECT piece_id, avg(dur) AS v FROM n GROUP BY ALL",
    "rhy_density_variability": "SELECT piece_id, stddev_pop(k) / avg(k) AS v FROM (SELECT piece_id, bar, count(*) AS k FROM n GROUP BY ALL) GROUP BY ALL",
    "mel_pitch_range": "SELECT piece_id, (max(midi) - min(midi))::DOUBLE AS v FROM n GROUP BY ALL",
    "tex_mean_simultaneity": "SELECT piece_id, count(*) / count(DISTINCT (voice, abs))::DOUBLE AS v FROM n GROUP BY ALL",
    "tex_max_chord_width": "SELECT piece_id, max(w)::DOUBLE AS v FROM (SELECT piece_id, voice, abs, max(midi) - min(midi) AS w FROM n GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL",
}
HARMONY = {
    "har_chromaticism": f"SELECT piece_id, 1 - max(m) / max(t) AS v FROM (SELECT piece_id, root, sum(CASE WHEN list_contains({MAJOR}, deg) THEN w ELSE 0 END) AS m FROM grid12 GROUP BY ALL) JOIN tot USING (piece_id) GROUP BY ALL",
    "har_distinct_pc": "SELECT piece_id, count(*)::DOUBLE AS v FROM pcw WHERE w > 0 GROUP BY ALL",
    "har_pc_entropy": even("SELECT piece_id, w AS c FROM pcw"),
    "har_chord_change_rate": "SELECT piece_id, sum(CASE WHEN s IS NOT NULL AND q IS NOT NULL AND s <> q THEN 1 ELSE 0 END) / greatest(1, count(*) - 1)::DOUBLE AS v FROM"
    " (SELECT piece_id, s, lag(s) OVER (PARTITION BY piece_id ORDER BY k) AS q FROM hl) GROUP BY ALL",
    "har_vocab_density": "SELECT piece_id, count(DISTINCT s) / max(nb)::DOUBLE AS v FROM hp JOIN nbar USING (piece_id) GROUP BY ALL",
    "har_root_motion_entropy": even("SELECT piece_id, t, count(*) AS c FROM tr GROUP BY ALL"),
    "har_fourth_motion_rate": "SELECT piece_id, avg(CASE WHEN t = 5 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM tr GROUP BY ALL",
    "har_dom7_rate": "SELECT piece_id, count(DISTINCT CASE WHEN dom THEN bar END) / max(nb)::DOUBLE AS v FROM tpl JOIN nbar USING (piece_id) GROUP BY ALL",
    "har_dimaug_rate": "SELECT piece_id, (count(DISTINCT CASE WHEN dim THEN bar END) + least(count(*) FILTER (aug), max(nb))) / max(nb)::DOUBLE AS v FROM tpl JOIN nbar USING (piece_id) GROUP BY ALL",
    "har_has_dom7_ANY": "SELECT piece_id, max(dom::INTEGER)::DOUBLE AS v FROM tpl GROUP BY ALL",
    "har_has_dim_ANY": "SELECT piece_id, max(dim::INTEGER)::DOUBLE AS v FROM tpl GROUP BY ALL",
}
MELODY = {
    "mel_step_ratio": "SELECT piece_id, avg(CASE WHEN abs(d) <= 2 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM mstep GROUP BY ALL",
    "mel_mean_abs_interval": "SELECT piece_id, avg(abs(d)::DOUBLE) AS v FROM mstep GROUP BY ALL",
    "mel_interval_entropy": even("SELECT piece_id, least(abs(d), 12) AS k, count(*) AS c FROM mstep GROUP BY ALL"),
    "mel_up_ratio": "SELECT piece_id, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM mstep GROUP BY ALL",
    "mel_voice_range": "SELECT piece_id, span::DOUBLE AS v FROM rmel",
}
TEXTURE = {
    "tex_voice_count": "SELECT piece_id, count(*)::DOUBLE AS v FROM vs GROUP BY ALL",
    "tex_active_voice_density": "SELECT piece_id, avg(k::DOUBLE) AS v FROM (SELECT piece_id, bar, count(DISTINCT voice) AS k FROM n GROUP BY ALL) GROUP BY ALL",
    "tex_doubling_ratio": "SELECT piece_id, avg(CASE WHEN same / sh::DOUBLE >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM vp WHERE sh >= 12 GROUP BY ALL",
}
FORM = {
    "form_self_similarity": "SELECT piece_id, avg(sim) AS v FROM ssm WHERE i < j GROUP BY ALL",
    "form_novelty_rate": "SELECT piece_id, avg(1 - sim) AS v FROM ssm WHERE j = i + 1 GROUP BY ALL",
    "form_distinct_bar_frac": "SELECT piece_id, count(DISTINCT s) / count(*)::DOUBLE AS v FROM bset GROUP BY ALL",
    "form_reprise_frac": "SELECT piece_id, (count(*) - count(DISTINCT key)) / count(*)::DOUBLE AS v FROM win WHERE gap = 3 GROUP BY ALL",
    "form_section_per100bars": "SELECT piece_id, (peaks + 1) / nb * 100::DOUBLE AS v FROM pk",
}
CAND = {
    "dyn_vel_mean": "SELECT piece_id, avg(vel) / 127 AS v FROM n GROUP BY ALL",
    "dyn_vel_cv": "SELECT piece_id, stddev_pop(vel) / avg(vel) AS v FROM n GROUP BY ALL",
    "dyn_vel_range": "SELECT piece_id, (max(vel) - min(vel)) / 127.0::DOUBLE AS v FROM n GROUP BY ALL",
    "dyn_accent_rate": "SELECT piece_id, avg(CASE WHEN vel > m + sd THEN 1.0::DOUBLE ELSE 0 END) AS v FROM n JOIN (SELECT piece_id, avg(vel) AS m, stddev_pop(vel) AS sd FROM n GROUP BY ALL) USING (piece_id) GROUP BY ALL",
    "perc_present": "SELECT piece_id, count(DISTINCT bar) / 32.0::DOUBLE AS v FROM n WHERE is_drum GROUP BY ALL",
    "perc_density": "SELECT piece_id, count(*) / 32.0::DOUBLE AS v FROM n WHERE is_drum GROUP BY ALL",
    "perc_pos_entropy": even("SELECT piece_id, round_even(onb, 0) AS q, count(*) AS c FROM n WHERE is_drum GROUP BY ALL"),
    "perc_backbeat": "SELECT piece_id, avg(CASE WHEN round_even(onb, 0) IN (1, 3) THEN 1.0::DOUBLE ELSE 0 END) AS v FROM n WHERE is_drum GROUP BY ALL",
    "inst_n_programs": "SELECT piece_id, count(DISTINCT program) / 16.0::DOUBLE AS v FROM n WHERE program IS NOT NULL GROUP BY ALL",
    "inst_program_entropy": even("SELECT piece_id, program, count(*) AS c FROM n WHERE program IS NOT NULL GROUP BY ALL"),
    "inst_family_spread": "SELECT piece_id, count(DISTINCT program // 8) / 16.0::DOUBLE AS v FROM n WHERE program IS NOT NULL GROUP BY ALL",
    "inst_pitched_voices": "SELECT piece_id, least(count(DISTINCT voice), 16) / 16.0::DOUBLE AS v FROM n WHERE program IS NOT NULL GROUP BY ALL",
}


def long(prelude: str, metrics: dict[str, str]) -> str:
    body = " UNION ALL ".join(f"SELECT p.piece_id, '{m}' AS metric, round(coalesce(v, 0), 6) AS value FROM p LEFT JOIN ({q}) a ON a.piece_id = p.piece_id" for m, q in metrics.items())
    return f"{prelude}\n{body}"


def build() -> dict[str, str]:
    parts = {"rhythm": RHYTHM, "harmony": HARMONY, "melody": MELODY, "texture": TEXTURE, "form": FORM}
    out = {f"bank_{k}": long(ROLE_LEVELS, v) for k, v in parts.items()}
    out["bank_candidates"] = long(PRELUDE, CAND)
    out["bar_similarity"] = ROLE_LEVELS + "SELECT piece_id, b1, b2, round(sim, 6) AS sim FROM ssm WHERE i < j AND sim > 0"
    return out
