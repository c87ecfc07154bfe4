"""SQL twins for facts, edits, verification and dose-response."""

from __future__ import annotations

from oracle.bank import ROLE_LEVELS
from oracle.base import PRELUDE

H = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def pick(salt: str, keys: str = "piece_id || '|' || bar || '|' || voice || '|' || slot || '|' || dur_slots") -> str:
    return "(" + H.format(f"'{salt}|' || {keys}") + ")"


BAR = "piece_id || '|' || bar"
TK = "piece_id, bar, voice, voice_ix, slot, dur_slots"
D = 0.5

KEY = """,
hist AS (SELECT piece_id, pc, count(*) AS c FROM n GROUP BY ALL),
keyscore AS (SELECT piece_id, t.t AS tonic, m.mode, sum(CASE WHEN list_contains(m.sc, (pc - t.t + 12) % 12) THEN c ELSE 0 END) AS s, sum(c) AS tot FROM hist
   CROSS JOIN (SELECT unnest(range(12)) AS t) t CROSS JOIN (SELECT 'major' AS mode, [0,2,4,5,7,9,11] AS sc UNION ALL SELECT 'minor', [0,2,3,5,7,8,10]) m GROUP BY ALL),
key AS (SELECT piece_id, tonic, mode, 1 - s / tot::DOUBLE AS outside FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY s DESC, tonic, mode) AS r FROM keyscore) WHERE r = 1),
ink AS (SELECT piece_id, (tonic + i.i) % 12 AS pc FROM key CROSS JOIN (SELECT unnest(range(12)) AS i) i WHERE CASE WHEN mode = 'major' THEN i.i IN (0,2,4,5,7,9,11) ELSE i.i IN (0,2,3,5,7,8,10) END),
kset AS (SELECT piece_id, list(pc) AS ks FROM ink GROUP BY ALL)
"""
NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"

ROWS = "piece_id, voice, bar::INTEGER AS bar, slot::INTEGER AS slot, dur_slots::INTEGER AS dur_slots, midi::INTEGER AS midi, grid::INTEGER AS grid"

MEANS = """,
vm AS (SELECT piece_id, voice, voice_ix, avg(midi::DOUBLE) AS m FROM n GROUP BY ALL),
hiv AS (SELECT piece_id, voice, m FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY m DESC, voice_ix) AS r FROM vm) WHERE r = 1),
lov AS (SELECT piece_id, voice FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY m, voice_ix) AS r FROM vm) WHERE r = 1),
bmode AS (SELECT piece_id, midi AS mode FROM (SELECT piece_id, midi, row_number() OVER (PARTITION BY piece_id ORDER BY count(*) DESC, midi) AS r FROM n JOIN lov USING (piece_id, voice) GROUP BY piece_id, midi) WHERE r = 1),
durm AS (SELECT piece_id, greatest(1, round_even(avg(dur_slots), 0)) AS dm FROM (SELECT DISTINCT piece_id, bar, voice, slot, dur_slots FROM n) GROUP BY ALL),
opening AS (SELECT piece_id, min(bar) AS ob FROM n GROUP BY ALL),
firsttok AS (SELECT piece_id, bar, voice, min(slot * 100 + dur_slots) AS ft FROM n GROUP BY ALL),
firstvoice AS (SELECT piece_id, bar, min(voice_ix) AS fv FROM n GROUP BY ALL),
firstall AS (SELECT piece_id, bar, min(voice_ix * 10000 + slot * 100 + dur_slots) AS fa FROM n GROUP BY ALL)
"""


def _set(**kw: str) -> str:
    cols = {"bar": "bar", "slot": "slot", "dur_slots": "dur_slots", "midi": "midi", "grid": "16"}
    cols.update(kw)
    return "SELECT piece_id, n.voice, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM n"


def _when(cond: str, new: str, old: str) -> str:
    return f"CASE WHEN {cond} THEN {new} ELSE {old} END"


def _template(salt: str, d: float) -> str:
    return (f"SELECT t.piece_id, n.voice, t.bar, n.slot, n.dur_slots, n.midi, 16 AS grid FROM (SELECT DISTINCT piece_id, bar, {_when(pick(salt, BAR) + f' < {d}', 'ob', 'bar')} AS src"
            " FROM n JOIN opening USING (piece_id)) t JOIN n ON n.piece_id = t.piece_id AND n.bar = t.src")


def _walk(metric: str, rule: str, d: float) -> str:
    """The highest line folded in order: {b} is the edited pitch before, {o} the token's own."""
    step = rule.format(b="done[-1]", o="t.own")
    return (f"WITH tk AS (SELECT piece_id, bar, voice, slot, dur_slots, min(midi) AS own, {pick(metric)} < {d} AS hit FROM n JOIN hiv USING (piece_id, voice) GROUP BY ALL),"
            " ln AS (SELECT piece_id, list({'bar': bar, 'voice': voice, 'slot': slot, 'dur_slots': dur_slots, 'own': own, 'hit': hit} ORDER BY bar, slot, dur_slots) AS ts FROM tk GROUP BY ALL),"
            f" fd AS (SELECT piece_id, ts, list_reduce(ts[2:], lambda done, t: list_append(done, CASE WHEN t.hit THEN {step} ELSE t.own END), [ts[1].own]) AS ps FROM ln),"
            " mv AS (SELECT piece_id, unnest(ts[2:]) AS t, unnest(ps[2:]) AS p FROM fd), ed AS (SELECT piece_id, t.bar AS bar, t.voice AS voice, t.slot AS slot, t.dur_slots AS dur_slots, p FROM mv WHERE t.hit)"
            " SELECT piece_id, voice, bar, slot, dur_slots, midi, 16 AS grid FROM n ANTI JOIN ed USING (piece_id, bar, voice, slot, dur_slots)"
            " UNION ALL SELECT piece_id, voice, bar, slot, dur_slots, greatest(0, least(127, p)), 16 FROM ed")


SNAP = "(midi - midi % 12 + CASE WHEN midi % 12 IN (11, 0, 1, 2) THEN 0 WHEN midi % 12 IN (3, 4, 5) THEN 4 ELSE CASE WHEN midi % 12 = 10 THEN 0 ELSE 7 END END)"

def lever_sql(d: float) -> dict[str, str]:
    """Every lever at dose d, as a SELECT over n and MEANS."""
    wide, far = round(12 * d), 12 + round(24 * d)
    return {
        "rhy_syncopation_rate": _set(slot=_when(f"{pick('rhy_syncopation_rate')} < {d}", "slot + 1", "slot")),
        "rhy_onset_density_per_bar": f"SELECT piece_id, voice, bar, slot, dur_slots, midi, 16 AS grid FROM (SELECT *, {pick('rhy_onset_density_per_bar')} >= {d} AS keep FROM n) JOIN firsttok USING (piece_id, bar, voice)"
        f" JOIN (SELECT piece_id, bar, voice, bool_or({pick('rhy_onset_density_per_bar')} >= {d}) AS sm FROM n GROUP BY ALL) USING (piece_id, bar, voice) WHERE keep OR (NOT sm AND slot * 100 + dur_slots = ft)",
        "rhy_triplet_share": _set(grid=_when(f"{pick('rhy_triplet_share', BAR)} < {d}", "12", "16")),
        "rhy_onset_pos_entropy": _set(slot=_when(f"{pick('rhy_onset_pos_entropy')} < {d}", "1", "slot")),
        "rhy_dur_cv": _set(dur_slots=_when(f"{pick('rhy_dur_cv')} < {d}", "dm", "dur_slots")) + " JOIN durm USING (piece_id)",
        "rhy_mean_dur_beats": _set(dur_slots=f"greatest(1, round_even(dur_slots * {1 + 3 * d}::DOUBLE, 0))"),
        "rhy_density_variability": _set() + f" JOIN firsttok USING (piece_id, bar, voice) JOIN opening USING (piece_id) WHERE NOT ({pick('rhy_density_variability', BAR)} < {d / 2} AND bar > ob) OR slot * 100 + dur_slots = ft",
        "har_chromaticism": _set(midi=_when(f"{pick('har_chromaticism')} < {d / 2}", "least(127, midi + 1)", "midi")),
        "har_distinct_pc": _set(midi=_when(f"{pick('har_distinct_pc')} < {d}", SNAP, "midi")),
        "har_pc_entropy": _set(midi=_when(f"{pick('har_pc_entropy')} < {d}", "midi - midi % 12", "midi")),
        "har_root_motion_entropy": _set(midi=_when(f"lov.voice IS NOT NULL AND {pick('har_root_motion_entropy', 'piece_id || chr(124) || bar || chr(124) || voice || chr(124) || slot || chr(124) || dur_slots')} < {d}", "mode", "midi"))
        + " LEFT JOIN lov USING (piece_id, voice) LEFT JOIN bmode USING (piece_id)",
        "har_dimaug_rate": f"SELECT piece_id, voice, bar, slot, dur_slots, midi, 16 AS grid FROM n JOIN firstvoice USING (piece_id, bar) WHERE NOT ({pick('har_dimaug_rate', BAR)} < {d} AND voice_ix = fv)"
        f" UNION ALL SELECT piece_id, 'V' || fv, bar, 1, 8, unnest([60, 63, 66]), 16 FROM firstvoice WHERE {pick('har_dimaug_rate', BAR)} < {d}",
        "mel_pitch_range": _set(midi=f"greatest(0, least(127, midi + CASE WHEN h.m IS NOT NULL THEN {wide} WHEN lov.voice IS NOT NULL THEN -{wide} ELSE 0 END))")
        + " LEFT JOIN hiv h USING (piece_id, voice) LEFT JOIN lov USING (piece_id, voice)",
        "mel_voice_range": _set(midi=_when("h.m IS NOT NULL", f"greatest(0, least(127, round_even(h.m + (midi - h.m) * {1 + 3 * d}::DOUBLE, 0)))", "midi")) + " LEFT JOIN hiv h USING (piece_id, voice)",
        "mel_interval_entropy": _walk("mel_interval_entropy", "{b} + 2", d),
        "mel_step_ratio": _walk("mel_step_ratio", "CASE WHEN {o} = {b} THEN {b} + 1 ELSE {b} + greatest(-2, least(2, {o} - {b})) END", d),
        "mel_up_ratio": _walk("mel_up_ratio", "CASE WHEN {o} <= {b} THEN {b} + 2 ELSE {o} END", d),
        "tex_voice_count": _set() + " JOIN (SELECT piece_id, voice FROM (SELECT DISTINCT piece_id, voice, " + pick("tex_voice_count", "piece_id || '|' || voice")
        + f" AS u FROM n) QUALIFY u >= {d} OR u = max(u) OVER (PARTITION BY piece_id)) s USING (piece_id, voice)",
        "tex_mean_simultaneity": _set() + f" UNION ALL SELECT piece_id, voice, bar, slot, dur_slots, least(127, min(midi) + 4), 16 FROM n WHERE {pick('tex_mean_simultaneity')} < {d} GROUP BY {TK}",
        "tex_max_chord_width": _set() + f" UNION ALL SELECT piece_id, voice, bar, slot, dur_slots, least(127, min(midi) + {far}), 16 FROM n JOIN firstall USING (piece_id, bar) WHERE voice_ix * 10000 + slot * 100 + dur_slots = fa GROUP BY {TK}",
        "tex_active_voice_density": _set() + f" JOIN firstvoice USING (piece_id, bar) WHERE NOT {pick('tex_active_voice_density', BAR)} < {d} OR voice_ix = fv",
        "form_self_similarity": _template("form_self_similarity", d),
        "form_distinct_bar_frac": _template("form_distinct_bar_frac", d),
        "within_song_variation": _template("within_song_variation", d),
        "form_novelty_rate": "SELECT t.piece_id, n.voice, t.bar, n.slot, n.dur_slots, n.midi, 16 AS grid FROM (SELECT piece_id, bar, last_value(own IGNORE NULLS) OVER (PARTITION BY piece_id ORDER BY bar) AS src"
        f" FROM (SELECT piece_id, bar, CASE WHEN bar = ob OR NOT {pick('form_novelty_rate', BAR)} < {d} THEN bar END AS own FROM (SELECT DISTINCT piece_id, bar, ob FROM n JOIN opening USING (piece_id)))) t"
        " JOIN n ON n.piece_id = t.piece_id AND n.bar = t.src",
    }


LEVERS = lever_sql(D)
SQL_LEVERS = tuple(LEVERS)

SITES = f""",
tok AS (SELECT {TK}, is_drum, list_sort(list(DISTINCT midi)) AS midis FROM n GROUP BY ALL),
ib AS (SELECT piece_id, bar, {pick('bar0', BAR)} AS draw FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY bar) AS ix, count(*) OVER (PARTITION BY piece_id) AS k
       FROM (SELECT DISTINCT piece_id, bar FROM n)) WHERE ix > 2 AND ix <= k - 2),
it AS (SELECT * FROM tok JOIN ib USING (piece_id, bar)),
tops AS (SELECT piece_id, bar, max(midis[1]) AS top, count(DISTINCT voice) AS lines FROM it WHERE NOT is_drum GROUP BY ALL),
cand AS (SELECT it.*, 'out_of_key' AS kind, [CASE WHEN NOT list_contains(ks, (midis[1] + 1) % 12) THEN midis[1] + 1 ELSE midis[1] - 1 END] AS new FROM it JOIN kset USING (piece_id)
   WHERE len(midis) = 1 AND list_contains(ks, midis[1] % 12) AND NOT (list_contains(ks, (midis[1] + 1) % 12) AND list_contains(ks, (midis[1] + 11) % 12))
 UNION ALL SELECT it.*, 'wrong_bass', list_concat([midis[1] + 6], midis[2:]) FROM it
 UNION ALL SELECT it.*, 'dissonance', list_append(midis, midis[1] + 1) FROM it WHERE len(midis) >= 2 AND NOT list_contains(midis, midis[1] + 1)
 UNION ALL SELECT it.*, 'meter_glitch', [dur_slots + 6] FROM it
 UNION ALL SELECT it.*, 'voice_crossing', [top + 2] FROM it JOIN tops USING (piece_id, bar) WHERE NOT is_drum AND lines >= 2 AND len(midis) = 1 AND midis[1] < top),
site AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, kind ORDER BY draw, bar, voice_ix, slot, dur_slots) AS r FROM cand) WHERE r = 1)
"""

VALUES = "[4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.6666666666666666, 0.5, 0.3333333333333333, 0.25]"
VNAMES = "['whole','dotted half','half','dotted quarter','quarter','dotted eighth','eighth triplet','eighth','eighth triplet','sixteenth']"

TRUTH = ROLE_LEVELS + f""",
vals AS (SELECT piece_id, name, count(*) AS c, min(seq) AS s FROM (SELECT piece_id, seq, {VNAMES}[list_position(list_transform({VALUES}, lambda x: abs(x - dur)), list_min(list_transform({VALUES}, lambda x: abs(x - dur))))] AS name FROM n) GROUP BY ALL),
nv AS (SELECT piece_id, name FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY c DESC, s) AS r FROM vals) WHERE r = 1),
db AS (SELECT piece_id, bar FROM (SELECT piece_id, bar, row_number() OVER (PARTITION BY piece_id ORDER BY count(*) DESC, min(seq)) AS r FROM n GROUP BY piece_id, bar) WHERE r = 1),
truth AS (SELECT n.piece_id, max(midi) AS highest_midi, min(midi) AS lowest_midi, any_value(lead.voice) AS most_active_voice,
  max(CASE WHEN n.voice = lead.voice THEN midi END) - min(CASE WHEN n.voice = lead.voice THEN midi END) AS active_span, max(dur) AS longest_beats, bool_or(dur > 4.000001) AS any_longer_than_bar,
  any_value(db.bar) AS densest_bar, any_value(coalesce(tw.t, false)) AS near_identical_bars, round(any_value(coalesce(tw.m, 0)), 6) AS max_bar_sim, count(DISTINCT pc) AS distinct_pc_count, bit_or(1 << pc) AS present_pcs, 'straight' AS subdivision,
  avg(CASE WHEN onb - floor(onb) > 1e-6 THEN 1.0::DOUBLE ELSE 0 END) >= 0.15 AS syncopation, any_value(nv.name) AS note_value
  FROM n JOIN lead USING (piece_id) JOIN db USING (piece_id) JOIN nv USING (piece_id) LEFT JOIN (SELECT piece_id, max(sim) >= 0.9 AS t, max(sim) AS m FROM ssm WHERE i < j GROUP BY ALL) tw USING (piece_id) GROUP BY n.piece_id)
"""


def _const(fact: str) -> str:
    return f"SELECT '{fact}' AS fact, round(max(c) / sum(c)::DOUBLE, 6) AS accuracy FROM (SELECT {fact}, count(*) AS c FROM truth WHERE {fact} IS NOT NULL GROUP BY ALL)"


def _near(fact: str, tol: float) -> str:
    return (f"SELECT '{fact}' AS fact, round(max(k) / (SELECT count(*) FROM truth)::DOUBLE, 6) AS accuracy FROM (SELECT a.{fact}, count(*) AS k FROM (SELECT DISTINCT {fact} FROM truth) a"
            f" JOIN truth b ON abs(a.{fact} - b.{fact}) <= {tol} GROUP BY ALL)")


CLAMP = "greatest(0, least(1, {}))"
ACC = "[0, 5, 2, 3, 4, 1, 6, 1, 4, 3, 2, 5]"


TRIADS = "SELECT '' AS q, 4 AS a, 7 AS b, 0 AS p UNION ALL SELECT 'm', 3, 7, 1 UNION ALL SELECT 'dim', 3, 6, 2 UNION ALL SELECT 'aug', 4, 8, 3"
CHORDS = PRELUDE + f""",
hw AS (SELECT piece_id, bar, h.h AS h, pc, sum(least(abs + dur, (bar - 1) * 4 + h.h * 2 + 2) - greatest(abs, (bar - 1) * 4 + h.h * 2)) AS w FROM n
  CROSS JOIN (SELECT unnest([0, 1]) AS h) h WHERE NOT is_drum AND least(abs + dur, (bar - 1) * 4 + h.h * 2 + 2) > greatest(abs, (bar - 1) * 4 + h.h * 2) GROUP BY ALL),
g AS (SELECT x.piece_id, x.bar, x.h, list(coalesce(w, 0.0) ORDER BY k.k) AS w FROM (SELECT DISTINCT piece_id, bar, h FROM hw) x CROSS JOIN (SELECT unnest(range(12)) AS k) k
  LEFT JOIN hw ON hw.piece_id = x.piece_id AND hw.bar = x.bar AND hw.h = x.h AND hw.pc = k.k GROUP BY ALL),
o AS (SELECT g.*, r.r, t.q, w[1 + r.r] AS rw, w[1 + (r.r + t.a) % 12] AS wa, w[1 + (r.r + t.b) % 12] AS wb, t.p FROM g CROSS JOIN (SELECT unnest(range(12)) AS r) r CROSS JOIN ({TRIADS}) t),
b AS (SELECT *, CASE WHEN rw > 0 THEN rw ELSE greatest(wa, wb) END AS ref FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, bar, h ORDER BY rw + wa + wb DESC, rw DESC, p, r) AS k FROM o) WHERE k = 1),
l AS (SELECT piece_id, bar, h, {NAMES}[r + 1] || CASE q WHEN '' THEN CASE WHEN ref > 0 AND (w[1 + (r + 10) % 12] >= 0.5 * ref OR w[1 + (r + 11) % 12] >= 0.5 * ref) THEN '7' ELSE '' END
  WHEN 'm' THEN CASE WHEN ref > 0 AND w[1 + (r + 10) % 12] >= 0.5 * ref THEN 'm7' ELSE 'm' END
  WHEN 'dim' THEN CASE WHEN ref > 0 AND w[1 + (r + 9) % 12] >= 0.5 * ref THEN 'dim7' WHEN ref > 0 AND w[1 + (r + 10) % 12] >= 0.5 * ref THEN 'm7' ELSE 'dim' END ELSE 'aug' END AS label FROM b),
two AS (SELECT piece_id, bar, coalesce(max(label) FILTER (h = 0), max(label) FILTER (h = 1)) AS a, coalesce(max(label) FILTER (h = 1), max(label) FILTER (h = 0)) AS b FROM l GROUP BY ALL),
rq AS (SELECT *, CASE WHEN a LIKE '%dim7' THEN left(a, -1) WHEN a LIKE '%m7' THEN left(a, -1) WHEN a LIKE '%7' THEN left(a, -1) ELSE a END AS qa,
  CASE WHEN b LIKE '%dim7' THEN left(b, -1) WHEN b LIKE '%m7' THEN left(b, -1) WHEN b LIKE '%7' THEN left(b, -1) ELSE b END AS qb FROM two)
SELECT piece_id, bar, CASE WHEN a = b THEN a WHEN qa = qb THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END ELSE a || ' | ' || b END AS chord FROM rq
"""


def build() -> dict[str, str]:
    verify_flags = (
        "SELECT piece_id, bar, 'out_of_key' AS kind FROM n JOIN kset USING (piece_id) WHERE NOT is_drum GROUP BY ALL HAVING bool_or(NOT list_contains(ks, pc))"
        " UNION ALL SELECT DISTINCT a.piece_id, a.bar, 'dissonance' FROM n a JOIN n b ON a.piece_id = b.piece_id AND a.bar = b.bar AND b.midi = a.midi + 1 WHERE NOT a.is_drum AND NOT b.is_drum"
        " UNION ALL SELECT piece_id, bar, 'wrong_bass' FROM (SELECT piece_id, bar, min(midi) % 12 AS lo, list(DISTINCT pc) AS s FROM n WHERE NOT is_drum GROUP BY ALL) b"
        " WHERE (SELECT min(r) FROM (SELECT unnest(range(12))::INTEGER AS r) WHERE list_has_all(s, [r, (r+4)%12, (r+7)%12]) OR list_has_all(s, [r, (r+3)%12, (r+7)%12])) <> lo"
        " UNION ALL SELECT DISTINCT piece_id, bar, 'meter_glitch' FROM n WHERE slot + dur_slots - 1 > 16"
    )
    out = {
        "encoding_cost": PRELUDE + """
SELECT piece_id, count(*) AS n_notes, count(DISTINCT voice) AS n_voices, count(DISTINCT bar) AS n_bars, any_value(r) AS onset_recovery, any_value(e) AS edit_blast, any_value(v) AS vertical_align
FROM n JOIN (SELECT piece_id, sum(k - 1) AS r FROM (SELECT piece_id, voice, bar, count(*) AS k FROM n GROUP BY ALL) GROUP BY ALL) USING (piece_id)
JOIN (SELECT piece_id, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS e FROM (SELECT piece_id, voice, count(*) AS k FROM n GROUP BY ALL) GROUP BY ALL) USING (piece_id)
JOIN (SELECT q.piece_id, count(*) AS v FROM (SELECT DISTINCT piece_id, bar, onb FROM n) q JOIN n ON n.piece_id = q.piece_id AND n.bar = q.bar AND n.onb < q.onb GROUP BY ALL) USING (piece_id) GROUP BY piece_id""",
        "ground_truth": TRUTH + "SELECT * FROM truth",
        "constant_baselines": TRUTH + " UNION ALL ".join([*[_const(f) for f in (
            "highest_midi", "lowest_midi", "most_active_voice", "densest_bar", "distinct_pc_count", "note_value", "any_longer_than_bar", "near_identical_bars", "subdivision", "syncopation")],
            _near("active_span", 1), _near("longest_beats", 0.25)]),
        "key_guess": PRELUDE + KEY + f"SELECT piece_id, {NAMES}[tonic + 1] AS tonic, mode, round(outside, 6) AS outside FROM key",
        "difficulty_grade": PRELUDE + KEY + f""",
ons AS (SELECT piece_id, bar, onb, count(*) AS k, max(midi) AS hi, min(midi) AS lo FROM n GROUP BY ALL),
stp AS (SELECT *, abs(hi - lag(hi) OVER (PARTITION BY piece_id ORDER BY bar, onb)) AS st FROM ons),
t AS (SELECT piece_id, max(CASE WHEN k > 1 THEN hi - lo ELSE 0 END) AS span, max(k) AS sim, avg(CASE WHEN st IS NOT NULL THEN (st >= 3)::INTEGER END) AS leaps FROM stp GROUP BY ALL),
e AS (SELECT piece_id, count(*) AS c, median(dur) AS med, count(DISTINCT dur) AS nd, avg(CASE WHEN onb <> floor(onb) THEN 1.0::DOUBLE ELSE 0 END) AS off, max(midi) - min(midi) AS reach, count(DISTINCT bar) AS nb FROM n GROUP BY ALL),
f AS (SELECT piece_id, {NAMES}[tonic + 1] AS tonic, mode, 0.25::DOUBLE AS tempo, {CLAMP.format('(c / nb::DOUBLE - 2) / 10')} AS note_density, {CLAMP.format('1.25::DOUBLE - med')} AS note_values,
 {CLAMP.format('off')} AS syncopation, {CLAMP.format('nd / 6.0::DOUBLE')} AS rhythmic_variety, {CLAMP.format(CLAMP.format('reach / 24.0::DOUBLE') + ' * 0.5::DOUBLE + leaps * 0.5::DOUBLE')} AS melodic_range_leaps,
 {CLAMP.format('outside * 4')} AS chromaticism, {CLAMP.format(CLAMP.format('span / 24.0::DOUBLE') + ' * 0.6::DOUBLE + ' + CLAMP.format('(sim - 1) / 3.0::DOUBLE') + ' * 0.4::DOUBLE')} AS hand_span_polyphony,
 0.1::DOUBLE AS meter, {ACC}[1 + (tonic + CASE WHEN mode = 'minor' THEN 3 ELSE 0 END) % 12] / 6.0::DOUBLE AS key_signature FROM e JOIN t USING (piece_id) JOIN key USING (piece_id)),
g AS (SELECT *, round(tempo * 0.12::DOUBLE + note_density * 0.14::DOUBLE + note_values * 0.14::DOUBLE + syncopation * 0.14::DOUBLE + rhythmic_variety * 0.10::DOUBLE + melodic_range_leaps * 0.12::DOUBLE + chromaticism * 0.08::DOUBLE
 + hand_span_polyphony * 0.08::DOUBLE + meter * 0.04::DOUBLE + key_signature * 0.04::DOUBLE, 9) AS s FROM f)
SELECT piece_id, tonic, mode, """ + ", ".join(f"round(CAST({c} AS DECIMAL(20,12)), 3)::DOUBLE AS {c}" for c in (
            "tempo", "note_density", "note_values", "syncopation", "rhythmic_variety", "melodic_range_leaps", "chromaticism", "hand_span_polyphony", "meter", "key_signature"))
        + ", round(CAST(s * 100 AS DECIMAL(20,7)), 1)::DOUBLE AS score_0_100, CAST(greatest(1, least(10, round_even(s * 9 + 1, 0))) AS INTEGER) AS grade_1_10 FROM g",
        "anomaly_sites": PRELUDE + KEY + SITES + "SELECT piece_id, kind, bar, voice, slot, dur_slots, array_to_string(midis, '+') AS old, array_to_string(new, '+') AS new FROM site",
        "anomaly_verify": PRELUDE + KEY + verify_flags,
        "anomaly_heuristic": PRELUDE + KEY + f""", tok AS (SELECT {TK}, list_sort(list(DISTINCT midi)) AS midis FROM n GROUP BY ALL),
hb AS (SELECT piece_id, bar, sum(len(list_filter(midis, lambda m: NOT list_contains(ks, m % 12)))) AS o, sum(len(list_filter(midis, lambda m: list_contains(midis, m + 1)))) AS c, (max(slot + dur_slots - 1) > 22)::INTEGER AS v
 FROM tok JOIN kset USING (piece_id) GROUP BY ALL)
SELECT piece_id, true AS anomaly, bar, CASE WHEN v > 0 THEN 'meter_glitch' WHEN c > 0 THEN 'dissonance' ELSE 'out_of_key' END AS kind, CAST(o + c + v AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY o + c + v DESC, bar) AS r FROM hb WHERE o + c + v > 0) WHERE r = 1""",
    }
    out["bar_chords"] = CHORDS
    for name, sql in LEVERS.items():
        out[f"lever_{name}"] = PRELUDE + MEANS + f"SELECT {ROWS}, count(*) AS n FROM ({sql}) GROUP BY ALL"
    return out

