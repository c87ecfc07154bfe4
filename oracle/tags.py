"""SQL twin of the training tags."""

from __future__ import annotations

from oracle.base import PRELUDE
from oracle.edits import BAR, CHORDS, KEY, pick

FLAGS = {"dotted": 1.5, "eighths": 0.5, "halves": 2.0, "quarters": 1.0, "sixteenths": 0.25, "wholes": 4.0}

TAGS = PRELUDE + KEY + f""",
chd AS ({CHORDS}),
m AS (SELECT * FROM n UNION ALL SELECT * REPLACE (-1 - piece_id AS piece_id) FROM n WHERE voice = 'V1' AND dur_slots = 1 AND piece_id % 4 = 0),
hd AS (SELECT piece_id, CASE WHEN piece_id % 3 = 0 THEN '6/8' ELSE '4/4' END AS meter, CASE WHEN piece_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS u,
  CASE WHEN piece_id % 5 <> 0 THEN 40 + abs(piece_id) * 29 % 150 END AS bpm FROM (SELECT DISTINCT piece_id FROM m)),
words AS (SELECT piece_id, arg_min(w, abs(v - coalesce(bpm, 90)) * 1000 + v) AS w FROM hd CROSS JOIN
  (VALUES ('largo', 50), ('adagio', 66), ('andante', 84), ('moderato', 100), ('allegro', 138), ('vivace', 156), ('presto', 176)) t(w, v) GROUP BY ALL),
b AS (SELECT piece_id, round(CAST(avg((onb / u > floor(onb / u))::INTEGER) AS DECIMAL(28,9)), 2)::DOUBLE AS off, bool_or((floor(onb / u) + 1) * u < onb + dur - 1e-6) AS tie,
  {', '.join(f'bool_or(abs(dur - {v}) < 0.05) AS {k}' for k, v in FLAGS.items())} FROM m JOIN hd USING (piece_id) GROUP BY ALL),
tp AS (SELECT piece_id, bar, onb, count(*) AS k, max(midi) AS top FROM m GROUP BY ALL),
st AS (SELECT *, abs(top - lag(top) OVER (PARTITION BY piece_id ORDER BY bar, onb)) AS s FROM tp),
ln AS (SELECT piece_id, max(k) AS k, avg((s <= 2)::INTEGER) AS steps, avg((s >= 3)::INTEGER) AS leaps, max(s) AS widest FROM st GROUP BY ALL),
bp AS (SELECT piece_id, max(c) AS c FROM (SELECT piece_id, bar, count(DISTINCT pc) AS c FROM m GROUP BY ALL) GROUP BY ALL),
rn AS (SELECT piece_id, max(k) AS run FROM (SELECT piece_id, g, count(*) FILTER (dur = 0.25) AS k FROM
  (SELECT piece_id, dur, sum((dur <> 0.25)::INTEGER) OVER (PARTITION BY piece_id ORDER BY bar, onb, seq, midi ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY ALL) GROUP BY ALL),
lb AS (SELECT piece_id, bar, i, string_split(chord, ' | ')[i] AS l FROM chd CROSS JOIN (VALUES (1), (2)) h(i)),
ql AS (SELECT piece_id, CASE WHEN lower(l) LIKE '%maj7%' THEN 'maj7' WHEN l LIKE '%7' THEN 'dom7' WHEN lower(l) LIKE '%dim%' THEN 'diminished' WHEN lower(l) LIKE '%aug%' THEN 'augmented'
  WHEN l LIKE '%m' OR substr(l, 2, 1) = 'm' THEN 'minor' ELSE 'major' END AS q, count(*) AS k, min(bar * 2 + i) AS since FROM lb WHERE l NOT IN ('', '?') GROUP BY ALL),
tr AS (SELECT piece_id, bool_or({pick('rhy_triplet_share', BAR)} < 0.5) AS triplets FROM (SELECT piece_id, unnest(range(1, 33)) AS bar FROM p) GROUP BY piece_id),
vl AS (SELECT b.piece_id, concat_ws('+', {', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in FLAGS)}, CASE WHEN triplets THEN 'triplets' END) AS v FROM b LEFT JOIN tr USING (piece_id))
SELECT piece_id, 'meter:' || meter AS tag FROM hd
UNION ALL SELECT piece_id, 'tempo:' || w || '(' || coalesce(bpm::VARCHAR, '?') || 'bpm)' FROM hd JOIN words USING (piece_id)
UNION ALL SELECT piece_id, 'key:' || ['C','C#','D','Eb','E','F','F#','G','Ab','A','Bb','B'][tonic + 1] || ' ' || mode FROM key
UNION ALL SELECT piece_id, 'syncopation:' || CASE WHEN off < 0.08 THEN 'straight' WHEN off < 0.32 THEN 'light' WHEN off < 0.55 THEN 'moderate' ELSE 'heavy' END || '(' || off || ')' FROM b
UNION ALL SELECT piece_id, 'note-values:' || v FROM vl WHERE v <> ''
UNION ALL SELECT piece_id, 'melody:stepwise' FROM ln WHERE steps >= 0.6
UNION ALL SELECT piece_id, 'melody:leaps' FROM ln WHERE widest >= 5 OR leaps >= 0.3
UNION ALL SELECT piece_id, 'device:sixteenth-runs' FROM rn WHERE run >= 4
UNION ALL SELECT piece_id, 'device:ties' FROM b WHERE tie
UNION ALL SELECT piece_id, 'texture:' || CASE WHEN k >= 3 THEN 'block-chords' WHEN c >= 3 THEN 'broken-chords/arpeggio' ELSE 'single-line' END FROM ln JOIN bp USING (piece_id)
UNION ALL SELECT piece_id, 'chords:' || string_agg(q, ',' ORDER BY k DESC, since) FROM ql GROUP BY piece_id"""


def build() -> dict[str, str]:
    return {"training_tags": TAGS}
