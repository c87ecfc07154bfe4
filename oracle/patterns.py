"""SQL twins for the pattern catalogue."""

from __future__ import annotations

from oracle.bank import ROLE_LEVELS


def island(src: str, keys: str, cont: str, least: int) -> str:
    """Runs over src rows ordered by bar: (keys, start, len)."""
    return (
        f"SELECT {keys}, min(bar) AS start, count(*) AS len FROM (SELECT *, sum(CASE WHEN coalesce({cont}, false) THEN 0 ELSE 1 END) OVER"
        f" (PARTITION BY {keys} ORDER BY bar) AS run FROM ({src})) GROUP BY {keys}, run HAVING count(*) >= {least}"
    )


MELODY = """,
mv AS (SELECT piece_id, abs, dmax, CAST(floor(abs / 4) + 1 AS INTEGER) AS bar, lead(top) OVER w - top AS iv, lead(top, 2) OVER w - lead(top) OVER w AS iv2,
       lead(top, 3) OVER w - lead(top, 2) OVER w AS iv3, lead(dmax) OVER w AS nd FROM mline WINDOW w AS (PARTITION BY piece_id ORDER BY abs)),
gram AS (SELECT piece_id, iv, iv2, iv3, count(*) AS c, min(abs) AS t, arg_min(bar, abs) AS bar FROM mv WHERE iv3 IS NOT NULL GROUP BY ALL),
gtop AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY c DESC, t) AS r FROM gram),
shp AS (SELECT piece_id, voice_ix, bar, list_sort(list(DISTINCT round(onb, 3))) AS s FROM n GROUP BY ALL),
shq AS (SELECT *, bar = lag(bar) OVER w + 1 AND s = lag(s) OVER w AND len(s) >= 2 AS same FROM shp WINDOW w AS (PARTITION BY piece_id, voice_ix ORDER BY bar)),
fullb AS (SELECT piece_id, bar FROM n JOIN rbass USING (piece_id, voice) GROUP BY ALL HAVING list_has_all(list(round_even(onb, 0)), [0.0, 1.0, 2.0, 3.0])),
fullq AS (SELECT *, bar = lag(bar) OVER (PARTITION BY piece_id ORDER BY bar) + 1 AS cont FROM fullb),
dens AS (SELECT piece_id, bar, count(*) AS k FROM n GROUP BY ALL),
densr AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY bar DESC) AS e FROM dens),
med AS (SELECT piece_id, list_sort(list(k))[1 + len(list(k)) // 2] AS m FROM dens GROUP BY ALL),
chordal AS (SELECT piece_id, voice, voice_ix FROM vs WHERE n / n_on::DOUBLE >= 1.8)
"""
LEVELS = ROLE_LEVELS + MELODY
STEP = "SELECT *, lo - prev AS d FROM br"


def _min(inner: str) -> str:
    return f"SELECT piece_id, min(start) AS bar FROM ({inner}) GROUP BY piece_id"


DETECT = {
    "H:descending_bass": _min(island(STEP, "piece_id", "d BETWEEN -2 AND -1", 3)),
    "H:fourth_root_motion": "SELECT piece_id, min(CASE WHEN r AND q THEN bar END) AS bar FROM (SELECT *, lag(r) OVER (PARTITION BY piece_id ORDER BY bar) AS q FROM"
    " (SELECT piece_id, bar, (lo - prev + 120) % 12 = 5 AS r FROM br)) GROUP BY piece_id HAVING min(CASE WHEN r AND q THEN bar END) IS NOT NULL OR count(*) FILTER (r) >= 3",
    "H:augmented": "SELECT piece_id, min(bar) AS bar FROM tpl WHERE aug AND k >= 3 GROUP BY piece_id",
    "H:diminished": "SELECT piece_id, min(bar) AS bar FROM tpl WHERE dim AND k >= 3 GROUP BY piece_id",
    "H:dominant7": "SELECT piece_id, min(bar) AS bar FROM tpl WHERE dom AND k >= 3 GROUP BY piece_id",
    "H:pedal_point": _min(island("SELECT * FROM br", "piece_id", "lo % 12 = prev % 12", 4)),
    "M:stepwise": "SELECT piece_id, arg_min(bar, abs) FILTER (abs(iv) IN (1, 2)) AS bar FROM mv GROUP BY piece_id"
    " HAVING sum(CASE WHEN abs(iv) BETWEEN 1 AND 2 THEN 1 ELSE 0 END) / sum(CASE WHEN iv <> 0 THEN 1 ELSE 0 END)::DOUBLE >= 0.6",
    "M:sigh": "SELECT piece_id, arg_min(bar, abs) AS bar FROM mv WHERE iv IN (-1, -2) AND nd >= dmax * 1.5 AND nd >= 1 GROUP BY piece_id",
    "M:motivic_cell": "SELECT piece_id, bar FROM gtop WHERE r = 1 AND c >= 3 AND NOT (iv = 0 AND iv2 = 0 AND iv3 = 0)",
    "M:leap_gapfill": "SELECT piece_id, arg_min(bar, abs) AS bar FROM mv WHERE abs(iv) >= 7 AND iv * iv2 < 0 AND abs(iv2) <= 2 GROUP BY piece_id",
    "R:triplet": "SELECT piece_id, 1 AS bar FROM p WHERE false",
    "R:straight": "SELECT DISTINCT piece_id, 1 AS bar FROM n",
    "R:syncopation": "SELECT piece_id, arg_min(bar, seq) FILTER (onb - floor(onb) > 1e-6) AS bar FROM n GROUP BY piece_id"
    " HAVING avg(CASE WHEN onb - floor(onb) > 1e-6 THEN 1.0::DOUBLE ELSE 0 END) >= 0.15",
    "R:ostinato": "SELECT piece_id, arg_min(start, voice_ix * 1000 + start) AS bar FROM (" + island("SELECT * FROM shq", "piece_id, voice_ix", "same", 8) + ") GROUP BY piece_id",
    "R:root_pulse_bass": "SELECT piece_id, arg_max(start, len * 1000 - start) AS bar FROM (" + island("SELECT * FROM fullq", "piece_id", "cont", 8) + ") GROUP BY piece_id",
    "F:verbatim_reprise": "SELECT piece_id, arg_min(seen, bar) AS bar FROM (SELECT *, min(bar) OVER (PARTITION BY piece_id, key) AS seen FROM win WHERE gap = 3) WHERE bar - seen >= 4 GROUP BY piece_id",
    "F:sparse_intro": "SELECT piece_id, min(bar) AS bar FROM (SELECT *, min(bar) OVER (PARTITION BY piece_id) AS f FROM n) WHERE bar < f + 4 GROUP BY piece_id HAVING count(DISTINCT voice) = 1",
    "F:thinning_outro": "SELECT piece_id, min(bar) AS bar FROM densr JOIN med USING (piece_id) WHERE e <= 3 GROUP BY piece_id HAVING max(k) <= greatest(1, max(m) * 0.5)",
    "T:role_stratification": "SELECT n.piece_id, min(bar) AS bar FROM n JOIN (SELECT DISTINCT c.piece_id FROM chordal c JOIN rbass b USING (piece_id) JOIN rmel m USING (piece_id)"
    " WHERE b.voice <> m.voice AND c.voice <> b.voice AND c.voice <> m.voice) x USING (piece_id) GROUP BY n.piece_id",
    "T:doubling": "SELECT piece_id, CAST(floor(arg_min(t0, v1 * 1000 + v2) / 4) + 1 AS INTEGER) AS bar FROM vp WHERE sh >= 12 AND same / sh::DOUBLE >= 0.9 GROUP BY piece_id",
    "T:parallel_3rd_6th": "SELECT piece_id, CAST(floor(arg_min(t0, v1 * 1000 + v2) / 4) + 1 AS INTEGER) AS bar FROM vp WHERE sh >= 6 AND greatest(th, sx) / sh::DOUBLE >= 0.8 GROUP BY piece_id",
    "T:wide_voicing": "SELECT piece_id, CAST(floor(abs / 4) + 1 AS INTEGER) AS bar FROM (SELECT piece_id, abs, row_number() OVER (PARTITION BY piece_id ORDER BY voice_ix, min(seq)) AS r"
    " FROM n JOIN chordal USING (piece_id, voice, voice_ix) GROUP BY piece_id, voice_ix, abs HAVING count(*) >= 3 AND max(midi) - min(midi) >= 19) WHERE r = 1",
}
ALL = {"harmony": "H", "melody": "M", "rhythm": "R", "form": "F", "texture": "T"}


def union(kinds: str) -> str:
    return " UNION ALL ".join(f"SELECT piece_id, '{k}' AS pattern, CAST(bar AS INTEGER) AS bar FROM ({q})" for k, q in DETECT.items() if k[0] in kinds)


def build() -> dict[str, str]:
    out = {f"patterns_{k}": f"{LEVELS}\n{union(v)}" for k, v in ALL.items()}
    out["pattern_catalog"] = (
        f"{LEVELS}, f AS MATERIALIZED ({union('HMRFT')})\nSELECT a.pattern, n_pieces, piece_id, bar, rank FROM (SELECT pattern, count(DISTINCT piece_id) AS n_pieces FROM f GROUP BY ALL) a"
        " LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY piece_id) AS rank FROM f WHERE bar IS NOT NULL) b ON a.pattern = b.pattern AND rank <= 4"
    )
    return out
