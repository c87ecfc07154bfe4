"""SQL twins for the reference distribution and the gates."""

from __future__ import annotations

from oracle.base import FINGERPRINT

BP = ("round(CAST(quantile_cont(value, 0.05) AS DECIMAL(28,9)), 4)::DOUBLE AS p5, round(CAST(quantile_cont(value, 0.25) AS DECIMAL(28,9)), 4)::DOUBLE AS p25, round(CAST(quantile_cont(value, 0.5) AS DECIMAL(28,9)), 4)::DOUBLE AS p50,"
      " round(CAST(quantile_cont(value, 0.75) AS DECIMAL(28,9)), 4)::DOUBLE AS p75, round(CAST(quantile_cont(value, 0.95) AS DECIMAL(28,9)), 4)::DOUBLE AS p95, round(CAST(avg(value) AS DECIMAL(28,9)), 4)::DOUBLE AS mean,"
      " round(CAST(stddev_pop(value) AS DECIMAL(28,9)), 4)::DOUBLE AS sd, round(CAST(min(value) AS DECIMAL(28,9)), 4)::DOUBLE AS min, round(CAST(max(value) AS DECIMAL(28,9)), 4)::DOUBLE AS max")

# The balanced values are spelled out row by row here, one per resampling index.
CORPUS = FINGERPRINT + f""",
fp AS MATERIALIZED (SELECT * FROM raw),
big AS (SELECT max(c) AS k FROM (SELECT count(*) AS c FROM fp GROUP BY axis, genre)),
srt AS (SELECT axis, genre, value, row_number() OVER (PARTITION BY axis, genre ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY axis, genre) AS c FROM fp),
bal AS MATERIALIZED (SELECT s.axis, s.value FROM (SELECT DISTINCT axis, genre, c FROM srt) g CROSS JOIN big
        CROSS JOIN (SELECT unnest(range((SELECT k FROM big))) AS j) js JOIN srt s ON s.axis = g.axis AND s.genre = g.genre AND s.i = (js.j * g.c) // big.k
        WHERE js.j < big.k),
bps AS MATERIALIZED (SELECT axis, count(*) AS n, {BP} FROM bal GROUP BY axis),
gb AS MATERIALIZED (SELECT axis, genre, count(*) AS n, {BP} FROM fp GROUP BY axis, genre HAVING count(*) >= 4),
bc AS (SELECT axis, value, count(*) AS w FROM bal GROUP BY ALL),
cdf AS (SELECT axis, value, sum(w) OVER (PARTITION BY axis ORDER BY value) AS u, sum(w) OVER (PARTITION BY axis) AS t FROM bc),
prof AS MATERIALIZED (SELECT f.piece_id, f.genre, f.axis, f.value,
        CAST(round_even(coalesce(c.u, 0) / (SELECT max(t) FROM cdf)::DOUBLE * 100, 0) AS INTEGER) AS percentile
        FROM fp f ASOF LEFT JOIN cdf c ON f.axis = c.axis AND f.value >= c.value),
tgt AS (SELECT g.axis, g.genre, CASE WHEN g.p75 - g.p25 < 0.02 * greatest(1e-9, b.p95 - b.p5) THEN g.p5 ELSE g.p25 END AS lo,
        g.p50 AS target, CASE WHEN g.p75 - g.p25 < 0.02 * greatest(1e-9, b.p95 - b.p5) THEN g.p95 ELSE g.p75 END AS hi
        FROM gb g JOIN bps b USING (axis)),
ext AS (SELECT f.piece_id, f.genre, f.axis, f.percentile FROM prof f LEFT JOIN gb g USING (axis, genre)
        WHERE (percentile <= 5 OR percentile >= 95) AND NOT coalesce(f.value BETWEEN g.p25 AND g.p75, false))
"""

STATUS = "CASE WHEN percentile < 5 THEN 'EXT-LO' WHEN percentile < 25 THEN 'lo' WHEN percentile <= 75 THEN 'in' WHEN percentile <= 95 THEN 'hi' ELSE 'EXT-HI' END"

SHAPES = CORPUS + """,
st AS (SELECT axis, count(*) AS n, avg(value) AS mean, sum(round(value * 1000000)::BIGINT) AS u, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi,
       count(DISTINCT value) AS d, bool_and(value IN (0, 1)) AS isb FROM bal GROUP BY axis),
mo AS (SELECT axis, avg(((value - mean) / sd) ** 3) AS skew, avg(((value - mean) / sd) ** 4) AS kurt FROM bal JOIN st USING (axis) WHERE sd > 0 GROUP BY axis),
hb AS (SELECT axis, max(k) AS k FROM (SELECT axis, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 12), 11) ELSE 0 END AS b,
       count(*) AS k FROM bal JOIN st USING (axis) GROUP BY ALL) GROUP BY axis),
al AS (SELECT axis, n, mean, u, sd, lo, hi, d, isb, coalesce(skew, 0) AS skew, coalesce(kurt, 0) AS kurt,
       CASE WHEN coalesce(kurt, 0) > 0 THEN (skew ** 2 + 1) / kurt ELSE 1 END AS bc, k / n::DOUBLE AS ms FROM st LEFT JOIN mo USING (axis) JOIN hb USING (axis))
SELECT axis, n, floor((2 * u + n) / (2 * n)::DOUBLE) / 1000000 AS mean, round(sd, 6) AS sd, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(bc, 6) AS bc,
  round(ms, 6) AS modal_share, d AS distinct, CASE WHEN hi = lo OR d <= 1 OR ms > 0.55 OR (isb AND (mean > 0.95 OR mean < 0.05)) THEN 'DEGENERATE'
  WHEN bc > 0.6 THEN 'bimodal/flat' WHEN abs(skew) < 0.8 THEN 'near-normal' ELSE 'skewed' END AS shape FROM al
"""


def build() -> dict[str, str]:
    q = {
        "corpus_balanced_values": "SELECT axis, value, w AS weight FROM bc",
        "corpus_breakpoints": "SELECT * FROM bps",
        "corpus_genre_bands": "SELECT * FROM gb",
        "corpus_extreme_budget": ", e AS (SELECT genre, axis, quantile_cont(percentile::DOUBLE, 0.05) AS lo, quantile_cont(percentile::DOUBLE, 0.95) AS hi"
        " FROM prof GROUP BY ALL), x AS (SELECT genre, piece_id, sum(CASE WHEN percentile < lo OR percentile > hi THEN 1 ELSE 0 END) AS k"
        " FROM prof JOIN e USING (genre, axis) GROUP BY ALL)\nSELECT genre, count(*) AS n, CAST(trunc(quantile_cont(k::DOUBLE, 0.5)) AS INTEGER) AS median,"
        " CAST(trunc(quantile_cont(k::DOUBLE, 0.75)) AS INTEGER) AS p75, round(avg(k), 6) AS mean FROM x GROUP BY genre HAVING count(*) >= 4",
        "percentile_profile": "SELECT piece_id, axis, round(value, 4) AS value, percentile, mean AS corpus_mean, min AS corpus_min, max AS corpus_max"
        " FROM prof JOIN bps USING (axis)",
        "band_profile": f"SELECT piece_id, axis, percentile, {STATUS} AS status FROM prof",
        "band_summary": f", s AS (SELECT *, {STATUS} AS st FROM prof)\nSELECT piece_id, count(*) FILTER (st = 'in') AS n_in, count(*) FILTER (st <> 'in') AS n_out,"
        " count(*) FILTER (st LIKE 'EXT%') AS n_extreme, round(stddev_pop(percentile), 6) AS spread, round(avg(abs(percentile - 50)), 6) AS from_center,"
        " count(*) FILTER (percentile BETWEEN 40 AND 60) AS near_mean FROM s GROUP BY piece_id",
        "genre_band_check": "SELECT piece_id, genre, axis, value, percentile, lo, hi, target, CASE WHEN lo IS NULL THEN 'no_band' WHEN value BETWEEN lo AND hi THEN 'in'"
        " WHEN value < lo THEN 'LOW' ELSE 'HIGH' END AS state FROM prof LEFT JOIN tgt USING (axis, genre)",
        "global_band_check": "SELECT piece_id, axis, value, p50 AS target, CASE WHEN value < p25 THEN 'LOW' ELSE 'HIGH' END AS state"
        " FROM prof JOIN bps USING (axis) WHERE NOT value BETWEEN p25 AND p75",
        "genre_extremes": "SELECT * FROM ext",
        "genre_fit": "SELECT piece_id, genre, CASE WHEN count(p25) > 0 THEN count(*) FILTER (value BETWEEN p25 AND p75) END AS fit FROM prof LEFT JOIN gb USING (axis, genre) GROUP BY piece_id, genre",
    }
    out = {k: CORPUS + v for k, v in q.items()}
    out["corpus_shapes"] = SHAPES
    return out
