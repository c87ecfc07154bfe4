"""SQL twins for copy overlap and retrieval."""

from __future__ import annotations

from oracle.base import PRELUDE
from oracle.reference import CORPUS

CELLS = PRELUDE + """,
cell AS (SELECT DISTINCT piece_id, bar, onb, midi FROM n),
kinds AS (SELECT DISTINCT piece_id, onb, midi FROM n),
totals AS (SELECT piece_id, count(*) AS total FROM n GROUP BY ALL),
nk AS (SELECT piece_id, count(*) AS k FROM kinds GROUP BY ALL),
bag AS (SELECT a.piece_id, b.piece_id AS song, count(*) / any_value(nk.k)::DOUBLE AS bag FROM kinds a JOIN kinds b USING (onb, midi)
        JOIN nk ON nk.piece_id = a.piece_id WHERE a.piece_id <> b.piece_id GROUP BY ALL),
slid AS (SELECT piece_id, song, max(hits) AS hits FROM (SELECT a.piece_id, b.piece_id AS song, b.bar - a.bar AS o, count(*) AS hits
         FROM cell a JOIN cell b USING (onb, midi) WHERE a.piece_id <> b.piece_id GROUP BY ALL) GROUP BY ALL),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY bag DESC, song DESC) AS r FROM bag) WHERE r <= 25),
topb AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.piece_id ORDER BY hits DESC, bag DESC, s.song DESC) AS b
         FROM slid s JOIN pre USING (piece_id, song)) WHERE b = 1),
bestb AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.piece_id ORDER BY hits DESC, bag DESC, s.song DESC) AS b
         FROM slid s JOIN bag USING (piece_id, song)) WHERE b = 1),
allb AS (SELECT piece_id, song, coalesce(hits, 0) AS hits FROM totals LEFT JOIN bestb USING (piece_id))
"""

VEC = CORPUS + """,
d AS (SELECT a.piece_id, b.piece_id AS neighbor, round(avg(abs(a.percentile - b.percentile)::DOUBLE), 9) AS dist FROM prof a JOIN prof b USING (axis)
      WHERE a.piece_id <> b.piece_id GROUP BY ALL),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 3)
"""


def build() -> dict[str, str]:
    return {
        "copy_risk": CELLS + "SELECT piece_id, song, round(hits / total::DOUBLE, 3) AS copy_risk, hits / total::DOUBLE < 0.3 AS passed"
        " FROM allb JOIN totals USING (piece_id)",
        "copy_risk_prefiltered": CELLS + "SELECT piece_id, song, round(coalesce(hits, 0) / total::DOUBLE, 3) AS copy_risk, coalesce(hits, 0) / total::DOUBLE < 0.3 AS passed"
        " FROM totals LEFT JOIN topb USING (piece_id)",
        "copy_overlap_exact": CELLS + "SELECT piece_id, song, hits, total, round(hits / total::DOUBLE, 6) AS overlap FROM allb JOIN totals USING (piece_id)",
        "copy_budget": CELLS + "SELECT genre, count(*) AS n, round(CAST(quantile_cont(hits / total::DOUBLE, 0.9) AS DECIMAL(28,9)), 2)::DOUBLE AS p90,"
        " round(CAST(quantile_cont(hits / total::DOUBLE, 0.5) AS DECIMAL(28,9)), 2)::DOUBLE AS median FROM allb JOIN totals USING (piece_id) JOIN p USING (piece_id) GROUP BY genre",
        "nearest_neighbors": VEC + "SELECT piece_id, neighbor, round(dist, 6) AS dist, rank FROM nn",
        "neighbor_tendencies": VEC + ", m AS (SELECT nn.piece_id, axis, avg(percentile::DOUBLE) AS center FROM nn JOIN prof ON prof.piece_id = nn.neighbor GROUP BY ALL)\n"
        "SELECT piece_id, axis, round(center, 6) AS center, rank FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY"
        " round(-abs(center - 50), 9), axis) AS rank FROM m) WHERE rank <= 6",
        "centroid_exemplars": CORPUS + ", c AS (SELECT genre, axis, avg(percentile::DOUBLE) AS center FROM prof GROUP BY ALL),"
        " e AS (SELECT genre, piece_id, round(avg(abs(percentile - center)), 9) AS dist FROM prof JOIN c USING (genre, axis) GROUP BY ALL)\n"
        "SELECT genre, piece_id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY dist, piece_id) AS rank FROM e) WHERE rank <= 3",
        "embedding_neighbors": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),"
        " d AS (SELECT a.vec_id, b.vec_id AS neighbor, round(avg(abs(a.x - b.x)), 9) AS dist FROM v a JOIN v b USING (i) WHERE a.vec_id <> b.vec_id GROUP BY ALL)\n"
        "SELECT vec_id, neighbor, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor) AS rank FROM d) WHERE rank <= 3",
    }
