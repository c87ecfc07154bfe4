"""Nearest neighbours, centroid exemplars and beat percentage over percentile vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import numeric as num
from stavelake.operators.blocks import block_pairs
from stavelake.session import cut_lineage


def vectors(profile: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, vec): percentile coordinates in axis order. A piece has a fixed number of axes."""
    ordered = F.sort_array(F.collect_list(F.struct("axis", F.col("percentile").cast("double").alias("p"))))
    return profile.groupBy(F.col(key).alias("key")).agg(F.transform(ordered, lambda x: x["p"]).alias("vec"))


#: Queries and corpus rows of a tile of distances.
TILE_Q, TILE_C = 32, 1024


def _l1(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean absolute differences, one dimension after the other."""
    out, one = np.zeros((len(q), len(c))), np.empty((len(q), len(c)))
    for a, b in zip(q.T, np.ascontiguousarray(c.T)):
        np.subtract(a[:, None], b[None, :], out=one)
        out += np.abs(one, out=one)
    return np.round(out / max(1, q.shape[1]), 9)


def _bytes(vectors: np.ndarray) -> np.ndarray | None:
    """The vectors as bytes, by dimension, if they hold whole numbers from 0 to 100, as percentiles are."""
    if vectors.dtype != np.float64 or vectors.shape[1] > 600:
        return None
    with np.errstate(invalid="ignore"):
        whole = ((vectors >= 0) & (vectors <= 100) & (vectors == np.floor(vectors))).all()
    return np.ascontiguousarray(vectors.T.astype(np.int8)) if whole else None


def _sums(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of bytes, two dimensions (200 at most) at a time."""
    shape = q.shape[1], c.shape[1]
    out, first, second = np.zeros(shape, np.uint16), np.empty(shape, np.int8), np.empty(shape, np.int8)
    two, one = first.view(np.uint8), second.view(np.uint8)
    for k, (a, b) in enumerate(zip(q, c)):
        held = second if k % 2 else first
        np.subtract(a[:, None], b[None, :], out=held)
        np.abs(held, out=held)
        if k % 2:
            two += one
        if k % 2 or k == len(q) - 1:
            out += two
    return out


def _slices(n: int, size: int) -> list[slice]:
    return [slice(i, min(n, i + size)) for i in range(0, n, size)]


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least finite values of every row, earlier ones first among equals; -1 where a row has fewer."""
    if not len(d):
        return np.zeros((0, min(k, d.shape[1])), np.int64)
    d, rows, picked = np.where(np.isfinite(d), d, np.inf), np.arange(len(d)), []
    for _ in range(min(k, d.shape[1])):
        at = d.argmin(axis=1)
        picked.append(np.where(np.isfinite(d[rows, at]), at, -1))
        d[rows, at] = np.inf
    return np.stack(picked, axis=1)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 3, exclude_self: bool = True) -> DataFrame:
    """The k nearest corpus rows by mean absolute difference; ties go to the smaller id.

    Inputs are (key, vec). Returns (key, neighbor, dist, rank).
    """
    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"key": [], "neighbor": [], "dist": []})
        c = c.sort_values("key").reset_index(drop=True)
        asked, theirs = np.stack(q["vec"].to_list()), np.stack(c["vec"].to_list())
        keys, ids, found = q["key"].to_numpy(), c["key"].to_numpy(), []
        own, other, dims = _bytes(asked), _bytes(theirs), max(1, asked.shape[1])
        exact = own is not None and other is not None and len(own) == len(other)
        for some in _slices(len(q), TILE_Q):
            near, worst = [], np.full((some.stop - some.start, k), np.inf)
            for part in _slices(len(c), TILE_C):
                if exact:
                    d = _sums(own[:, some], other[:, part])
                    if exclude_self:
                        d[keys[some][:, None] == ids[part][None, :]] = np.iinfo(d.dtype).max
                    # Only rows with one nearer than the k-th so far: later ids lose ties.
                    better = np.flatnonzero(d.min(axis=1) < worst[:, -1])
                    d = np.where(d[better] == np.iinfo(d.dtype).max, np.inf, d[better])
                else:
                    better, d = np.arange(some.stop - some.start), _l1(asked[some], theirs[part])
                    if exclude_self:
                        d = np.where(keys[some][:, None] == ids[part][None, :], np.inf, d)
                at = _least(d, k)
                row, place = np.nonzero(at >= 0)
                dist = d[row, at[row, place]]
                if exact:
                    least = np.full((len(better), k), np.inf)
                    least[row, place] = dist
                    worst[better] = np.sort(np.concatenate([worst[better], least], axis=1), axis=1)[:, :k]
                    dist = np.round(dist / dims, 9)
                near.append(np.stack([better[row], part.start + at[row, place], dist]))
            row, at, dist = np.concatenate(near, axis=1)
            order = np.lexsort((at, dist, row))
            row, at, dist = row[order].astype(np.int64), at[order].astype(np.int64), dist[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"key": keys[some][row[kept]], "neighbor": ids[at[kept]], "dist": dist[kept]}))
        return pd.concat(found, ignore_index=True)

    kind = dict(corpus.dtypes)["key"]
    best = block_pairs(queries, corpus, kernel, f"key {kind}, neighbor {kind}, dist double")
    w = W.partitionBy("key").orderBy("dist", "neighbor")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def farther(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, farther, n): how many of n corpus vectors lie farther from a case's ``vec`` than its ``d_gr``."""
    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"key": [], "farther": [], "n": []})
        asked, theirs = np.stack(q["vec"].to_list()), np.stack(c["vec"].to_list())
        limit, beyond = np.round(q["d_gr"].to_numpy(np.float64), 9), np.zeros(len(q), np.int64)
        own, other = _bytes(asked), _bytes(theirs)
        exact = own is not None and other is not None and len(own) == len(other)
        if exact:  # the least sum whose mean is beyond the limit; none is beyond a limit that is no number
            means = np.round(np.arange(100 * len(own) + 1) / max(1, len(own)), 9)
            least = np.where(np.isnan(limit), len(means), np.searchsorted(means, limit, "right")).astype(np.uint16)
        for some in _slices(len(q), TILE_Q):
            for part in _slices(len(c), TILE_C):
                if exact:
                    beyond[some] += np.count_nonzero(_sums(own[:, some], other[:, part]) >= least[some][:, None], axis=1)
                else:
                    beyond[some] += (_l1(asked[some], theirs[part]) > limit[some][:, None]).sum(axis=1)
        return pd.DataFrame({"key": q["key"], "farther": beyond, "n": len(c)})

    kind = dict(cases.dtypes)["key"]
    parts = block_pairs(cases, corpus, kernel, f"key {kind}, farther long, n long")
    return parts.groupBy("key").agg(F.sum("farther").alias("farther"), F.sum("n").alias("n"))


def beat_percent(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of corpus vectors farther from a case's ``vec`` than its ``d_gr``, in whole percent."""
    return farther(cases, corpus).select("key", F.rint(F.col("farther") / F.col("n") * 100).cast("int").alias("beat_pct"))


def centroids(profile: DataFrame) -> DataFrame:
    return profile.groupBy("genre", "axis").agg(F.avg("percentile").alias("center"))


def exemplars(profile: DataFrame, k: int = 3) -> DataFrame:
    """Per genre the k pieces nearest to the genre's centroid; ties go to the smaller id."""
    dist = (
        profile.join(centroids(profile), ["genre", "axis"])
        .groupBy("genre", "piece_id")
        .agg(F.round(F.avg(F.abs(F.col("percentile") - F.col("center"))), 9).alias("dist"))
    )
    return top_per_group(dist, ["genre"], ["dist", "piece_id"], k)


def disjoint_exemplars(profile: DataFrame, draws: int, k: int = 2, pool: int | None = None, seed: int = 0) -> DataFrame:
    """(genre, draw, piece_id, dist, place): ``draws`` successive picks of k exemplars per genre, no piece twice.

    Every draw measures the pieces still free against their own centroid, keeps the ``pool`` nearest (6 or 3k) and takes k
    of them by a hash of seed, draw and id; a genre that has run out gets fewer. All genres draw in one job, and picks are
    written between draws, so the driver only counts draws.
    """
    pool = max(k, pool or max(6, 3 * k))
    free, taken = profile.select("genre", "piece_id", "axis", "percentile"), None
    for draw in range(1, draws + 1):
        near = exemplars(free, pool).withColumn("lot", num.chance(f"draw{seed}", F.lit(draw), F.col("piece_id")))
        w = W.partitionBy("genre").orderBy("lot", "piece_id")  # a pool holds a handful of rows
        picked = cut_lineage(near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(
            "genre", F.lit(draw).alias("draw"), "piece_id", "dist", "place"
        ))
        taken = picked if taken is None else taken.unionByName(picked)
        free = free.join(picked.select("piece_id"), "piece_id", "left_anti")
    return taken


def top_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First k rows per group. Each hash slice of a group keeps its own k first, so a large group is
    never ranked in one task."""
    slices = F.pmod(F.xxhash64(*order), F.lit(64))
    pre = df.withColumn("_s", slices).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order)))
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        pre.filter(F.col("_r") <= k).drop("_s", "_r").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    )


def tendencies(neighbors: DataFrame, profile: DataFrame, k: int = 6) -> DataFrame:
    """The k axes where a case's neighbours lie farthest from the middle, with their mean percentile."""
    p = profile.select(F.col("piece_id").alias("neighbor"), "axis", "percentile")
    mean = neighbors.join(p, "neighbor").groupBy("key", "axis").agg(F.avg("percentile").alias("center"))
    pull = F.round(-F.abs(F.col("center") - 50), 9)
    w = W.partitionBy("key").orderBy("pull", "axis")
    return mean.withColumn("pull", pull).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pull")
