"""Copy risk: shift-tolerant note overlap between pieces.

A note is the cell (bar, onset in bar to two decimals, pitch). The overlap of g with s at an offset is
the number of distinct cells of g found in s shifted by that many bars, over all notes of g.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.operators.blocks import block_pairs, block_pairs_within
from stavelake.session import shared

#: The pre-filter of the original gate: only so many candidates by bag score were slid. No query but the named
#: compatibility one uses it, as it may miss true copies.
TOP_K = 25
COINCIDENTAL = 0.22
STRICT = 0.30


def note_key() -> Column:
    """Onset in bar (two decimals) and pitch as one number."""
    return F.rint(F.col("onb") * 100).cast("long") * 128 + F.col("midi")


def cells(events: DataFrame) -> DataFrame:
    """(key, total, kinds, bars): each piece's distinct cells as two parallel arrays, onset-pitch kind and bar.

    Reduced to distinct cells first, so a piece is bounded by its grid whatever its note count. Notes without a place in
    time or a pitch count in the total but match nothing.
    """
    distinct = events.groupBy("piece_id", note_key().alias("kind"), "bar").agg(F.count(F.lit(1)).alias("n"))
    placed = F.col("kind").isNotNull() & F.col("bar").isNotNull()
    per_piece = distinct.groupBy(F.col("piece_id").alias("key")).agg(
        F.sum("n").alias("total"), F.collect_list(F.when(placed, F.struct("kind", "bar"))).alias("cells")
    )
    return per_piece.select("key", "total", F.col("cells.kind").alias("kinds"), F.col("cells.bar").alias("bars"))


#: Rows of a tile whose matches are listed; matches written, and counts held, at a time.
TILE, MATCHES, COUNTS = 128, 1 << 21, 1 << 21
#: Rows of a tile whose grid is laid out, bytes of that grid and of the counts beside it at most, and adds of a byte's count
#: between two looks at how large it has grown.
TILE_C, GRID, HELD, LOOK = 2048, 1 << 26, 1 << 20, 120
#: What a call, a byte added, and a match listed take, in nanoseconds: the cheaper way is gone.
CALL_NS, BYTE_NS, MATCH_NS = 1000.0, 0.06, 8.0


class _Side:
    """The rows with a cell in the order of their keys, and their cells one after the other, a row's by kind."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows[rows["kinds"].map(len) > 0].sort_values("key", kind="stable", na_position="first")
        n = rows["kinds"].map(len).to_numpy(np.int64)
        self.key, self.total, self.first = rows["key"].to_numpy(), rows["total"].to_numpy(), np.append(0, np.cumsum(n))
        row = np.repeat(np.arange(len(rows)), n)
        kind = np.concatenate([np.zeros(0, np.int64), *rows["kinds"]]).astype(np.int64)
        bar = np.concatenate([np.zeros(0, np.int64), *rows["bars"]]).astype(np.int64)
        order = np.lexsort((kind, row))
        self.row, self.kind, self.bar = row, kind[order], bar[order]
        new = np.append(True, (self.kind[1:] != self.kind[:-1]) | (row[1:] != row[:-1]))[: len(row)]
        self.n_kinds = np.bincount(row[new], minlength=len(rows))

    def cells(self, a: int, b: int) -> slice:
        return slice(self.first[a], self.first[b])


class _Tile:
    """Some rows' cells in the order of their kinds, and which row has which kind."""

    def __init__(self, side: _Side, a: int, b: int):
        some = side.cells(a, b)
        kind, self.at = side.kind[some], a
        order = np.argsort(kind, kind="stable")
        self.bar, self.row = side.bar[some][order], side.row[some][order] - a
        self.kinds, first = np.unique(kind[order], return_index=True)
        self.ends = np.append(first, len(kind))
        self.holds = np.zeros((b - a, len(self.kinds)), np.uint8)
        self.holds[self.row, np.repeat(np.arange(len(self.kinds)), np.diff(self.ends))] = 1


def _tiles(side: _Side, size: int) -> Iterator[tuple[int, int]]:
    """From where to where each tile goes; all are about as large."""
    n = len(side.key)
    size = -(-n // max(1, -(-n // size)))
    return ((i, min(n, i + size)) for i in range(0, n, max(1, size)))


def _common(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many kinds the rows i and j hold both."""
    if len(i) * 16 > len(q) * len(c):
        return (q.astype(np.float32) @ c.T.astype(np.float32))[i, j].astype(np.int64)
    step = max(1, GRID // max(1, q.shape[1]))
    parts = [(q[i[k : k + step]] & c[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _matches(q: _Tile, c: _Tile, at_q: np.ndarray, at_c: np.ndarray, slot_q: np.ndarray, slot_c: np.ndarray) -> Iterator[np.ndarray]:
    """The slot of every match of equal kinds (the sum of its sides' slots), some at a time."""
    buffer, used = np.empty(MATCHES, np.int64), 0
    for a0, a1, c0, c1 in zip(q.ends[at_q], q.ends[at_q + 1], c.ends[at_c], c.ends[at_c + 1]):
        for at in range(c0, c1, MATCHES):
            right = slot_c[at : min(c1, at + MATCHES)]
            step = max(1, MATCHES // len(right))
            for i in range(a0, a1, step):
                left = slot_q[i : min(a1, i + step)]
                size = len(left) * len(right)
                if used + size > MATCHES:
                    yield buffer[:used]
                    used = 0
                np.add.outer(left, right, out=buffer[used : used + size].reshape(len(left), len(right)))
                used += size
    yield buffer[:used]


def _listed_hits(q: _Tile, c: _Tile, at_q: np.ndarray, at_c: np.ndarray) -> np.ndarray:
    """Of every pair how often its most frequent shift occurs, by a list of all matches."""
    shape = len(q.holds), len(c.holds)
    low, high = int(c.bar.min()) - int(q.bar.max()), int(c.bar.max()) - int(q.bar.min())
    width, n = high - low + 1, shape[0] * shape[1]
    slot_q, slot_c = q.row * (shape[1] * width) - q.bar - low, c.row * width + c.bar
    found = _matches(q, c, at_q, at_c, slot_q, slot_c)
    if n * width <= COUNTS:
        counts = np.zeros(n * width, np.int64)
        for slots in found:
            counts += np.bincount(slots, minlength=n * width)
        return counts.reshape(*shape, width).max(axis=2)
    slot, count, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    for slots in found:
        more, k = np.unique(slots, return_counts=True)
        slot, index = np.unique(np.concatenate([slot, more]), return_inverse=True)
        count = np.bincount(index, np.concatenate([count, k]), len(slot)).astype(np.int64)
    np.maximum.at(best, slot // width, count)
    return best.reshape(shape)


def _laid_hits(adds: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, grid: np.ndarray, width: int, shifts: int) -> np.ndarray:
    """Of ``rows`` rows and every column of a grid (kinds x bars and columns) how often the most frequent shift occurs.

    A cell adds the bars of its kind at its own offset, for all columns and shifts in one go. Counts are bytes; before they
    could run over they are added to larger ones.
    """
    row, kind, offset = adds
    part = np.arange(len(row)) - np.searchsorted(row, row)
    part //= LOOK
    order = np.lexsort((kind, part))  # a kind's bars are read for all rows at a time
    ends = np.searchsorted(part[order], np.arange(part.max() + 2 if len(part) else 1))
    columns = grid.shape[1] // width
    counts, larger, most = np.zeros((rows, shifts * columns), np.uint8), None, 0
    views, length = list(counts), grid.shape[1]
    for a, b in zip(ends[:-1], ends[1:]):
        if most + LOOK > 255:
            larger = counts.astype(np.uint32) if larger is None else larger + counts
            counts[:] = 0
        some = order[a:b]
        for r, k, at in zip(row[some].tolist(), kind[some].tolist(), (offset[some] * columns).tolist()):
            held = views[r][at : at + length]
            np.add(held, grid[k], out=held)
        most = int(counts.max())
    return (counts if larger is None else larger + counts).reshape(rows, shifts, columns).max(axis=1)


def _hits(q: _Side, c: _Side) -> Iterator[tuple[int, int, np.ndarray, Callable]]:
    """Hits of every pair at its best shift, tile by tile: the first row and column, the hits, and a function from places
    in the tile to how many kinds a pair has in common."""
    if not len(q.key) or not len(c.key):
        return
    kinds, id_c = np.unique(c.kind, return_inverse=True)
    id_q = np.searchsorted(kinds, q.kind)
    id_q[kinds[np.minimum(id_q, len(kinds) - 1)] != q.kind] = len(kinds)
    width, spread = int(c.bar.max()) - int(c.bar.min()) + 1, int(q.bar.max()) - int(q.bar.min())
    size, shifts = min(TILE_C, GRID // (len(kinds) * width), HELD // (width + spread)), width + spread
    n_q, n_c = np.bincount(id_q, minlength=len(kinds))[: len(kinds)], np.bincount(id_c, minlength=len(kinds))
    laid = int(n_q.sum()) * (CALL_NS * -(-len(c.key) // max(1, size)) + BYTE_NS * width * len(c.key)) + BYTE_NS * len(q.key) * len(c.key) * 3 * shifts
    if not size or laid > MATCH_NS * float(n_q.astype(float) @ n_c):
        songs = [_Tile(c, *at) for at in _tiles(c, TILE)]
        for at in _tiles(q, TILE):
            own = _Tile(q, *at)
            for song in songs:
                _, at_q, at_c = np.intersect1d(own.kinds, song.kinds, assume_unique=True, return_indices=True)
                yield own.at, song.at, _listed_hits(own, song, at_q, at_c), partial(_common, own.holds[:, at_q], song.holds[:, at_c])
        return
    group, high, low = max(1, min(64, HELD // (shifts * size))), int(q.bar.max()), int(c.bar.min())
    for a, b in _tiles(c, size):
        some = c.cells(a, b)
        used, kind = np.unique(id_c[some], return_inverse=True)
        place = np.full(len(kinds) + 1, -1)
        place[used] = np.arange(len(used))
        grid = np.zeros((len(used), width, b - a), np.uint8)
        grid[kind, c.bar[some] - low, c.row[some] - a] = 1
        grid, holds = grid.reshape(len(used), -1), np.ascontiguousarray(grid.max(axis=1).T)
        for x, y in _tiles(q, group):
            mine = q.cells(x, y)
            local = place[id_q[mine]]
            row, bar = q.row[mine][local >= 0] - x, q.bar[mine][local >= 0]
            local = local[local >= 0]
            own = np.zeros((y - x, len(used)), np.uint8)
            own[row, local] = 1
            yield x, a, _laid_hits((row, local, high - bar), y - x, grid, width, shifts), partial(_common, own, holds)


def _slide(q: _Side, i: int, c: _Side, songs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a row and some songs the most frequent shift (the smallest on a tie, 0 without a match) and how often it occurs."""
    mine, n = q.cells(i, i + 1), c.first[songs + 1] - c.first[songs]
    at = np.arange(n.sum()) + np.repeat(c.first[songs] - np.cumsum(n) + n, n)
    song, kind = np.repeat(np.arange(len(songs)), n), c.kind[at]
    low = np.searchsorted(q.kind[mine], kind)
    k = np.searchsorted(q.kind[mine], kind, "right") - low
    theirs, own = np.repeat(np.arange(len(at)), k), np.arange(k.sum()) + np.repeat(low - np.cumsum(k) + k, k)
    shift, song = c.bar[at][theirs] - q.bar[mine][own], song[theirs]
    best, where = np.zeros(len(songs), np.int64), np.zeros(len(songs), np.int64)
    if len(shift):
        least = int(shift.min())
        width = int(shift.max()) - least + 1
        slot = song * width + shift - least
        if len(songs) * width <= COUNTS:
            counts = np.bincount(slot, minlength=len(songs) * width).reshape(-1, width)
            best, where = counts.max(axis=1), counts.argmax(axis=1)
            return best, np.where(best > 0, where + least, 0)
        slot, count = np.unique(slot, return_counts=True)
        order = np.lexsort((slot, -count, slot // width))
        order = order[np.append(True, np.diff(slot[order] // width) != 0)]
        best[slot[order] // width], where[slot[order] // width] = count[order], slot[order] % width + least
    return best, where


class _Best:
    """Of every row the best partner so far: most hits, then the larger bag score, then the later place."""

    def __init__(self, side: _Side):
        self.side, n = side, len(side.key)
        self.hits, self.bag, self.at = np.zeros(n, np.int64), np.full(n, -1.0), np.full(n, -1)

    def see(self, first: int, other: int, hits: np.ndarray, common: Callable) -> None:
        """The hits of the rows from ``first`` on (down) with the partners from ``other`` on."""
        most = hits.max(axis=1)
        row = np.flatnonzero((most > 0) & (most >= self.hits[first : first + len(hits)]))
        i, j = np.nonzero(hits[row] == most[row, None])
        i = row[i]
        bag = common(i, j) / self.side.n_kinds[first + i]
        order = np.lexsort((j, bag, i))
        order = order[np.append(i[order][1:] != i[order][:-1], True)[: len(i)]]
        n, bag, at, place = most[i[order]], bag[order], other + j[order], first + i[order]
        tied = (bag > self.bag[place]) | ((bag == self.bag[place]) & (at > self.at[place]))
        better = (n > self.hits[place]) | tied
        place = place[better]
        self.hits[place], self.bag[place], self.at[place] = n[better], bag[better], at[better]

    def rows(self, other: _Side) -> pd.DataFrame:
        side, found = self.side, np.flatnonzero((self.at >= 0) & pd.notna(self.side.key))
        shift = np.array([_slide(side, i, other, self.at[i : i + 1])[1][0] for i in found], np.int64)
        return pd.DataFrame({
            "piece_id": side.key[found], "song": other.key[self.at[found]], "bag": self.bag[found], "hits": self.hits[found],
            "bar_offset": shift, "total": side.total[found],
        })


def _own_places(q: _Side, c: _Side) -> np.ndarray:
    """Where every row of one side is on the other; -1 where it is not."""
    at = {k: i for i, k in enumerate(c.key)}
    return np.array([at.get(k, -1) for k in q.key], np.int64)


def _nearest_bags(q: _Side, c: _Side, own: np.ndarray, k: int) -> pd.DataFrame:
    """The k partners of every row with the largest bag scores, later places first on a tie, with their hits."""
    songs, found = [_Tile(c, *at) for at in _tiles(c, TILE)], []
    for a, b in _tiles(q, TILE):
        mine, row, at, bag = _Tile(q, a, b), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.zeros(b - a)
        for song in songs:
            _, at_q, at_c = np.intersect1d(mine.kinds, song.kinds, assume_unique=True, return_indices=True)
            both = mine.holds[:, at_q].astype(np.float32) @ song.holds[:, at_c].T.astype(np.float32)
            score = both.astype(np.int64) / q.n_kinds[a:b, None]
            self_at = own[a:b] - song.at
            here = np.flatnonzero((self_at >= 0) & (self_at < len(song.holds)))
            score[here, self_at[here]] = -1
            if len(song.holds) > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero(score >= least[:, None])
            row, at, bag = np.append(row, i), np.append(at, song.at + j), np.append(bag, score[i, j])
            order = np.lexsort((-at, -bag, row))
            row, at, bag = row[order], at[order], bag[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at, bag = row[kept], at[kept], bag[kept]
            n = np.bincount(row, minlength=b - a)
            least[n == k] = bag[np.cumsum(n)[n == k] - 1]
        for i in np.unique(row[pd.notna(q.key[a + row])]):
            picked = row == i
            hits, shift = _slide(q, a + i, c, at[picked])
            found.append(pd.DataFrame({
                "piece_id": np.repeat(q.key[[a + i]], len(hits)), "song": c.key[at[picked]], "bag": bag[picked], "hits": hits,
                "bar_offset": shift, "total": q.total[a + i],
            }))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({k: [] for k in FOUND})


FOUND = ("piece_id", "song", "bag", "hits", "bar_offset", "total")


def _kernel(exclude_self: bool, top_k: int | None):
    """The best partners of a block's rows in another block. With ``mirrored`` also those of the other block's rows in the
    first one: a pair's hits are the same both ways."""

    def run(q: pd.DataFrame, c: pd.DataFrame, mirrored: bool = False) -> pd.DataFrame:
        asked, songs = _Side(q if mirrored else q[q["key"].notna()]), _Side(c)
        own = _own_places(asked, songs) if exclude_self else np.full(len(asked.key), -1)
        if top_k:
            return _nearest_bags(asked, songs, own, top_k)
        best, back = _Best(asked), _Best(songs)
        for x, a, hits, common in _hits(asked, songs):
            at = own[x : x + len(hits)] - a
            here = np.flatnonzero((at >= 0) & (at < hits.shape[1]))
            hits[here, at[here]] = 0
            best.see(x, a, hits, common)
            if mirrored:
                back.see(a, x, hits.T, lambda i, j: common(j, i))
        return pd.concat([best.rows(songs), *([back.rows(asked)] if mirrored else [])], ignore_index=True)

    return run


def corpus_overlap(gen: DataFrame, corpus: DataFrame, exclude_self: bool = True, top_k: int | None = None) -> DataFrame:
    """Best whole-piece alignment of every ``gen`` piece against every piece of ``corpus``.

    Ties go to the larger bag score, then the larger id. A piece without a partner has no song, no hits and overlap 0.
    ``top_k`` slides only so many pieces by bag score, as the original gate did.
    """
    g = shared(cells(gen))
    c = shared(cells(corpus))  # the same plan again reads the same cached cells
    kind = dict(corpus.dtypes)["piece_id"]
    schema = f"piece_id {kind}, song {kind}, bag double, hits long, bar_offset long, total long"
    if gen is corpus and exclude_self and not top_k:
        per_block = block_pairs_within(g, _kernel(exclude_self, None), schema)
    else:
        per_block = block_pairs(g, c, _kernel(exclude_self, top_k), schema)
    w = W.partitionBy("piece_id")
    if top_k:
        kept = per_block.withColumn("_r", F.row_number().over(w.orderBy(F.desc("bag"), F.desc("song")))).filter(F.col("_r") <= top_k)
    else:
        kept = per_block
    best = kept.withColumn("_b", F.row_number().over(w.orderBy(F.desc("hits"), F.desc("bag"), F.desc("song")))).filter("_b = 1")
    partnered = best.select("piece_id", F.when(F.col("hits") > 0, F.col("song")).alias("song"), "hits", "bar_offset")
    every = g.select(F.col("key").alias("piece_id"), "total").join(partnered, "piece_id", "left").fillna({"hits": 0, "bar_offset": 0})
    return every.select("piece_id", "song", "hits", "total", "bar_offset", (F.col("hits") / F.col("total")).alias("overlap"))


def copy_risk(gen: DataFrame, corpus: DataFrame, threshold: float = STRICT, exclude_self: bool = True, top_k: int | None = None) -> DataFrame:
    return corpus_overlap(gen, corpus, exclude_self, top_k).select(
        "piece_id", "song", F.round("overlap", 3).alias("copy_risk"), (F.col("overlap") < threshold).alias("passed")
    )


def case_overlap(gen: DataFrame, ref: DataFrame, case: str = "piece_id") -> DataFrame:
    """Aligned (offset 0) and best slid overlap of two note sets that share a case id.

    Cells are distinct first, so a case expands to at most bars x bars rows per note kind.
    """
    g = gen.select(case, note_key().alias("k"), F.col("bar").alias("gb")).distinct()
    r = ref.select(case, note_key().alias("k"), F.col("bar").alias("rb")).distinct()
    total = gen.groupBy(case).agg(F.count(F.lit(1)).alias("total"))
    at = g.join(r, [case, "k"]).groupBy(case, (F.col("rb") - F.col("gb")).alias("bar_offset")).agg(F.count(F.lit(1)).alias("hits"))
    best = at.groupBy(case).agg(
        F.max("hits").alias("slid"), F.max(F.when(F.col("bar_offset") == 0, F.col("hits"))).alias("aligned")
    )
    return total.join(best, case, "left").select(
        case,
        "total",
        (F.coalesce("aligned", F.lit(0)) / F.col("total")).alias("overlap_aligned"),
        (F.coalesce("slid", F.lit(0)) / F.col("total")).alias("overlap_slid"),
    )


def channel_check(gen: DataFrame, real: DataFrame, ctx: DataFrame, case: str = "piece_id") -> DataFrame:
    """How much of the overlap with the held-out answer the visible context explains."""
    g = gen.select(case, "bar", note_key().alias("k")).distinct()
    overlap = g.join(real.select(case, "bar", note_key().alias("k")).distinct(), [case, "bar", "k"])
    explained = overlap.join(ctx.select(case, note_key().alias("k")).distinct(), [case, "k"], "left_semi")
    n = g.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    o = overlap.groupBy(case).agg(F.count(F.lit(1)).alias("n_overlap"))
    e = explained.groupBy(case).agg(F.count(F.lit(1)).alias("n_explained"))
    df = n.join(o, case, "left").join(e, case, "left").fillna({"n_overlap": 0, "n_explained": 0})
    rate = F.col("n_overlap") / F.col("n")
    innocent = F.when(F.col("n_overlap") > 0, F.col("n_explained") / F.col("n_overlap")).otherwise(F.lit(1.0))
    return df.select(
        case, "n", "n_overlap", rate.alias("rate"), innocent.alias("innocent"),
        ((1 - innocent > 0.10) & (rate >= 0.20)).alias("leak"),
    )
