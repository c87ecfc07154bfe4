"""Periodic runs in word sequences, found by recompression.

A run is a stretch of words with smallest period q, at least ``max(least, exponent * q)`` long, that cannot be extended.
Texts are gathered until they hold about ``CHUNK`` words, with separators between them, and recompressed: block
compression replaces every maximal repetition of one symbol by a symbol for (symbol, length), pair compression parts the
alphabet in two and replaces every left symbol followed by a right one, in turns, until little is left. Names are exact
(equal name, equal expansion), and whether two neighbours are joined depends on these two alone, so equal stretches are
parsed equally but for their edges. That makes longest common extensions cheap: a query climbs while both places are
boundaries of the next level and the symbols agree, and where symbols differ descends again, with at most one step and
one jump over a block per level. All queries of a chunk go level by level together.

Candidates lie on harmonic grids: for each period p up to a quarter of the text (``1 / exponent``), places
``(exponent - 1) * p`` apart; a run with period p holds one of them and its partner p words on. Their extensions to both
sides are the runs of period p; of those with equal ends the smallest period stays. In total n log n candidates, in
bounded slices.

Defined results: null and empty texts have no run and collapse to the empty string; very long texts are a chunk of their
own and are searched whole; texts with fewer than ``least`` words have no run; ties and repeated rows are searched row by
row; an empty table gives an empty result. The operator is a column expression, so other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stavelake.llm.common import utf8

CHUNK, SLICE = 1 << 18, 1 << 20
_SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Level:
    """Symbols, and how they form those of the next level: where each of these starts, or -1; block ends if blocks."""

    symbols: np.ndarray
    start: np.ndarray | None = None
    up: np.ndarray | None = None
    stop: np.ndarray | None = None

    def mirrored(self) -> Level:
        """The same level read backwards."""
        if self.start is None:
            return Level(self.symbols[::-1])
        m, k = len(self.symbols), len(self.start) - 1
        up = np.where(self.up >= 0, k - self.up, -1)[::-1]
        stop = None
        if self.stop is not None:
            first = self.start[np.searchsorted(self.start, np.arange(m), "right") - 1]
            stop = (m - first)[::-1]
        return Level(self.symbols[::-1], (m - self.start)[::-1], up, stop)

    def remaining(self, at: np.ndarray) -> np.ndarray:
        """How many equal symbols follow, itself included: to the block's end, or this one of a pair."""
        return 1 if self.stop is None else self.stop[at] - at


def compressed(symbols: np.ndarray, n_edges: int) -> list[Level]:
    """The levels of a sequence whose symbols below ``n_edges`` are separators, each once."""
    levels, fresh, turn = [], int(symbols.max()) + 1, 0
    while True:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(starts) < len(symbols):
            length = np.diff(np.append(starts, len(symbols)))
            new = symbols[starts]
            many = length > 1
            fresh = _named(new, many, new[many], length[many], fresh)
            levels.append(_level(symbols, starts, np.repeat(starts + length, length)))
            symbols = new
        if len(symbols) <= 3 * n_edges or turn > 256:
            return [*levels, Level(symbols)]
        turn += 1
        mixed = symbols.astype(np.uint64) * np.uint64(_SPREAD + 2 * turn)
        side = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_SPREAD) >> np.uint64(63) == 1
        inner = symbols >= n_edges
        both = inner[:-1] & inner[1:]
        joined = max((side[:-1] & ~side[1:] & both, ~side[:-1] & side[1:] & both), key=np.count_nonzero)
        if not joined.any():
            continue
        starts = np.flatnonzero(np.append(True, ~joined))
        new, paired = symbols[starts], np.append(joined, False)[starts]
        fresh = _named(new, paired, new[paired], symbols[starts[paired] + 1], fresh)
        levels.append(_level(symbols, starts, None))
        symbols = new


def _named(new: np.ndarray, where: np.ndarray, a: np.ndarray, b: np.ndarray, fresh: int) -> int:
    """Give equal (a, b) equal fresh names, put at ``where``; the next free name."""
    found, name = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
    new[where] = fresh + name
    return fresh + len(found)


def _level(symbols: np.ndarray, starts: np.ndarray, stop: np.ndarray | None) -> Level:
    up = np.full(len(symbols) + 1, -1)
    up[starts], up[-1] = np.arange(len(starts)), len(starts)
    return Level(symbols, np.append(starts, len(symbols)), up, stop)


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree from the places x and y on, each pair between its separators."""
    x0, x, y = x, x.copy(), y.copy()
    asking, ended = np.arange(len(x)), []
    for level in levels[:-1]:
        a, b = x[asking], y[asking]
        same = level.symbols[a] == level.symbols[b]
        ended.append(asking[~same])
        asking, a, b = asking[same], a[same], b[same]
        inside = (level.up[a] < 0) | (level.up[b] < 0)
        rows, a, b = asking[inside], a[inside], b[inside]
        ahead, behind = level.remaining(a), level.remaining(b)
        by = np.minimum(ahead, behind)
        x[rows], y[rows] = a + by, b + by
        if level.stop is not None:
            ended.append(rows[ahead != behind])
            keep = np.ones(len(asking), bool)
            keep[np.flatnonzero(inside)[ahead != behind]] = False
            asking = asking[keep]
        else:
            ended.append(asking[:0])
        x[asking], y[asking] = level.up[x[asking]], level.up[y[asking]]
        ended[-2:] = [np.concatenate(ended[-2:])]
    top = levels[-1].symbols
    going = asking
    while len(going):
        going = going[top[x[going]] == top[y[going]]]
        x[going] += 1
        y[going] += 1
    for level, more in zip(reversed(levels[:-1]), reversed(ended)):
        a, b = level.start[x[asking]], level.start[y[asking]]
        by = np.where(level.symbols[a] == level.symbols[b], np.minimum(level.remaining(a), level.remaining(b)), 0)
        x[asking], y[asking] = a + by, b + by
        asking = np.concatenate([asking, more])
    return x - x0


def candidates(first: np.ndarray, n: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods on the grids of texts that start at ``first`` and have ``n`` words, in slices."""
    periods = n // exponent
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (exponent - 1) * period
    count = (n[text] - period - 1) // step + 1
    ends, at = np.cumsum(count), 0
    while at < len(count):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        k = count[at:to]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(first[text[at:to]], k) + place * np.repeat(step[at:to], k), np.repeat(period[at:to], k)
        at = to


def runs(texts: list[list[bytes]], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of every run, by text, start and period."""
    n = np.array([len(words) for words in texts], np.int64)
    first = 1 + np.cumsum(n + 1) - (n + 1)
    names: dict[bytes, int] = {}
    symbols = np.zeros(int(n.sum()) + len(n) + 1, np.int64)
    edges = len(n) + 1
    for at, words in zip(first, texts):
        symbols[at : at + len(words)] = [names.setdefault(w, len(names)) for w in words]
    symbols += edges
    symbols[np.append(0, first + n)] = np.arange(edges)
    found: list[np.ndarray] = []
    forward = backward = None
    long_enough = n >= least
    for place, period in candidates(first[long_enough], n[long_enough], exponent):
        hit = symbols[place] == symbols[place + period]
        place, period = place[hit], period[hit]
        if not len(place):
            continue
        if forward is None:
            forward = compressed(symbols, edges)
            backward = [level.mirrored() for level in forward]
        after = extensions(forward, place, place + period)
        m = len(symbols)
        before = extensions(backward, m - place - period, m - place)
        length = before + period + after
        fits = length >= np.maximum(least, exponent * period)
        start = (place - before)[fits]
        found.append(np.unique(np.stack([start, start + length[fits], period[fits]]), axis=1))
    start, stop, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(start)]
    start, stop, period = start[smallest], stop[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    text = np.searchsorted(first, start, "right") - 1
    return text, start - first[text], stop - start, period


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words outside all but the first period of each run, joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([w for w, inside in zip(words, np.cumsum(edge).tolist()) if not inside])


def _searched(batch: list[bytes], least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    texts = [data.split() for data in batch]
    text, start, length, period = runs(texts, least, exponent)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    for words, a, b in zip(texts, cuts, cuts[1:]):
        kept = collapsed(words, start[a:b], length[a:b], period[a:b]) if b > a else b" ".join(words)
        yield start[a:b], length[a:b], period[a:b], kept.decode()


def _chunks(batch: pd.Series) -> Iterator[list[bytes]]:
    """Consecutive texts of about CHUNK words (six bytes each)."""
    held, size = [], 0
    for data in batch:
        if held and size + len(data) > 6 * CHUNK:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def searched(text: Column, least: int = 6, exponent: int = 4) -> Column:
    """A struct of ``runs`` (array of start, length, period, by start and period) and ``collapsed`` for a text column."""
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")

    @F.pandas_udf("start array<long>, length array<long>, period array<long>, collapsed string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for chunk in _chunks(batch) for row in _searched(chunk, least, exponent)]
            yield pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])

    return made(utf8(text))


def zipped(found: Column) -> Column:
    """The runs of ``searched`` as an array of structs."""
    return F.arrays_zip(found["start"].alias("start"), found["length"].alias("length"), found["period"].alias("period"))


def strongest(runs: Column) -> Column:
    """Of an array of runs by start and period, the first with the greatest exact length / period; null if there is none."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))
