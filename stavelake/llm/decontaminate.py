"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased; shingles are five words. Every benchmark item gets a SimHash of its
shingles. A document's windows of as many shingles as an item has, at every offset, get theirs from running sums of bits;
for an item longer than the document the whole document is the one window.
Four 16-bit blocks index the item fingerprints: if two fingerprints differ in at most ``RADIUS`` = 15 bits, one of the
blocks differs in at most three, and every value within three bits of an item's block is listed, so the lookup returns
each item within the radius. Candidates are then verified by the exact weighted similarity of window and item (sum of the
lesser over sum of the greater multiplicities), which must reach 0.8. Two texts of that similarity differ in about 10 of 64
bits, at times in more than the radius, so the items that share enough shingles with a window are candidates as well and
no match is lost.

Windows with too few shingles of any items to reach 0.8 with one are not fingerprinted; that prunes no match. The
benchmark is taken in blocks of ``ITEMS`` items, each indexed and broadcast (some 16 MB at most) and run over all documents; documents are
never shuffled and each is judged on its own row, whole.

Defined results: null and empty texts and items match nothing; a text or item shorter than five words is one shingle and
matches only an equal one; an item that occurs repeatedly in a document is reported once, at its best (then first) place;
repeated documents are reported alike; empty tables give no match. Only the text column of the documents is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import utf8

WORDS, RADIUS, BLOCKS, ITEMS = 5, 15, 4, 1024
MIN_SIMILARITY = 0.8
HITS = "array<struct<item_id:bigint,start_word:int,n_words:int,distance:int,similarity:double>>"
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


_PLACES = 1 << 16
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PLACES - 1, 0xD1342543DE82EF95, np.uint64)]), dtype=np.uint64)
_LETTERS = np.random.default_rng(2).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per word, polynomial in its bytes; computed for all words of a text at once."""
    letters = np.frombuffer(data.decode("utf-8", "replace").lower().encode().translate(_TABLE), np.uint8)
    in_word = letters != 32
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    own = letters[in_word]
    if not len(own):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(begins[in_word])
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return np.add.reduceat(_LETTERS[own] * _POWERS[place & (_PLACES - 1)], first)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of the whole sequence if it is shorter; none if it is empty."""
    width = min(WORDS, len(words))
    if not width:
        return words
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ words[k : len(words) - width + 1 + k]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Row i: how often each bit is set in the first i hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def window_prints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles."""
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1).view(np.uint64).ravel()


def within(value: int, distance: int) -> Iterator[int]:
    """All 16-bit values that differ from ``value`` in at most ``distance`` bits."""
    for n in range(distance + 1):
        for bits in combinations(range(16), n):
            yield value ^ sum(1 << b for b in bits)


class Index:
    """Items by the neighbourhood of their fingerprint blocks, and their shingles."""

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        found = []
        for item_id, data in items:
            hashed = shingles(word_hashes(data))
            if len(hashed):
                found.append((item_id, hashed))
        self.ids = [item_id for item_id, _ in found]
        self.counts = [Counter(h.tolist()) for _, h in found]
        self.sizes = np.array([len(h) for _, h in found], np.int64)
        self.prints = np.array([window_prints(running_bits(h), len(h))[0] for _, h in found], np.uint64)
        self.owners: dict[int, list[int]] = {}
        for item, held in enumerate(self.counts):
            for h in held:
                self.owners.setdefault(h, []).append(item)
        self.shingles = np.unique(np.concatenate([h for _, h in found])) if found else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.shingles >> np.uint64(64 - _FILTER_BITS)] = True
        near = sorted(
            (block << 16 | value, item)
            for item, print_ in enumerate(self.prints.tolist())
            for block in range(BLOCKS)
            for value in within(print_ >> 16 * block & 0xFFFF, RADIUS // BLOCKS)
        )
        self.items = np.array([item for _, item in near], np.int32)
        self.offsets = np.searchsorted(np.array([key for key, _ in near], np.int64), np.arange((BLOCKS << 16) + 1))
        #: Per block value, the item sizes (modulo 64) that are listed there.
        self.listed = np.zeros(BLOCKS << 16, np.uint64)
        keys = np.array([key for key, _ in near], np.int64)
        np.bitwise_or.at(self.listed, keys, np.uint64(1) << (self.sizes[self.items] % 64).astype(np.uint64))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of an item."""
        out = self.filter[hashes >> np.uint64(64 - _FILTER_BITS)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.searchsorted(self.shingles, hashes[maybe])
            out[maybe] = self.shingles[np.minimum(at, len(self.shingles) - 1)] == hashes[maybe]
        return out

    def candidates(self, prints: np.ndarray, size: int) -> set[tuple[int, int, int]]:
        """(window, item, distance) of items of that size within the radius."""
        found: set[tuple[int, int, int]] = set()
        wanted = np.uint64(1) << np.uint64(size % 64)
        for block in range(BLOCKS):
            keys = (prints >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64) | block << 16
            some = np.flatnonzero(self.listed[keys] & wanted)
            low, count = self.offsets[keys[some]], self.offsets[keys[some] + 1] - self.offsets[keys[some]]
            window = np.repeat(some, count)
            item = self.items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            distance = np.bitwise_count(prints[window] ^ self.prints[item])
            fits = (self.sizes[item] == size) & (distance <= RADIUS)
            found.update(zip(window[fits].tolist(), item[fits].tolist(), distance[fits].tolist()))
        return found

    def hits(self, words: np.ndarray) -> list[tuple]:
        hashed = shingles(words)
        if not len(hashed) or not len(self.ids):
            return []
        known = self.known(hashed)
        at = np.flatnonzero(known)
        if not len(at):
            return []
        best: dict[int, tuple] = {}
        longest = int(self.sizes.max())
        for part in np.split(at, np.flatnonzero(np.diff(at) > longest) + 1):
            begin, end = max(0, int(part[0]) - longest + 1), min(len(hashed), int(part[-1]) + longest)
            self._search(hashed[begin:end], known[begin:end], begin, best)
        self._search_whole(hashed, len(at), best)
        n = min(WORDS, len(words)) - 1
        return [
            (self.ids[item], -minus_start, min(int(self.sizes[item]), len(hashed)) + n, distance, similarity)
            for item, (similarity, minus_start, distance) in sorted(best.items())
        ]

    def _search(self, hashed: np.ndarray, known: np.ndarray, begin: int, best: dict[int, tuple]) -> None:
        sums, seen = running_bits(hashed), np.concatenate([[0], np.cumsum(known)])
        for size in np.unique(self.sizes[self.sizes <= len(hashed)]).tolist():
            # a window with fewer known shingles is below the limit, whatever the item
            holds = np.flatnonzero((seen[size:] - seen[:-size]) * (1 + MIN_SIMILARITY) >= 2 * MIN_SIMILARITY * size - 1e-9)
            if not len(holds):
                continue
            prints = window_prints(sums, size)[holds]
            pairs = {(window, item) for window, item, _ in self.candidates(prints, size)}
            for window, start in enumerate(holds.tolist()):
                shared = hashed[start : start + size].tolist()
                pairs.update((window, item) for item in self.sharing(shared) if self.sizes[item] == size)
            for window, item in pairs:
                self._verify(hashed[int(holds[window]) :][:size], begin + int(holds[window]), prints[window], item, best)

    def _search_whole(self, hashed: np.ndarray, n_known: int, best: dict[int, tuple]) -> None:
        """A document that is shorter than an item is one window, all of it."""
        n = len(hashed)
        longer = np.flatnonzero((self.sizes > n) & (n >= MIN_SIMILARITY * self.sizes - 1e-9))
        longer = longer[n_known * (1 + MIN_SIMILARITY) >= MIN_SIMILARITY * (n + self.sizes[longer]) - 1e-9]
        if not len(longer):
            return
        print_ = window_prints(running_bits(hashed), n)[0]
        for item in longer.tolist():
            self._verify(hashed, 0, print_, item, best)

    def sharing(self, window: list[int]) -> list[int]:
        """Items of which the window holds enough shingles for the limit, if they are as long as the window."""
        held = Counter(item for h in window for item in self.owners.get(h, ()))
        return [item for item, n in held.items() if n * (1 + MIN_SIMILARITY) >= 2 * MIN_SIMILARITY * len(window) - 1e-9]

    def _verify(self, window: np.ndarray, start: int, print_: np.uint64, item: int, best: dict[int, tuple]) -> None:
        similarity = self._similarity(window.tolist(), item)
        if similarity >= MIN_SIMILARITY:
            distance = int(np.bitwise_count(print_ ^ self.prints[item]))
            best[item] = max(best.get(item, (0.0, 0, 0)), (similarity, -start, distance))

    def _similarity(self, window: list[int], item: int) -> float:
        mine, its = Counter(window), self.counts[item]
        shared = sum(min(n, its[h]) for h, n in mine.items() if h in its)
        return shared / (len(window) + int(self.sizes[item]) - shared)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark's items, at most about ITEMS at a time."""
    rows = benchmark.select("item_id", utf8(benchmark["text"]).alias("data")).distinct()
    n = max(1, -(-rows.count() // ITEMS))
    for block in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "data"), F.lit(n)) == block).collect()
        yield sorted(((r["item_id"], bytes(r["data"])) for r in some), key=lambda r: (r[0] is None, r))


def hit_columns(text: Column, benchmark: DataFrame) -> list[Column]:
    """One array of hits per block of the benchmark."""
    context = benchmark.sparkSession.sparkContext

    def column(items: list) -> Column:
        shared = context.broadcast(Index(items))

        @F.pandas_udf(HITS)
        def searched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value
            fields = ("item_id", "start_word", "n_words", "distance", "similarity")
            for batch in batches:
                yield pd.Series([[dict(zip(fields, hit)) for hit in index.hits(word_hashes(data))] for data in batch], dtype=object)

        return searched(utf8(text))

    return [column(items) for items in blocks(benchmark)]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity per document and item that it leaks."""
    found = [docs.select(docs["doc_id"], F.explode(c).alias("hit")).select("doc_id", "hit.*") for c in hit_columns(docs["text"], benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their columns as they were."""
    out = docs
    for column in hit_columns(docs["text"], benchmark):
        out = out.where(F.size(column) == 0)
    return out
