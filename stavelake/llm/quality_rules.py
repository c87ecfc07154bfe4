"""Quality rules by compression bands.

Text that repeats itself compresses too well, noise does not compress at all. Each document is compressed with
Zstandard as a whole and in fixed chunks; the ratio (compressed / raw bytes) must lie in the band of its length class,
and no more than a given share of the chunks may leave the chunk band. Base rules on word counts and repeated
three-word windows come first.

Defined results: null and empty texts have no words and fail the base rules; very long texts are compressed as a whole,
one at a time; ties and repeated rows are judged row by row; an empty table gives an empty result. The operator is a
column expression, so other columns, whatever their names, are never touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import utf8

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits. ``bands``: (least bytes, lowest ratio, highest ratio) by ascending length; shorter texts have no band."""

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk: int = 4096
    bands: tuple[tuple[int, float, float], ...] = (
        (128, 0.35, 1.10),
        (256, 0.35, 0.95),
        (512, 0.30, 0.85),
        (1024, 0.28, 0.80),
        (2048, 0.25, 0.75),
        (4096, 0.22, 0.72),
        (8192, 0.20, 0.70),
        (1 << 20, 0.12, 0.70),
    )
    chunk_band: tuple[float, float] = (0.22, 0.75)
    max_bad_chunk_share: float = 0.34

    def band(self, n_bytes: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for least, low, high in self.bands:
            if n_bytes >= least:
                found = (low, high)
        return found


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice, first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(starts)] |= starts
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def chunk_ratios(data: bytes, size: int, compress) -> list[float]:
    """Ratios of the fixed chunks; a tail shorter than half a chunk belongs to no chunk."""
    cuts = range(0, len(data), size)
    parts = [data[i : i + size] for i in cuts]
    return [len(compress(p)) / len(p) for p in parts if 2 * len(p) >= size]


def judge(data: bytes, rules: Rules, compress) -> tuple:
    words = data.split()
    n = len(words)
    continuation = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    n_repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
    ratio = len(compress(data)) / len(data) if data else None
    chunks = chunk_ratios(data, rules.chunk, compress)
    low, high = rules.chunk_band
    bad = sum(not low <= r <= high for r in chunks)
    kept = not failed
    if kept:
        low, high = rules.band(len(data))
        kept = low <= ratio <= high and bad <= rules.max_bad_chunk_share * len(chunks)
    return (
        n, sum(map(len, words)) - continuation, sum(map(data.count, (bytes([c]) for c in SYMBOLS))), repeated_lines(data),
        n_repeat, failed, ratio, len(chunks), bad, kept,
    )


def verdict(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of counts, ratios and ``kept`` for a text column."""
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            yield pd.DataFrame([judge(data, rules, compress) for data in batch], columns=names)

    return measured(utf8(text))


def filtered(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    return docs.where(verdict(docs[text], rules)["kept"])
