"""Byte-pair encoding and decoding with a given vocabulary file.

A text is cut at special tokens, normalized (NFC, white space runs to one space, lower case), split into words, and each
word's bytes become the symbols of a doubly linked list. A priority queue holds the ranks of the merges that are possible
between neighbours; the lowest rank, leftmost first, is merged and its new neighbours are queued, while entries whose
symbols have changed since are stale and skipped. So a word of n bytes costs n log n, however long it is. Decoding joins
the vocabulary's strings of the ids, by the space that such files imply when they name no decoder.

The driver reads the vocabulary (refused beyond ``MOST_BYTES``) and broadcasts it; executors need no file. Each Python
worker remembers at most ``REMEMBERED`` words of up to ``SHORT`` characters (some 100 MB); that only saves repeating a word's merges.

Ids travel packed, as little-endian unsigned 32-bit integers, the form in which token corpora are stored; ``unpacked``
gives an array.

Defined results: a null or empty text has no ids and decodes to the empty string; null ids decode to the empty string;
very long texts and words are encoded whole; ties and repeated rows are encoded row by row; an empty table gives an empty
result. The operator is a column expression, so other columns, whatever their names, are never touched. Strings of
special tokens inside a text become those tokens, as the public library has it.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

MOST_BYTES = 1 << 26
REMEMBERED, SHORT = 1 << 17, 64
#: Rows that ``recoded`` sends back at a time.
ROWS = 256
#: A pair of ids is one number: the first id shifted by so many bits, and the second.
BITS = 32
#: The front end that this module implements, as vocabulary files describe it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and strings of a vocabulary file's text; unsupported files are refused."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        split, mapped = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else (None, None)
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = spec["normalizer"] == NORMALIZER and split and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
        if model["type"] != "BPE" or not plain or not known or mapped != BYTES or spec["decoder"] or spec["post_processor"]:
            raise ValueError("only plain byte-pair vocabularies with a removing split, byte symbols and no decoder are supported")
        special = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("only special tokens that match as they stand are supported")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.source, self.pattern = source, split["pattern"]["Regex"]
        self.ranks = {ids[a] << BITS | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.inner = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + end] for s in byte_symbols()]
        self.special = {t["content"]: t["id"] for t in special}
        by_id = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"a vocabulary file may have at most {MOST_BYTES} bytes: it is broadcast")
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def __getstate__(self) -> str:
        return self.source

    def __setstate__(self, source: str) -> None:
        self.__init__(source)

    @cached_property
    def words(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    @cached_property
    def cuts(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    @cached_property
    def by_word(self) -> _Memory:
        return _Memory(lambda word: _packed(self.merged(word)))

    @cached_property
    def by_stretch(self) -> _Memory:
        return _Memory(lambda stretch: b"".join(map(self.by_word.__getitem__, self.words.findall(stretch))))

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.source)

    def merged(self, word: str) -> list[int]:
        """The ids of one word. Queue entries are rank * n + place, so that equal ranks come leftmost first."""
        data = word.encode()
        n, ranks = len(data), self.ranks
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found = [ranks.get(a << BITS | b) for a, b in zip(symbols, symbols[1:])]
        queue = [rank * n + at for at, rank in enumerate(found) if rank is not None]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            follower = after[at]
            if follower < 0 or ranks.get(symbols[at] << BITS | symbols[follower]) != rank:
                continue  # stale: one of the two was merged meanwhile
            made = self.made[rank]
            symbols[at], symbols[follower] = made, -1
            after[at] = follower = after[follower]
            if follower >= 0:
                before[follower] = at
                rank = ranks.get(made << BITS | symbols[follower])
                if rank is not None:
                    heapq.heappush(queue, rank * n + at)
            leader = before[at]
            if leader >= 0:
                rank = ranks.get(symbols[leader] << BITS | made)
                if rank is not None:
                    heapq.heappush(queue, rank * n + leader)
        return [s for s in symbols if s >= 0]

    def plain(self, text: str) -> bytes:
        """The packed ids of a text without special tokens. No word holds a space, so it is taken from space to space."""
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return b"".join(map(self.by_word.__getitem__, self._split_unassigned(text)))
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
        return b"".join(map(self.by_stretch.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def _split_unassigned(self, text: str) -> list[str]:
        """The words of a text with code points that this Python's Unicode tables lack: the library's tables decide."""
        normal = self.library.normalizer.normalize_str(text)
        places = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [normal[a:b] for a, b in places]

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if not self.special:
            return self.plain(text)
        parts = self.cuts.split(text)
        return b"".join([_packed([self.special[p]]) if p in self.special else self.plain(p) for p in parts if p])

    def decode(self, packed: bytes) -> str:
        """The vocabulary's strings of packed ids, joined."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """Packed ids by string, computed when first asked for. What has not been asked for in a generation is forgotten."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.before.pop(key, None)
        if packed is None:
            packed = self.compute(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = packed
        return packed


def shared(spark: SparkSession, path: str) -> Broadcast[Vocabulary]:
    """The vocabulary at ``path`` on the driver, for use in many queries of a session."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


def encode(text: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """The packed ids of a text column."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([vocabulary.value.encode(t) for t in batch], dtype=object)

    return encoded(F.coalesce(text, F.lit("")))


def decode(ids: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """The text that packed ids stand for."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([vocabulary.value.decode(i) for i in batch], dtype=object)

    return decoded(F.coalesce(ids, F.lit(bytearray())))


def recoded(docs: DataFrame, vocabulary: Broadcast[Vocabulary], keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, packed ``ids`` and the text ``decoded`` from these, in one pass that sends few rows at a time."""
    rows = docs.select(*(docs[c] for c in keep), F.coalesce(docs[text], F.lit("")))
    schema = StructType([*rows.schema.fields[:-1], StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                *own, texts = batch.slice(at, ROWS).columns
                ids = [vocabulary.value.encode(t) for t in texts.to_pylist()]
                decoded = pa.array([vocabulary.value.decode(i) for i in ids], pa.string())
                yield pa.record_batch([*own, pa.array(ids, pa.binary()), decoded], schema.names)

    return rows.mapInArrow(made, schema)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""

    @F.pandas_udf("array<long>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.frombuffer(i, "<u4").astype(np.int64) for i in batch], dtype=object)

    return listed(F.coalesce(ids, F.lit(bytearray())))


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
