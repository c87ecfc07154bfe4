"""Exact removal of repeated 100-byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: a trigger is the position whose 8-byte hash is the least among
``SPAN`` successive positions, so equal 100-byte strings always have the same trigger at the same relative place, and
every start position belongs to the phrase of exactly one trigger. The dictionary is the set of distinct phrases with
their right context, the parse is the list of their occurrences. Suffixes are put into order only as far as the question
needs, 100 bytes, and by hashes, as only equality and corpus order (doc_id, then offset) matter:

1. Occurrences are grouped by right context (the bytes every suffix of the phrase continues with) and, within it, by the
   whole phrase. All but the first occurrence of a phrase in its context repeat it, so all their suffixes do: a repeated
   text is settled phrase by phrase.
2. Where one right context has several phrases (around edits and at the ends of copied passages), the suffixes of those
   phrases are themselves grouped by their 100 bytes, and all but the first in corpus order repeat.

Groups meet in buckets of packed arrays. Each task first settles what it sees itself and sends each phrase, or suffix, at
most once, so neither a passage in a third of all documents nor a run of equal bytes makes a bucket large; right contexts
with very many phrases in one task are sent as a mark. Keys are 96 bits besides the bucket for phrases and 80 for suffixes.

Defined results: null reads as empty; texts shorter than 100 bytes are kept whole; very long texts are parsed in
segments (which may cut a phrase in two; step 2 then settles it); texts are bytes, so kept bytes need not be UTF-8; among
rows of equal doc_id different texts are ordered by a hash, equal ones are one text and never sources of each other; null
doc_ids come first; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import pieces, scratch, text_bytes, utf8

LENGTH, SPAN, GRAM = 100, 64, 8
RIGHT = LENGTH - SPAN + 1
SEGMENT = 1 << 19
FLUSH = 1 << 20
#: Phrases of one right context that a task sends; beyond it, it sends a mark and leaves them to step 2.
MOST_PHRASES = 16
REPEATED, OPEN = 0, 1
NO_ID = -(1 << 63)
_RANGES = "doc long, seq int, start int, stop int, kind byte"
_ARROW_RANGES = pa.schema([("doc", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int8())])
_PACKED = "bucket int, settled boolean, payload binary"
_ARROW_PACKED = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("payload", pa.binary())])
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW48, _LOW32 = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1)


class Hashes:
    """Polynomial hashes of substrings from running sums, modulo 2^64, over randomly numbered letters."""

    def __init__(self, base: int, seed: int) -> None:
        n = SEGMENT + 2 * LENGTH
        self.up, self.down = self._powers(base, n), self._powers(pow(base, -1, 1 << 64), n)
        self.letters = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ value >> np.uint64(32)) * _ODD
    return value ^ value >> np.uint64(29)


_hashers: list[Hashes] = []


def hashers() -> list[Hashes]:
    if not _hashers:
        _hashers.extend([Hashes(0xD1342543DE82EF95, 11), Hashes(0xAF251AF3B0F025B5, 12)])
    return _hashers


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offsets and bytes of the segments of a text; each holds the whole strings of its start positions."""
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + LENGTH - 1]


def triggers(data: bytes) -> np.ndarray:
    """For each start position of a 100-byte string, its trigger: where the least hash of SPAN positions is (the first, on ties)."""
    n = len(data) - LENGTH + SPAN
    grams = np.ndarray((n,), "<u8", buffer=data, strides=(1,)) * _ODD
    least = mix(grams) & ~_PLACE | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & _PLACE).astype(np.int64)


def phrases(data: bytes) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, hash of the right context, hash of the phrase in its context) per phrase."""
    trigger = triggers(data)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    last = np.append(first[1:], len(trigger)) - 1
    at = trigger[first]
    hasher = hashers()[0]
    sums = hasher.sums(np.frombuffer(data, np.uint8))
    shape = ((at - first) << 8 | (last - first)).astype(np.uint64)
    whole = mix(hasher.of(sums, first, last + LENGTH) ^ shape * _ODD)
    return first, last - first + 1, hasher.of(sums, at, at + RIGHT), whole


class Occurrences:
    """Arrays of (group, member, doc, seq, start, n) that grow until they are taken."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group, member, doc: int, seq: int, start, n) -> None:
        count = len(group)
        self.parts.append((group, member, np.full(count, doc, np.int64), np.full(count, seq, np.int32), start.astype(np.int32), n.astype(np.uint8)))
        self.size += count

    def take(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        return columns


def pack(columns: tuple[np.ndarray, ...]) -> bytes:
    """Columns as byte planes, the doc ids as differences, compressed."""
    planes = []
    for i, column in enumerate(columns):
        if column.dtype == np.int64:
            column = np.diff(column, prepend=np.int64(0))
        planes.append(np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes, types: tuple) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(types, widths):
        column = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel()
        out.append(np.cumsum(column) if kind is np.int64 else column)
        at += n * width
    return tuple(out)


OCCURRENCE = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8)
RANGE = (np.int64, np.int32, np.int32, np.int32, np.int8)


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def in_order(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Sorted by group, member and corpus order."""
    group, member, doc, seq, start, _ = columns
    order = np.lexsort((start, seq, doc, member, group))
    return tuple(c[order] for c in columns)


def settle(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted occurrences: which open a (group, member), which of the others repeat that first one (itself does not)."""
    group, member, doc, seq, start, _ = columns
    opens = starts_of_runs(group, member)
    head = np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0))
    same = (doc == doc[head]) & (seq == seq[head]) & (start == start[head])
    return opens, ~same


def ranges(columns: tuple[np.ndarray, ...], kind: int) -> tuple[np.ndarray, ...]:
    """The bytes (or, while open, the start positions) of occurrences, overlapping neighbours of a text merged."""
    _, _, doc, seq, start, n = columns
    order = np.lexsort((start, seq, doc))
    doc, seq, start, stop = doc[order], seq[order], start[order], (start + n)[order].astype(np.int32)
    if not len(doc):
        return doc, seq, start, stop, np.zeros(0, np.int8)
    new = starts_of_runs(doc, seq)
    new[1:] |= start[1:] > stop[:-1]  # phrases of a text do not nest, so the last stop is the greatest
    begin = np.flatnonzero(new)
    stop = np.maximum.reduceat(stop, begin)
    if kind == REPEATED:
        stop = stop + np.int32(LENGTH - 1)
    return doc[begin], seq[begin], start[begin], stop, np.full(len(begin), kind, np.int8)


def _packed(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(list(map(pa.array, zip(*rows), _ARROW_PACKED.types)), schema=_ARROW_PACKED)


def _send(columns: tuple[np.ndarray, ...], n_buckets: int, whole_groups: bool, turn: int) -> Iterator[pa.RecordBatch]:
    """Settle what one task can, and send each (group, member) that it holds once."""
    columns = in_order(columns)
    opens, repeats = settle(columns)
    done = [ranges(tuple(c[repeats] for c in columns), REPEATED)]
    columns = tuple(c[opens] for c in columns)
    if whole_groups:
        group = columns[0]
        begin = np.flatnonzero(starts_of_runs(group))
        many = np.repeat(np.diff(np.append(begin, len(group))) > MOST_PHRASES, np.diff(np.append(begin, len(group))))
        done.append(ranges(tuple(c[many] for c in columns), OPEN))
        marked = begin[many[begin]]
        marks = tuple(c[marked] for c in columns[:5]) + (np.zeros(len(marked), np.uint8),)
        columns = tuple(np.concatenate([c[~many], m]) for c, m in zip(columns, marks))
    settled = tuple(np.concatenate(c) for c in zip(*done))
    if len(settled[0]):
        yield _packed([(turn % n_buckets, True, pack(settled))])
    group, member, doc, seq, start, n = columns
    bucket = (group >> np.uint64(40)) % np.uint64(n_buckets)
    order = np.lexsort((start, seq, doc, bucket))
    bucket, columns = bucket[order], tuple(c[order] for c in columns)
    edges = np.append(np.flatnonzero(starts_of_runs(bucket)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    keep = _LOW48 if whole_groups else _LOW32
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        group, member, *rest = (c[low:high] for c in columns)
        yield _packed([(int(bucket[low]), False, pack((group & _LOW48, member & keep, *rest)))])


def _phrase_sender(n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = Occurrences(), 0
        for batch in batches:
            for doc, seq, data in zip(*(batch.column(name) for name in ("doc", "seq", "data"))):
                for at, part in segments(data.as_py()):
                    first, n, right, whole = phrases(part)
                    held.add(right, whole, doc.as_py(), seq.as_py(), first + at, n)
                    if held.size >= FLUSH:
                        turn += 1
                        yield from _send(held.take(), n_buckets, True, hash((doc.as_py(), turn)))
        if held.size:
            yield from _send(held.take(), n_buckets, True, hash((doc.as_py(), turn)))

    return send


def _suffix_sender(n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = Occurrences(), 0
        one, two = hashers()
        for batch in batches:
            for doc, seq, data, open_ in zip(*(batch.column(name) for name in ("doc", "seq", "data", "open"))):
                text = data.as_py()
                wanted = np.zeros(max(0, len(text) - LENGTH + 1), bool)
                for r in open_.as_py():
                    wanted[r["start"] : r["stop"]] = True
                for at, part in segments(text):
                    start = np.flatnonzero(wanted[at : at + SEGMENT])
                    if not len(start):
                        continue
                    bytes_ = np.frombuffer(part, np.uint8)
                    keys = [h.of(h.sums(bytes_), start, start + LENGTH) for h in (one, two)]
                    held.add(*keys, doc.as_py(), seq.as_py(), start + at, np.ones(len(start)))
                    if held.size >= FLUSH:
                        turn += 1
                        yield from _send(held.take(), n_buckets, False, hash((doc.as_py(), turn)))
        if held.size:
            yield from _send(held.take(), n_buckets, False, hash((doc.as_py(), turn)))

    return send


def _settler(whole_groups: bool):
    def settle_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for settled, payload in zip(batch.column("settled"), batch.column("payload")):
                if settled.as_py():
                    yield _ranges(unpack(payload.as_py(), RANGE))
                else:
                    parts.append(unpack(payload.as_py(), OCCURRENCE))
        if not parts:
            return
        columns = in_order(tuple(np.concatenate(c) for c in zip(*parts)))
        is_mark = columns[5] == 0
        marked = np.unique(columns[0][is_mark])
        columns = tuple(c[~is_mark] for c in columns)
        opens, repeats = settle(columns)
        yield _ranges(ranges(tuple(c[repeats] for c in columns), REPEATED))
        if whole_groups:
            first = tuple(c[opens] for c in columns)
            begin = np.flatnonzero(starts_of_runs(first[0]))
            sizes = np.diff(np.append(begin, len(first[0])))
            is_open = np.repeat(sizes > 1, sizes) | np.isin(first[0], marked)
            yield _ranges(ranges(tuple(c[is_open] for c in first), OPEN))

    return settle_bucket


def _ranges(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch(list(map(pa.array, columns, _ARROW_RANGES.types)), schema=_ARROW_RANGES)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the ranges out of each text."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", spans_type), ("kept", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for doc, data, found in zip(*(batch.column(name) for name in ("doc", "data", "found"))):
            text, spans = data.as_py(), []
            for r in sorted(found.as_py() or (), key=lambda r: r["start"]):
                if spans and r["start"] <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], r["stop"])
                else:
                    spans.append(r)
            edges = [0, *(e for s in spans for e in (s["start"], s["stop"])), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc.as_py(), len(text), len(text) - len(kept), spans, kept))
            held += len(kept)
            if held > 1 << 23:
                yield pa.record_batch(list(map(pa.array, zip(*rows), schema.types)), schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.record_batch(list(map(pa.array, zip(*rows), schema.types)), schema=schema)


def _sequence(docs: DataFrame) -> Column | DataFrame:
    """docs with ``seq``, which tells different texts of one doc_id apart (zero for all, as a rule)."""
    slim = docs.select("doc", F.xxhash64("data").alias("body"))
    twins = slim.groupBy("doc").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most")
    if twins.isEmpty():
        return docs.select("doc", F.lit(0).alias("seq"), "data")
    marked = docs.join(twins.select("doc", F.lit(True).alias("is_twin")), "doc", "left")
    return marked.select("doc", F.when(F.col("is_twin"), F.hash("data")).otherwise(0).alias("seq"), "data")


def deduplicated(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (maximal removed runs as start and stop bytes), kept (bytes)."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), utf8(docs["text"]).alias("data"))
    texts = _sequence(keyed)
    n_buckets = pieces(text_bytes(docs), bucket_bytes)
    path = scratch(spark, "phrases")
    by_phrase = texts.mapInArrow(_phrase_sender(n_buckets), _PACKED).repartition(n_buckets, "bucket").mapInArrow(_settler(True), _RANGES)
    by_phrase.write.parquet(path)
    found = spark.read.parquet(path)
    as_list = F.collect_list(F.struct("start", "stop"))
    open_ = found.where(F.col("kind") == OPEN).groupBy("doc", "seq").agg(as_list.alias("open"))
    suffixes = texts.join(open_, ["doc", "seq"]).mapInArrow(_suffix_sender(n_buckets), _PACKED)
    by_suffix = suffixes.repartition(n_buckets, "bucket").mapInArrow(_settler(False), _RANGES)
    repeated = found.where(F.col("kind") == REPEATED).unionByName(by_suffix).groupBy("doc", "seq").agg(as_list.alias("found"))
    made = texts.join(repeated, ["doc", "seq"], "left").select("doc", "data", "found").mapInArrow(
        _assemble, "doc long, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary"
    )
    return made.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
