"""Near-duplicates by SimHash, found with a distributed vantage-point tree.

Fingerprints are 64 bits over word shingles. Each level of the tree has a vantage point and one block of bits, and parts
its fingerprints by their Hamming distance to the vantage point within that block; eight levels make a leaf. For two
fingerprints the triangle inequality bounds the difference of their distances on every level by the bits in which their
blocks differ, and the blocks are disjoint, so the differences add up to at most the radius: a query descends only into
leaves whose distances differ from its own by the radius in total. Those are the boundary-overlapping shards; a
fingerprint is sent to them (to one of each opposite pair of leaves) and compared exactly with what lives there.

Equal fingerprints are collapsed before the search and each shard emits a spanning forest of the links it finds, never all
pairs of a group. Components come from star contraction with reliable checkpoints. Nothing but counts reaches the driver.

Defined results: null and empty texts have the fingerprint zero and link like any other; texts with fewer words than a
shingle hash their whole word sequence; very long texts are hashed in chunks; a component's id is its smallest doc_id
(null only if it has no other); repeated rows share fingerprint and component; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import cut, pieces, unused, utf8
from stavelake.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
LEVELS = 8
#: The vantage point: any constant does, as fingerprints are spread around every point alike.
VANTAGE = 0x6A09E667F3BCC908
_CHUNK = 1 << 15


def _ones(hashed: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def of_hashes(hashed: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed 64-bit number; 0 of none."""
    return _majority(sum((_ones(hashed[i : i + _CHUNK]) for i in range(0, len(hashed), _CHUNK)), np.zeros(64, np.int64)), len(hashed))


def fingerprint(data: bytes) -> int:
    """SimHash of a text, as a signed 64-bit number."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        hashed = (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(start, stop))
        ones += _ones(np.fromiter(hashed, np.uint64, stop - start))
    return _majority(ones, n)


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(data) for data in batch], dtype="int64")

    return hashed(utf8(text))


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def leaf(value: Column) -> Column:
    """The leaf of a fingerprint: one byte per level, its distance there plus the radius."""
    width = 64 // LEVELS
    parts = [
        (F.bit_count(value.bitwiseXOR(F.lit(_signed(VANTAGE))).bitwiseAND(F.lit(_signed(((1 << width) - 1) << (width * k))))) + RADIUS).cast("long")
        for k in range(LEVELS)
    ]
    return sum((F.shiftleft(p, 8 * k) for k, p in enumerate(parts[1:], 1)), parts[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def overlaps() -> list[int]:
    """Leaf offsets whose level differences add up to at most the radius, one of each opposite pair, zero left out."""
    steps = [{k: s} for k in range(LEVELS) for s in range(-RADIUS, RADIUS + 1) if s]
    found = {tuple(step.get(k, 0) for k in range(LEVELS)) for step in steps}
    frontier = found
    for _ in range(RADIUS - 1):
        frontier = {tuple(a + b for a, b in zip(x, y)) for x in frontier for y in found}
        found = found | frontier
    kept = [v for v in found if 0 < sum(map(abs, v)) <= RADIUS and next(s for s in v if s) > 0]
    return sorted(sum(s << 8 * k for k, s in enumerate(v)) for v in kept)


def _join_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a shard: residents of a leaf among themselves, visitors against residents; a spanning forest comes out."""
    parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches if batch.num_rows]
    if not parts:
        return
    cell, value, resident = (np.concatenate(column) for column in zip(*parts))
    homes = np.flatnonzero(resident)
    homes = homes[np.argsort(cell[homes], kind="stable")]
    home_cell, home_value = cell[homes], value[homes].view(np.uint64)
    nodes, index = np.unique(value, return_inverse=True)
    home_node = index[homes]
    low, high = np.searchsorted(home_cell, cell, "left"), np.searchsorted(home_cell, cell, "right")
    own_place = np.zeros(len(cell), np.int64)
    own_place[homes] = np.arange(1, len(homes) + 1)
    low = np.where(resident, own_place, low)
    count = high - low
    asking = np.flatnonzero(count > 0)
    root, query = np.arange(len(nodes)), value.view(np.uint64)
    for some in _slices(count[asking], 1 << 21):
        rows = asking[some]
        n = count[rows]
        left = np.repeat(rows, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[rows], n)
        near = np.bitwise_count(query[left] ^ home_value[right]) <= RADIUS
        _unite(root, index[left[near]], home_node[right[near]])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    if len(linked):
        yield pa.record_batch([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["u", "v"])


def _slices(count: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows with about ``most`` comparisons each."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(at, stop)
        at = stop


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs into ``root``, which stays flat: roots hook to the least root they meet until none moves."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root[:] = jumped


def links(values: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints in column ``fp`` that differ in at most RADIUS bits."""
    homes = values.select(leaf(F.col("fp")).alias("cell"), "fp")
    visits = homes.select(F.explode(F.array(*map(F.lit, [0, *overlaps()]))).alias("step"), "cell", "fp")
    rows = visits.select((F.col("cell") + F.col("step")).alias("cell"), "fp", (F.col("step") == 0).cast("byte").alias("resident"))
    shards = pieces(values.count() * (1 + len(overlaps())), 1 << 19, 16)
    return rows.repartition(shards, "cell").mapInArrow(_join_shard, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, body (a hash of its text), fp, first (the component's representative: doc_id and body)."""
    slim = cut(docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("body"), fingerprints(docs["text"]).alias("fp")))
    return classified(slim, links)


def classified(slim: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``slim`` (doc_id, body, fp) with first, where ``linked`` gives the links (u, v) between the distinct values of fp."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body"))
    by_value = cut(slim.groupBy("fp").agg(first.alias("own_first")))
    rooted = components(linked(by_value.select("fp")))
    grouped = by_value.join(rooted, by_value["fp"] == rooted["node"], "left").select("fp", "own_first", F.coalesce("root", "fp").alias("root"))
    per_root = grouped.groupBy("root").agg(F.min("own_first").alias("first"))
    return slim.join(grouped.join(per_root, "root").select("fp", "first"), "fp").select("doc_id", "body", "fp", "first")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns."""
    return firsts(docs, classes(docs))


def firsts(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """The documents that represent a component, once each."""
    doc, body = unused(docs, "first_doc", "first_body")
    keep = classed.select("first").distinct().select(F.col("first.doc_id").alias(doc), F.col("first.body").alias(body))
    own = docs.select(*(docs[c] for c in docs.columns))
    kept = own.join(keep, own["doc_id"].eqNullSafe(keep[doc]) & (F.xxhash64(own["text"]) == keep[body]))
    return kept.dropDuplicates([doc, body]).select(*(own[c] for c in own.columns))
