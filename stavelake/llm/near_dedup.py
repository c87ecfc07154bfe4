"""Near-duplicates by exact similarity: components of the pairs whose sets of five-word shingles have Jaccard 0.8 or more.

The pipeline's stage. Every text becomes the set of its shingle hashes; equal sets are collapsed. The sets' SimHash
fingerprints go through the vantage-point tree of ``simhash_dedup``; every set that it finds near others is verified against
the least one of its component, on the whole sets. These are the first links. What no radius of bits covers surely follows
by an exact join, which finds the links that are left. All shingles have one global order (see below), and two sets of similarity 0.8 must share a shingle within their first n - ceil(0.8 n) + 1
ones, so grouping those prefixes by shingle brings every such pair together: no pair is lost to a radius or to hashing
into bands. Each pair is then verified on the whole sets, with integers.

The order only decides how much is compared, never what is found: frequent shingles come last, so that a passage which
many texts share is in few prefixes. They are the at most ``HOT`` most frequent ones of a sample of about ``SAMPLE``
texts and are broadcast (16 bytes each); nothing else but counts reaches the driver. A shingle that the sample shows to
be in very many texts is dealt over several tasks, by the set's hash.

Groups are first compared with their least member. Members that the links found so far join need no further comparison,
so a large group of copies costs as many comparisons as it has members. Of shingles whose sets are still in several
components, groups are split into blocks and every pair of blocks is compared in one task by bounds alone: the sizes, and
a parity bitmap of each set, whose Hamming distance never exceeds the number of shingles that only one of the two holds.
Every component then offers its nearest candidate in each pair of blocks (a row per component, not per pair), these are
verified and united, and so on until a round finds no link. What then still passes the bounds, between different
components, is verified to the last pair. Only rows that pass the bounds with another one go through these rounds.

Defined results: words are split and lower-cased as in ``simhash_dedup``; null and empty texts are one class; a text of
fewer than five words is one shingle and links only to an equal one; a component's id is its smallest doc_id (null only if
it has no other); repeated rows share a component; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm import simhash_dedup
from stavelake.llm.common import cut, pieces, utf8, written
from stavelake.llm.components import components

SHINGLE, SEED = 5, 42
HOT, SAMPLE, OFTEN = 1 << 18, 1 << 13, 3
#: Rows of one shingle in a task where the sample tells, and rows of a block of which pairs are compared.
DEALT, BLOCK = 1 << 17, 1 << 11
#: Bits of the folded parity bitmaps of sets, and of sets with at least ``LARGE`` shingles (no more than these).
BITS, WIDE, LARGE = 512, 1024, 1024
_SHARES = 1_000_000


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of its whole word sequence if it is shorter; none if it is empty."""
    words = data.lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    hashed = (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n))
    return np.unique(np.fromiter(hashed, np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def prefix(found: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: rare ones by hash, then those of ``hot`` by count and hash."""
    rank = np.zeros(len(found), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        rank = np.where(hot[at] == found, counts[at], 0)
    n = len(found)
    return found[np.lexsort((found, rank))][: n - (4 * n + 4) // 5 + 1 if n else 0]


def parities(found: np.ndarray) -> bytes:
    """For each bucket of hashes, whether a set has an odd number there; BITS buckets or more, at least one a shingle."""
    width = max(BITS, 1 << max(0, len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> bytes:
    """The parities of fewer buckets."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 64), axis=0).tobytes()


def may_be_similar(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """Whether two bitmaps differ in no more buckets than similar sets of these sizes differ in shingles."""
    width = 8 * min(len(a), len(b))
    x, y = np.frombuffer(folded(a, width), np.uint64), np.frombuffer(folded(b, width), np.uint64)
    return 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= na + nb


def sets(text: Column) -> Column:
    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(data).tobytes() for data in batch], dtype=object)

    return made(utf8(text))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, their counts, and over how many tasks to deal each."""
    total = docs.count()
    share = min(_SHARES, -(-SAMPLE * _SHARES // max(1, total)))

    @F.pandas_udf("array<long>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(data).view(np.int64) for data in batch], dtype=object)

    some = docs.where(F.pmod(F.xxhash64(docs["text"]), F.lit(_SHARES)) < share).select(F.explode(listed(utf8(docs["text"]))).alias("token"))
    top = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(HOT).toPandas()
    hot, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hot)
    return hot[order], counts[order], -(-counts[order] * _SHARES // (share * DEALT))


def dealt(tokens: np.ndarray, fp: int, hot: np.ndarray, deals: np.ndarray) -> np.ndarray:
    """Which of its tasks (1, 2, ...) compares a set first, by shingle; 0 if it has one task only, nothing if all are so."""
    if not len(hot):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    many = (hot[at] == tokens) & (deals[at] > 1)
    return np.where(many, 1 + fp % deals[at], 0) if many.any() else np.zeros(0, np.int64)


def prefixes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, body (a hash of its text), fp (a hash of its set), sim (the set's SimHash), n (its size), whole
    (its parities), bits (these folded), tokens (its prefix) and deals (their tasks)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    @F.pandas_udf("fp long, sim long, n long, whole binary, bits binary, tokens array<long>, deals array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hot, counts, deals = shared.value
        for batch in batches:
            found = [shingle_set(data) for data in batch]
            fp = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found]
            tokens = [prefix(s, hot, counts) for s in found]
            whole = [parities(s) for s in found]
            yield pd.DataFrame({
                "fp": np.array(fp, np.uint64).view(np.int64),
                "sim": np.array([simhash_dedup.of_hashes(s) for s in found], np.int64),
                "n": np.array([len(s) for s in found], np.int64),
                "whole": pd.Series(whole, dtype=object),
                "bits": pd.Series([folded(w, BITS if len(s) < LARGE else WIDE) for w, s in zip(whole, found)], dtype=object),
                "tokens": pd.Series([t.view(np.int64) for t in tokens], dtype=object),
                "deals": pd.Series([dealt(t, f >> 32, hot, deals) for t, f in zip(tokens, fp)], dtype=object),  # mostly empty
            })

    slim = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("body"), made(utf8(docs["text"])).alias("s"))
    return cut(slim.select("doc_id", "body", "s.*"))


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    """The first ``n`` columns of a shard."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns[:n]] for batch in batches if batch.num_rows]
    return [np.concatenate(c) for c in zip(*parts)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (token, fp, n) whose token others have too, with the group's least fp and its n.

    Groups are parted by ``deal``; a row that is alone in its part stays if its token is dealt.
    """
    columns = _columns(batches, 4)
    if not columns:
        return
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.append(True, (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0))
    token, deal, fp, n = (c[new] for c in columns)
    first = np.flatnonzero(np.append(True, (np.diff(token) != 0) | (np.diff(deal) != 0)))
    count = np.diff(np.append(first, len(token)))
    head = np.repeat(first, count)
    rows = np.flatnonzero((np.repeat(count, count) > 1) | (deal > 0))
    if len(rows):
        columns = [token[rows], fp[rows], n[rows], fp[head[rows]], n[head[rows]]]
        yield pa.record_batch([pa.array(c) for c in columns], ["token", "fp", "n", "head", "head_n"])


def _bitmaps(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parities folded to BITS, and whole ones of large sets (zero for others), as rows of 64-bit numbers."""
    wide = np.zeros((len(data), WIDE // 64), np.uint64)
    for i, bits in enumerate(data):
        wide[i, : len(bits) // 8] = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(wide.reshape(len(data), WIDE // BITS, BITS // 64), axis=1), wide


def _apart(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[left] ^ x[right]).sum(axis=1, dtype=np.int64)


def _candidates(what: str):
    """Of a shard's rows (cell, fp, n, root, bits), pairs with one cell, different roots and bounds that allow similarity.

    ``rows`` gives the rows that are in such a pair, ``all`` the pairs: a, b, na, nb, and in how many cells, ``nearest``
    only those with the least distance for each root and cell.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        columns = _columns(iter(held), 4)
        if not columns:
            return
        bits = [data for batch in held for data in batch.column(4).to_pylist()]
        order = np.lexsort((columns[1], columns[3], columns[0]))
        cell, fp, n, root = (c[order] for c in columns)
        near, wide = _bitmaps([bits[i] for i in order.tolist()])
        both = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(root) != 0)))
        others = np.repeat(np.append(both[1:], len(cell)), np.diff(np.append(both, len(cell))))
        count = np.searchsorted(cell, cell, "right") - others
        asking = np.flatnonzero(count > 0)
        kept: list[np.ndarray] = []
        for some in simhash_dedup._slices(count[asking], 1 << 17):
            rows = asking[some]
            m = count[rows]
            left = np.repeat(rows, m)
            right = others[left] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            fits = 5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right])
            left, right = left[fits], right[fits]
            apart = _apart(near, left, right)
            fits = 9 * apart <= n[left] + n[right]
            left, right, apart = left[fits], right[fits], apart[fits]
            large = np.minimum(n[left], n[right]) >= LARGE
            apart[large] = _apart(wide, left[large], right[large])
            fits = 9 * apart <= n[left] + n[right]
            kept.append(np.stack([left[fits], right[fits], apart[fits]]))
            if what == "rows":
                kept = [np.unique(np.concatenate([k.ravel() for k in (*kept[:-1], kept[-1][:2])]))]
            if what == "nearest":
                kept = [_nearest(np.concatenate(kept, axis=1), cell, root)]
        if what == "rows":
            rows = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            made = [pa.array(c[rows]) for c in (cell, fp, n, root)] + [pa.array([bits[i] for i in order[rows].tolist()], pa.binary())]
            yield pa.record_batch(made, ["cell", "fp", "n", "root", "bits"])
            return
        left, right = np.concatenate(kept, axis=1)[:2] if kept else np.zeros((2, 0), np.int64)
        low, high = np.where(fp[left] < fp[right], left, right), np.where(fp[left] < fp[right], right, left)
        order = np.lexsort((fp[high], fp[low]))
        a, b = fp[low[order]], fp[high[order]]
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))[: len(a)]
        made = [a[first], b[first], n[low[order[first]]], n[high[order[first]]], np.diff(np.append(first, len(a)))]
        yield pa.record_batch([pa.array(c) for c in made], ["a", "b", "na", "nb", "k"])

    return found


def _nearest(pairs: np.ndarray, cell: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of pairs (left, right, distance), the nearest of each root in each cell, seen from either side."""
    picked = []
    for side in (0, 1):
        order = np.lexsort((pairs[2], root[pairs[side]], cell[pairs[side]]))
        c, r = cell[pairs[side][order]], root[pairs[side][order]]
        picked.append(order[np.append(True, (np.diff(c) != 0) | (np.diff(r) != 0))[: len(order)]])
    return pairs[:, np.unique(np.concatenate(picked))]


def enough(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb, k) that may be similar by the number of shingles that their prefixes share.

    Similar sets share o >= 4/9 (na + nb) shingles. The prefix that ends first leaves out ceil(0.8 n) - 1 shingles of its
    set, all others that are shared lie in both prefixes: at least o + 1 less the greater ceil(0.8 n).
    """
    summed = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("k").alias("k"))
    return summed.where("9 * (k - 1 + floor((4 * greatest(na, nb) + 4) / 5)) >= 4 * (na + nb)").select("a", "b")


def met(rows: DataFrame, *names: str) -> DataFrame:
    """Of rows (a, b, fp, ...) for both sides of each pair, one row per pair: a, b, and every column of either side."""
    side = lambda c, name: F.first(F.when(F.col("fp") == F.col(c), F.col(name)), ignorenulls=True).alias(f"{c}_{name}")
    return rows.groupBy("a", "b").agg(*(side(c, name) for c in "ab" for name in names))


def verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, as links (u, v).

    First the whole bitmaps of both sides meet; they are 64 times smaller than the sets and leave few pairs that are not
    similar. Then the sets meet. The lists of what to read are written tables, which Spark broadcasts below its threshold
    instead of shuffling what they are joined to.
    """

    @F.pandas_udf("boolean")
    def likely(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*row) for row in zip(na, nb, a, b)], dtype=bool)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)

    sides = written(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp")), "near-sides")
    maps = met(homes.join(sides, "fp"), "n", "whole", "home").where(likely("a_n", "b_n", "a_whole", "b_whole"))
    homes_of = F.array(*(F.struct(F.col(c).alias("fp"), F.col(f"{c}_home").alias("home")) for c in "ab"))
    wanted = written(maps.select("a", "b", F.explode(homes_of).alias("s")).select("a", "b", "s.fp", "s.home.*"), "near-wanted")
    own = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("body"))
    some = own.join(wanted, own["doc_id"].eqNullSafe(wanted["first_doc"]) & (own["body"] == wanted["first_body"]))
    both = met(some.select("a", "b", "fp", sets(F.col("text")).alias("found")), "found").where(alike("a_found", "b_found"))
    return cut(both.select(F.col("a").alias("u"), F.col("b").alias("v")))


def tree_pairs(homes: DataFrame) -> DataFrame:
    """Pairs (a, b): every set with the least set of its component under the SimHash tree, if their sizes allow similarity."""
    sims = homes.select("fp", "n", "sim")
    tree = components(simhash_dedup.links(cut(sims.select(F.col("sim").alias("fp")).distinct())))
    placed = sims.join(tree, sims["sim"] == tree["node"], "left").select("fp", "n", F.coalesce("root", "sim").alias("group"))
    heads = placed.groupBy("group").agg(F.min(F.struct("fp", "n")).alias("head"))
    near = placed.join(heads, "group").where("fp <> head.fp AND 5 * least(n, head.n) >= 4 * greatest(n, head.n)")
    return cut(near.select(F.col("head.fp").alias("a"), F.col("fp").alias("b")))


def apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sides are in different components."""
    for side in "ab":
        named = rooted.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(named, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.where("a_root <> b_root").select("a", "b")


def links(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """Links (u, v) that span the components of the distinct sets; ``slim`` is ``prefixes(docs)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body"))
    homes = slim.groupBy("fp").agg(first.alias("f"), *(F.first(c).alias(c) for c in ("sim", "n", "bits", "whole")))
    home = F.struct(F.col("f.doc_id").alias("first_doc"), F.col("f.body").alias("first_body")).alias("home")
    homes = written(homes.select("fp", "sim", "n", "bits", "whole", home), "near-sets")
    found = verified(tree_pairs(homes), docs, homes)
    rows = slim.select("fp", "n", "deals", F.posexplode("tokens").alias("at", "token"))
    rows = rows.select("token", F.coalesce(F.get("deals", F.col("at")), F.lit(0)).alias("deal"), "fp", "n")
    shards = pieces(slim.agg(F.sum(F.size("tokens"))).first()[0] or 0, 1 << 19, 16)
    shared = cut(rows.repartition(shards, "token", "deal").mapInArrow(_shared, "token long, fp long, n long, head long, head_n long"))
    stars = shared.where("fp <> head AND 5 * least(n, head_n) >= 4 * greatest(n, head_n)")
    stars = stars.select(F.col("head").alias("a"), F.col("fp").alias("b"), F.col("head_n").alias("na"), F.col("n").alias("nb"), F.lit(1).alias("k"))
    found = found.unionByName(verified(cut(apart(enough(stars), roots(found))), docs, homes))
    cells = unsettled(shared, roots(found)).join(homes.select("fp", "bits"), "fp").select(*_cells(), "fp", "n", "root", "bits")
    open_ = cut(cells.repartition(shards, "cell").mapInArrow(_candidates("rows"), "cell long, fp long, n long, root long, bits binary"))
    pair = "a long, b long, na long, nb long, k long"
    while True:
        rooted = roots(found)
        placed = open_.drop("root").join(rooted, F.col("fp") == F.col("node"), "left").select("cell", "fp", "n", F.coalesce("root", "fp").alias("root"), "bits")
        placed = placed.repartition(shards, "cell")
        more = verified(cut(placed.mapInArrow(_candidates("nearest"), pair).select("a", "b").distinct()), docs, homes)
        if more.isEmpty():
            return found.unionByName(verified(cut(enough(placed.mapInArrow(_candidates("all"), pair))), docs, homes))
        found = found.unionByName(more)


def roots(found: DataFrame) -> DataFrame:
    """(node, root) of the links so far, as a table of known size."""
    return written(components(found), "near-roots")


def unsettled(shared: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows (token, fp, n) of tokens whose sets are in several components, with root and m, the rows of the token."""
    placed = shared.join(rooted, shared["fp"] == rooted["node"], "left").select("token", "fp", "n", F.coalesce("root", "fp").alias("root"))
    several = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    return placed.join(several.select(F.col("token").alias("t"), "m"), F.col("token") == F.col("t")).select("token", "fp", "n", "root", "m")


def _cells() -> list[Column]:
    """The pairs of a token's blocks that a row takes part in, as one hash each."""
    blocks = F.ceil(F.col("m") / BLOCK)
    own = F.pmod(F.xxhash64("fp"), blocks)
    pair = lambda other: F.xxhash64("token", F.least(own, other), F.greatest(own, other))
    return [F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), pair)).alias("cell")]


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, body (a hash of its text), fp (a hash of its set), first (the component's representative)."""
    slim = prefixes(docs)
    return simhash_dedup.classified(slim.select("doc_id", "body", "fp"), lambda _: links(docs, slim))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns."""
    return simhash_dedup.firsts(docs, classes(docs))
