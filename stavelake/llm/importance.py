"""Importance resampling towards a target distribution over hashed word n-grams.

Every text becomes counts of hashed features. A bucket's gain is the log-ratio of its smoothed shares in the target and in
the raw texts; the gains form one array, by which each document is scored in a second pass over its text (mean gain of
its features). Adding Gumbel noise from a hash of the id and drawing the highest scores samples documents without
replacement in proportion to their importance weights.

The exact ranks come from parallel sorting by regular sampling. Every partition is sorted into a run and written; places
at equal distances in the runs are the regular samples, and every so-manieth of the sorted samples is a splitter. The
splitters cut each run into segments; equal segments are exchanged and merged locally; running totals of the segments'
sizes turn local places into ranks. Order is by score, then id, then place of the row in its run, so equal rows never
make a segment large.

Only the bucket counts of the target and the raw texts (two arrays of ``buckets`` numbers) and at most about ``SAMPLES``
regular samples reach the driver, whatever the size of the table.

Defined results: null and empty texts have no features and weight 0; texts below ``min_words`` words are never drawn; a
null id is hashed as the empty string and comes last among equal scores; repeated rows are drawn one by one; very long
texts count whole; an empty table gives an empty result; an empty target makes every feature count against its raw share.
All columns are kept; only columns named like a result (``n_features``, ``weight``, ``score``, ``rank``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.llm.common import cut, pieces, unused, utf8

SAMPLES = 1 << 17
RESULTS = ("n_features", "weight", "score", "rank")
#: Letters, digits and all bytes from 0x80 on make words; the other ASCII characters part them.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Sampling:
    buckets: int = 10_000
    longest: int = 2
    min_words: int = 20
    percent: int = 25
    seed: int = 7


def words(data: bytes) -> list[bytes]:
    return data.lower().translate(_TABLE).split()


def features(found: list[bytes], settings: Sampling) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words; the checksum of a run continues that of its beginning."""
    sums = list(map(crc32, found))
    parts, spaced = [sums], [b" " + w for w in found]
    for k in range(1, settings.longest):
        sums = list(map(crc32, spaced[k:], sums))
        parts.append(sums)
    return np.concatenate([np.array(p, np.int64) for p in parts]) % settings.buckets


def bucket_counts(texts: DataFrame, settings: Sampling) -> np.ndarray:
    """How many features of the column ``text`` each bucket holds; partial sums per task are added by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(features(words(data.as_py()), settings), minlength=settings.buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(utf8(texts["text"])).mapInArrow(counted, "bucket long, n long")
    summed = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(settings.buckets, np.int64)
    found[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed shares, by bucket."""
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(text: Column, gain: np.ndarray, settings: Sampling) -> Column:
    """A struct of n_words, n_features and weight for a text column."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                found = words(data)
                buckets = features(found, settings)
                rows.append((len(found), len(buckets), int(gain[buckets].sum()) // len(buckets) if len(buckets) else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    return weighed(utf8(text))


def noise(doc_id: Column, settings: Sampling) -> Column:
    """Thousandths of Gumbel noise from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def _named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def scored(docs: DataFrame, target: DataFrame, settings: Sampling, keep: list[str], may: str) -> DataFrame:
    """The ``keep`` columns with n_features, weight and score, and whether a document may be drawn (column ``may``)."""
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    made, noisy = unused(docs, "importance_made", "importance_noise")
    own = _named([c for c in keep if c.lower() not in RESULTS])
    rows = docs.select(*own, weights(docs["text"], gain, settings).alias(made), noise(docs["doc_id"], settings).alias(noisy))
    weight = F.col(made)["weight"]
    return rows.select(
        *_named(rows.columns[:-2]), F.col(made)["n_features"].alias("n_features"), weight.alias("weight"),
        (weight + F.col(noisy)).alias("score"), (F.col(made)["n_words"] >= settings.min_words).alias(may),
    )


def splitters(runs: DataFrame, place: str, n: int, segments: int) -> pd.DataFrame:
    """``segments`` - 1 of the regular samples of sorted runs (score, doc_id, and ``place``: run and place within it)."""
    step = max(1, -(-n // SAMPLES))
    within = F.col(place).bitwiseAND((1 << 33) - 1)
    taken = runs.where(within % step == step // 2).select("score", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col(place).alias("place"))
    samples = taken.toPandas().sort_values(["score", "no_id", "doc", "place"], ascending=[False, True, True, True], ignore_index=True)
    at = np.unique(np.arange(1, segments) * len(samples) // segments) if len(samples) else []
    return samples.iloc[at]


def segment(score: Column, doc_id: Column, place: Column, cuts: pd.DataFrame) -> Column:
    """The number of splitters that do not come after a row."""
    keys = [(-cuts["score"]).to_numpy(np.int64), cuts["no_id"].to_numpy(bool), cuts["doc"].to_numpy(np.int64), cuts["place"].to_numpy(np.int64)]

    @F.pandas_udf("long")
    def placed(score: pd.Series, no_id: pd.Series, doc: pd.Series, place: pd.Series) -> pd.Series:
        rows = [-score.to_numpy(np.int64), no_id.to_numpy(bool), doc.to_numpy(np.int64), place.to_numpy(np.int64)]
        both = [np.concatenate(pair) for pair in zip(keys, rows)]
        order = np.lexsort(both[::-1])
        passed = np.empty(len(order), np.int64)
        passed[order] = np.cumsum(order < len(keys[0]))
        return pd.Series(passed[len(keys[0]) :])

    return placed(score, doc_id.isNull(), F.coalesce(doc_id, F.lit(0)).cast("long"), place)


def ranked(rows: DataFrame, may: str) -> tuple[DataFrame, int]:
    """``rows`` (with score and doc_id) without the flag ``may``, with ``rank``: the exact place 1, 2, 3 ... of flagged rows.

    The others have no rank and keep out of the exchange. The second result is the number of ranked rows.
    """
    place, number, of, before, local = unused(rows, "rank_place", "rank_segment", "rank_of", "rank_before", "rank_local")
    own = _named([c for c in rows.columns if c != may])
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    runs = cut(rows.sortWithinPartitions(F.desc(may), *order).withColumn(place, F.monotonically_increasing_id()))
    inside = runs.where(may)
    n = inside.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(inside, place, n, pieces(n, 1 << 17, 4 * spread))
    segments = cut(inside.select(*own, place, segment(F.col("score"), F.col("doc_id"), F.col(place), cuts).alias(number)))
    sizes = segments.groupBy(F.col(number).alias(of)).agg(F.count("*").alias(local))
    sizes = sizes.select(of, (F.sum(local).over(Window.orderBy(of)) - F.col(local)).alias(before))  # one row per segment
    merged = segments.withColumn(local, F.row_number().over(Window.partitionBy(number).orderBy(*order, place)))
    placed = merged.join(F.broadcast(sizes), F.col(number) == F.col(of)).select(*own, (F.col(local) + F.col(before)).alias("rank"))
    return placed.unionByName(runs.where(~F.col(may)).select(*own, F.lit(None).cast("long").alias("rank"))), n


def resampled(docs: DataFrame, target: DataFrame, settings: Sampling = Sampling(), keep: list[str] | None = None) -> DataFrame:
    """Every document with n_features, weight, score and, if it is drawn, its rank (else null).

    ``keep`` names the columns to carry (doc_id among them), all by default: what is carried is sorted and exchanged, so
    leave the text out where only ids are wanted.
    """
    (may,) = unused(docs, "importance_may")
    ranks, n = ranked(scored(docs, target, settings, keep or docs.columns, may), may)
    last = n * settings.percent // 100
    return ranks.withColumn("rank", F.when(F.col("rank") <= last, F.col("rank")))


def drawn(docs: DataFrame, target: DataFrame, settings: Sampling = Sampling()) -> DataFrame:
    """The documents that are drawn, with their columns and results."""
    return resampled(docs, target, settings).where("rank IS NOT NULL")
