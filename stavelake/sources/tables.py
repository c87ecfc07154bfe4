"""Adapters that read ordinary star-schema tables as note events.

The mapping is integer arithmetic on lineitem columns, so every time value is dyadic and sums are
exact in any order. ``seq`` is computed row-locally (a row number would need one global sort); rows
that share a ``seq`` agree in voice, pitch, velocity and duration, so their order never matters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_BARS = 32
BAR_QL = 4.0
GRID = 16
DRUM_LINE = 7
VELOCITY_LEVELS = (32, 56, 80, 104)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that yields fewer splits than the session has cores (one small file, one
    row group); a scan with enough splits is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() * 2 <= cores else df


#: Notes of a piece at most that one task takes whole, and notes of a partition of pieces.
WHOLE_PIECE, DEALT_NOTES = 1 << 20, 1 << 20


_SIZES: dict[tuple, tuple[int, int]] = {}


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table was last written and how large it is, from the file system Spark reads it by."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getFileStatus(location).getModificationTime(), files.getContentSummary(location).getLength()


def dealt(spark: SparkSession, sf_dir: str) -> int:
    """Over how many partitions the notes are dealt by piece; 0 if a piece is too large to be put into one task."""
    path = f"{sf_dir}/lineitem.parquet"
    key = (spark.sparkContext.applicationId, path, state_of(spark, path))
    if key not in _SIZES:
        sizes = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        found = sizes.agg(F.max("n"), F.sum("n")).first()
        _SIZES.clear()
        _SIZES[key] = found[0] or 0, found[1] or 0
    largest, rows = _SIZES[key]
    return 0 if largest > WHOLE_PIECE else max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / DEALT_NOTES))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as note events; a supplier is a piece, a line number is a voice.

    They are dealt by piece, so what is grouped, ordered or joined by piece later moves no note again, unless a piece is
    too large for one task.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    parts = dealt(spark, sf_dir)
    li = li.repartition(parts, "l_suppkey") if parts else spread(li, "l_orderkey", "l_partkey")
    line = F.col("l_linenumber").cast("int")
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))
    slot = (F.col("l_partkey") % GRID).cast("int")
    base = li.select(
        F.col("l_suppkey").alias("piece_id"),
        F.concat(F.lit("V"), line.cast("string")).alias("voice"),
        line.alias("voice_ix"),
        (line == DRUM_LINE).alias("is_drum"),
        F.when(line < DRUM_LINE, F.floor((line - 1) / 2) * 24).cast("int").alias("program"),
        (F.pmod(day, F.lit(N_BARS)) + 1).cast("int").alias("bar"),
        F.lit(GRID).alias("grid"),
        (slot + 1).alias("slot"),
        (F.col("l_quantity").cast("int") % 8 + 1).alias("dur_slots"),
        (F.col("l_orderkey") % 48 + 36).cast("int").alias("midi"),
        F.element_at(F.array(*map(F.lit, VELOCITY_LEVELS)), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("vel"),
        (F.col("l_orderkey") * 64 + line * 8 + F.col("l_quantity").cast("int") % 8).alias("seq"),
    )
    return base.select(
        "*",
        ((F.col("slot") - 1) / 4.0).alias("onb"),
        ((F.col("bar") - 1) * BAR_QL + (F.col("slot") - 1) / 4.0).alias("abs"),
        (F.col("dur_slots") / 4.0).alias("dur"),
        (F.col("midi") % 12).alias("pc"),
    )


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier; the supplier's nation is the group ("genre")."""
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("piece_id"),
        F.col("s_nationkey").cast("int").alias("genre"),
        F.lit(BAR_QL).alias("bar_ql"),
        F.lit(N_BARS).alias("n_bars"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared bars of the adapter pieces: all on the 16th grid, no chord label."""
    return pieces(spark, sf_dir).select(
        "piece_id",
        F.explode(F.sequence(F.lit(1), F.col("n_bars"))).alias("bar"),
        F.lit(GRID).alias("grid"),
        F.lit(False).alias("is_triplet"),
    )
