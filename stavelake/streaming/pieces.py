"""Structured Streaming: fingerprint new pieces as files arrive, and append-only run logs.

The file source's checkpoint remembers what was processed, so a restarted stream scores each file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stavelake.operators import axes
from stavelake.operators.frames import Frames
from stavelake.sources import grammar


def piece_stream(spark: SparkSession, path: str, glob: str = "song_*.txt") -> DataFrame:
    """(piece_id, text) of files as they appear."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("piece_id"), F.col("value").alias("text")
    )


def fingerprint_stream(texts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the long fingerprint of every new piece to ``out``; a replayed batch overwrites itself."""
    def score(batch: DataFrame, batch_id: int) -> None:
        texts = batch.persist()
        fr = Frames(grammar.events(texts), grammar.pieces(texts), grammar.bars(texts))
        axes.fingerprint(fr).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        fr.release()
        texts.unpersist()

    return texts.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str) -> None:
    """Append run events as JSON lines with a UTC stamp."""
    rows.withColumn("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("append").json(path)


def merged_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """All run logs under one schema; fields a log lacks are null."""
    df = spark.read.json(paths[0])
    for p in paths[1:]:
        df = df.unionByName(spark.read.json(p), allowMissingColumns=True)
    return df


def not_yet_done(work: DataFrame, out: DataFrame, key: str = "piece_id") -> DataFrame:
    """Resume: what the output does not hold yet."""
    return work.join(out.select(key).distinct(), key, "left_anti")
