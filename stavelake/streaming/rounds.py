"""Best round per case over a stream of scored rounds.

The state is one row per case: the best round so far, by ascending keys and then the earlier round. Rounds may come late
or out of order, as a minimum does not depend on order. Every micro-batch writes the cases it improved into a folder of
its own, named by the batch, so a batch that is repeated after a failure replaces what it wrote; a restart goes on from
the checkpoint. ``current`` reads the last state of every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def best_so_far(results: DataFrame, keys: list[Column]) -> DataFrame:
    """Stateful grouping: for each case_id the row with the least ``keys`` and then the least round."""
    rest = [c for c in results.columns if c not in ("case_id", "round")]
    order = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    best = results.groupBy("case_id").agg(F.min(F.struct(*order, "round", *rest)).alias("best"))
    return best.select("case_id", *(f"best.{c}" for c in ("round", *rest)))


def keep_best(results: DataFrame, keys: list[Column], out: str, checkpoint: str) -> StreamingQuery:
    """Run the stream over what is there now (and over what comes, if started again)."""

    def store(improved: DataFrame, batch: int) -> None:
        improved.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = best_so_far(results, keys).writeStream.outputMode("update").foreachBatch(store)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The best round of every case after the last batch."""
    seen = spark.read.parquet(out)
    kept = [c for c in seen.columns if c not in ("case_id", "batch")]
    last = seen.groupBy("case_id").agg(F.max_by(F.struct(*kept), "batch").alias("last"))
    return last.select("case_id", "last.*")
