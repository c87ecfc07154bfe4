"""The streamed best round equals pick_best over the batch, whatever order rounds come in and across a restart."""

import random

from pyspark.sql import functions as F

from stavelake.operators import rounds
from stavelake.streaming import rounds as live

SCHEMA = "case_id long, round int, score double, copy_fails int"


def test_stream_equals_batch_after_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, r, rng.choice([None, 0.5, 1.0, 2.0]), rng.randrange(2)) for c in range(40) for r in range(1, 6)]
    rng.shuffle(rows)
    out, checkpoint = str(tmp_path / "best"), str(tmp_path / "checkpoint")
    keys = [F.col("copy_fails"), F.coalesce("score", F.lit(rounds.FAILED))]
    for at in range(0, len(rows), 50):  # every start is a restart from the checkpoint
        spark.createDataFrame(rows[at : at + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.keep_best(stream, keys, out, checkpoint).awaitTermination()
        seen = spark.createDataFrame(rows[: at + 50], SCHEMA)
        want = rounds.pick_best(seen, rounds.orders()["gap_batch"])
        assert sorted(map(str, live.current(spark, out).collect())) == sorted(map(str, want.collect()))
