"""Exact all-against-all comparison in bounded blocks.

Both sides are hashed into a grid of blocks; each block pair is one task that keeps only what the query rows need (their
best partners), never the pairs themselves. Where a table meets itself and a pair is the same both ways, two blocks meet once.
A row is copied once per block of the other side, so the grid has only as many
blocks as keep every core busy, and more only where a block would hold too many values: what is shuffled grows with the
input, not with the number of pairs. Nothing is broadcast or sent through the driver, and a large group of equal rows is
spread over blocks like any other rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

#: Array values of a block at most, which bounds a task's memory, and tasks for each core.
BLOCK_VALUES = 1 << 23
TASKS_PER_CORE = 2


def _volume(df: DataFrame) -> tuple[int, int]:
    """Rows, and the values in their arrays (a row counts as one at least)."""
    held = sum((F.coalesce(F.size(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, ArrayType)), F.lit(0))
    found = df.agg(F.count(F.lit(1)), F.sum(F.greatest(held, F.lit(1)))).first()
    return found[0], found[1] or 0


def grid(query_values: int, corpus_values: int, cores: int) -> tuple[int, int]:
    """How many blocks the two sides are cut into."""
    n_q = max(math.ceil(math.sqrt(TASKS_PER_CORE * cores)), math.ceil(query_values / BLOCK_VALUES))
    n_c = max(math.ceil(TASKS_PER_CORE * cores / n_q), math.ceil(corpus_values / BLOCK_VALUES))
    return n_q, n_c


def triangle(values: int, cores: int) -> int:
    """How many blocks a table is cut into whose pairs of blocks are met once."""
    n = math.ceil(values / BLOCK_VALUES)
    while n * (n + 1) // 2 < TASKS_PER_CORE * cores:
        n += 1
    return n


def block_pairs(
    queries: DataFrame,
    corpus: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``kernel(query_rows, corpus_rows)`` on every block pair. Both sides carry a ``key`` column.

    ``block_rows`` sets the rows of a block; otherwise the cores and the values in the arrays do.
    """
    (rows_q, values_q), (rows_c, values_c) = _volume(queries), _volume(corpus)
    n_q, n_c = grid(values_q, values_c, queries.sparkSession.sparkContext.defaultParallelism)
    if block_rows:
        n_q, n_c = max(1, math.ceil(rows_q / block_rows)), max(1, math.ceil(rows_c / block_rows))
    kinds = {"q": queries.schema, "c": corpus.schema}
    made = to_arrow_schema(StructType.fromDDL(schema))

    def placed(df: DataFrame, side: str, own: int, other: int) -> DataFrame:
        """Every row in its block, once for each block of the other side."""
        held = [(F.struct(*df.columns) if k == side else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]
        return df.select(*held, F.pmod(F.xxhash64("key"), F.lit(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))

    left = placed(queries, "q", n_q, n_c).select("q", "c", (F.col("own") * n_c + F.col("other")).alias("pair"))
    right = placed(corpus, "c", n_c, n_q).select("q", "c", (F.col("other") * n_c + F.col("own")).alias("pair"))

    # A pair's number is its partition: one task holds one pair of blocks.
    fed = left.unionAll(right).repartitionById(n_q * n_c, F.col("pair"))
    return fed.mapInArrow(lambda batches: _compared(batches, lambda q, c, _: kernel(q, c), made), schema)


def block_pairs_within(rows: DataFrame, kernel: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Run ``kernel`` on every pair of blocks of one table, where a pair of rows is the same both ways.

    Two different blocks meet once, as ``kernel(rows, other_rows, mirrored=True)``, which answers for the rows of both; a block
    meets itself as ``kernel(rows, rows, mirrored=False)``. ``rows`` carries a ``key`` column.
    """
    n = triangle(_volume(rows)[1], rows.sparkSession.sparkContext.defaultParallelism)
    held, own, other = F.struct(*rows.columns), F.col("own"), F.col("other")
    low, high = F.least(own, other), F.greatest(own, other)
    met = rows.select(held.alias("row"), F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    fed = met.select(
        F.when(own <= other, F.col("row")).alias("q"), F.when(own >= other, F.col("row")).alias("c"),
        (F.shiftright(high * (high + 1), 1) + low).alias("pair"),
    ).repartitionById(n * (n + 1) // 2, F.col("pair"))
    made, itself = to_arrow_schema(StructType.fromDDL(schema)), {i * (i + 1) // 2 + i for i in range(n)}
    return fed.mapInArrow(lambda batches: _compared(batches, lambda q, c, pair: kernel(q, c, mirrored=pair not in itself), made), schema)


def _compared(batches: Iterator[pa.RecordBatch], kernel: Callable[..., pd.DataFrame], made: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, pair = {"q": [], "c": []}, -1
    for batch in batches:
        for side, parts in held.items():
            rows = batch.column(side)
            parts.append(pa.RecordBatch.from_struct_array(rows.filter(rows.is_valid())))
        if len(batch):
            pair = batch.column("pair")[0].as_py()
    if held["q"]:
        found = kernel(*(pa.Table.from_batches(parts).to_pandas() for parts in held.values()), pair)
        yield from pa.Table.from_pandas(found, schema=made, preserve_index=False).to_batches()
