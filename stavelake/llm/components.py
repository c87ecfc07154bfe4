"""Connected components of an edge list by alternating large and small stars, each star a grouped minimum and a join.

The minima are written before they are joined, so that the join can split the edges of a node with very many neighbours.
There are never more edges than at first, so what a round writes is dealt to as many tasks as that number asks for, not to
every shuffle partition of the session: a round's files follow the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import cut, pieces

#: Edges of a task.
EDGES = 1 << 16


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every greater neighbour of u is linked to the least of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("centre"), F.least("u", "m").alias("m"))
    joined = around.where("v > u").join(cut(least.coalesce(parts)), F.col("u") == F.col("centre"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """u and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "centre")
    joined = down.join(cut(least.coalesce(parts)), F.col("u") == F.col("centre"))
    moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.*").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not its component's root, the least of its nodes."""
    now, before, parts = cut(edges.select("u", "v").where("u <> v").distinct()), None, 0
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        parts = parts or pieces(state[0], EDGES)
        before, now = state, now.coalesce(parts)
        now = cut(_small_star(_large_star(now, parts), parts).coalesce(parts))
