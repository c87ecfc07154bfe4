"""Mixing sources to target weights by cube-method balanced sampling.

Sources, ordered by code point (null last), take the weights in turn and share a multiple of all words; a target stops
at a multiple of its source's words and the excess is reshared by weight. A document is taken ``floor(ratio)`` times
for sure and once more with the fractional rest as inclusion probability. The flight phase of the cube method moves the
probabilities of three open documents at a time along the null space of the balancing constraints (word total and
document total of the source), so each step settles one document and keeps both totals. Blocks of a source fly in
parallel; the few documents that a block leaves open meet in the next level, and the last level lands the at most two
that are still open on the side that misses the word total least.

Blocks bound what a task holds, so a source with a third of all rows spreads over the cluster. Random numbers depend on
seed, source, level and block only and documents are put in a fixed order first, so reruns agree.

Ids pass the flight as strings: pandas would turn a column of numbers with a null in it into doubles.

Defined results: a null text has no words; a null source is a source of its own, last in order; rows with equal
doc_id (null included), source and size are one unit and share a decision; documents without words are decided by the
document total alone and take nothing; an empty table gives an empty result. All columns of the documents are kept; only
columns named ``mix_size`` or ``mix_copies`` (case aside) are replaced by the results of these names.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.llm.common import WORD, cut, unused

EPSILON = 1e-9


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block: int = 4096
    seed: int = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, source, size) with the number of rows that have them."""
    sized = docs.select("doc_id", "source", n_words(docs["text"]).alias("size"))
    return sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))


def targets(per_unit: DataFrame, mix: Mix) -> DataFrame:
    """Per source: words, target and number of blocks.

    With sources in ascending order of cap over weight, the level (rest to share / rest of the weights) rises while
    capped sources are passed and falls afterwards, so its maximum is the one at which nobody is above the cap.
    The windows run over one row per source.
    """
    per = per_unit.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_units")
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(mix.weights) + 1
    per = per.select(
        "*", F.element_at(F.array(*map(F.lit, mix.weights)), turn).alias("weight"), (F.col("source_size") * mix.cap).alias("cap")
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = mix.share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = per.select("*", (rest / weight).alias("own_level"))
    leveled = leveled.select("*", F.max("own_level").over(everyone).alias("level"))
    return leveled.select(
        "source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"),
        F.ceil(F.col("n_units") / mix.block).cast("long").alias("n_blocks"),
    )


def fly(chance: list[float], size: list[float], rng: random.Random, land: bool) -> None:
    """Settle ``chance`` in place; at most two entries stay open, none after landing."""
    waiting = (i for i, p in enumerate(chance) if EPSILON < p < 1 - EPSILON)
    active: list[int] = []
    while True:
        active = [i for i in active if EPSILON < chance[i] < 1 - EPSILON]
        active += itertools.islice(waiting, 3 - len(active))
        if len(active) < 3:
            break
        a, b, c = (size[i] for i in active)
        move(chance, active, (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0), rng)
    if land and active:
        def miss(choice):
            off = sum((z - chance[i]) * size[i] for z, i in zip(choice, active))
            return abs(off), abs(sum(z - chance[i] for z, i in zip(choice, active)))
        for i, z in zip(active, min(itertools.product((0.0, 1.0), repeat=len(active)), key=miss)):
            chance[i] = z


def move(chance: list[float], active: list[int], step: tuple[float, ...], rng: random.Random) -> None:
    """Go along the direction or against it until a probability reaches 0 or 1; the odds keep expectations."""
    def room(sign: float) -> float:
        return min(((1 - chance[i]) if sign * u > 0 else chance[i]) / abs(u) for i, u in zip(active, step) if u)

    ahead, back = room(1.0), room(-1.0)
    by = ahead if rng.random() * (ahead + back) < back else -back
    for i, u in zip(active, step):
        moved = chance[i] + by * u
        chance[i] = 0.0 if moved <= EPSILON else 1.0 if moved >= 1 - EPSILON else moved


def _flight(level: int, land: bool, seed: int):
    def one_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "order", "doc_id"], ascending=[False, True, True], kind="mergesort")
        source, block = rows["source"].iloc[0], rows["block"].iloc[0]
        chance, size = rows["chance"].tolist(), rows["weight"].tolist()
        fly(chance, size, random.Random(f"{seed}|{source!r}|{level}|{block}"), land)
        return rows.assign(chance=chance)

    return one_block


def decisions(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per unit: doc_id, source, size, rows, source_size, target, copies."""
    per_unit = cut(units(docs))
    per_source = cut(targets(per_unit, mix))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    order = F.xxhash64(F.lit(mix.seed), "doc_id", "size")
    start = per_unit.join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "rows", "source_size", "target",
        F.floor(ratio).alias("copies"), (ratio - F.floor(ratio)).alias("chance"),
        (F.col("size") * F.col("rows")).cast("double").alias("weight"), order.alias("order"),
        F.pmod(order, F.col("n_blocks")).alias("block"),
    )
    most = per_source.agg(F.max("n_blocks")).first()[0] or 1
    fan_in = max(2, mix.block // 2)
    settled, level, done = None, 0, []
    while True:
        land = most <= 1
        settled = cut(start.groupBy("source", "block").applyInPandas(_flight(level, land, mix.seed), start.schema))
        if land:
            done.append(settled)
            break
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(settled.where(~is_open))
        start = settled.where(is_open).withColumn("block", F.floor(F.col("block") / fan_in))
        most, level = -(-most // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("doc_id").cast(per_unit.schema["doc_id"].dataType).alias("doc_id"), "source", "size", "rows", "source_size", "target",
        (F.col("copies") + F.when(F.col("chance") > 0.5, 1).otherwise(0)).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The taken documents with their columns, and how often each is repeated, as ``mix_copies``."""
    doc, source = unused(docs, "mix_doc", "mix_source")
    taken = decisions(docs, mix).where("copies > 0").select(
        F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies")
    )
    own = docs.select(*(docs[c] for c in docs.columns if c.lower() not in ("mix_size", "mix_copies")))
    joined = own.join(
        taken, own["doc_id"].eqNullSafe(taken[doc]) & own["source"].eqNullSafe(taken[source]) & (n_words(own["text"]) == taken["mix_size"])
    )
    return joined.select(*(own[c] for c in own.columns), "mix_size", "mix_copies")
