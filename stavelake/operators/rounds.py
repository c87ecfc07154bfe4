"""Bounded closed loops: score all candidates of a round in one job, keep the best, stop what has converged."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.session import cut_lineage


class Generator(Protocol):
    """Makes the next candidates from (case_id, feedback); an external model sits behind this."""

    def generate(self, cases: DataFrame, round_no: int) -> DataFrame: ...


class Echo:
    """Stub generator: returns the same candidates every round."""

    def __init__(self, candidates: DataFrame):
        self.candidates = candidates

    def generate(self, cases: DataFrame, round_no: int) -> DataFrame:
        return self.candidates.join(cases.select("case_id"), "case_id", "left_semi")


FAILED = 9999.0


def _asc(*cols: str) -> list[Column]:
    return [F.col(c).asc() for c in cols]


def orders() -> dict[str, list[Column]]:
    """Pick-best orderings per task; the earliest round always wins what is left."""
    return {
        "newgen": _asc("score"),
        "newgen_batch": _asc("copy_over", "off_target", "extremes", "copy"),
        "gap": _asc("score"),
        "gap_batch": [F.col("copy_fails").asc(), F.coalesce("score", F.lit(FAILED)).asc()],
        "morph": [F.coalesce("morph_score", F.lit(-1.0)).desc()],
        "drums": [F.col(c).desc() for c in ("groove_fit", "rhythm_sim", "kit")],
        "part": [F.col(c).desc() for c in ("fit", "beat_pct", "improved")],
        "drill": [F.col("verdict").desc(), F.col("failed_checks").asc()],
        "audition": _asc("copy_fails", "score", "copy", "path"),
    }


def pick_best(results: DataFrame, order: list[Column]) -> DataFrame:
    """One row per case: best by ``order``, earlier round on ties. A case has a bounded number of rounds."""
    w = W.partitionBy("case_id").orderBy(*order, "round")
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def run(cases: DataFrame, generator: Generator, score: Callable[[DataFrame], DataFrame], order: list[Column],
        stop: str = "converged", max_rounds: int = 5) -> DataFrame:
    """Best round per case. Each round is one job over the cases still open; lineage is cut per round."""
    open_cases, history = cut_lineage(cases), None
    for round_no in range(1, max_rounds + 1):
        scored = score(generator.generate(open_cases, round_no)).withColumn("round", F.lit(round_no))
        history = cut_lineage(scored if history is None else history.unionByName(scored))
        done = history.filter(F.col(stop)).select("case_id").distinct()
        open_cases = cut_lineage(open_cases.join(done, "case_id", "left_anti"))
        if open_cases.isEmpty():
            break
    return pick_best(history, order)


def loop_benefit(results: DataFrame, metric: str, order: list[Column]) -> DataFrame:
    """First round against best round per case."""
    first = results.filter("round = 1").select("case_id", F.col(metric).alias("first"))
    best = pick_best(results, order).select("case_id", F.col(metric).alias("best"), F.col("round").alias("best_round"))
    return first.join(best, "case_id").withColumn("gain", F.col("best") - F.col("first"))
