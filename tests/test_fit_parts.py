"""Fits read as many partitions as their rows ask for."""

from stavelake.operators import models


def test_a_fit_reads_as_many_partitions_as_its_rows_ask_for():
    assert [models.fit_parts(*x) for x in ((0, 32, 8), (1000, 200, 12), (60_000, 200, 12), (360_000, 200, 12), (360_000, 5, 12))] == [1, 1, 15, 24, 5]
