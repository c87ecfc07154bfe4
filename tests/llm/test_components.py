"""Components: the least node is the root, and a round's files follow the edges, not the session's shuffle partitions."""

from stavelake.llm.components import components


def test_small_graphs_make_few_files_whatever_the_shuffle_partitions(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (None, 7)], "u long, v long")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    held = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("64", "false")):
            spark.conf.set(name, value)
        found = components(edges)
        assert found.rdd.getNumPartitions() <= 8
        assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(100, 99)}
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
