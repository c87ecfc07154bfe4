"""All-against-all comparison: what a grid copies, and the overlap kernel against a count by hand."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stavelake.operators import overlap, retrieval
from stavelake.operators.blocks import BLOCK_VALUES, block_pairs, block_pairs_within, grid, triangle


def test_rows_are_copied_by_cores_not_by_rows(spark):
    """5,000 rows a side were copied ten times each, and ever more often with more rows."""
    df = spark.range(5000).select(F.col("id").alias("key"), F.array(F.col("id").cast("double")).alias("vec"))
    fed = block_pairs(df, df, lambda q, c: pd.DataFrame({"n": [len(q) * len(c)], "rows": [len(q) + len(c)]}), "n long, rows long")
    pairs, rows = fed.agg(F.sum("n"), F.sum("rows")).first()
    n_q, n_c = grid(5000, 5000, spark.sparkContext.defaultParallelism)
    assert pairs == 5000 * 5000 and rows == 5000 * (n_q + n_c)
    assert grid(5_000, 5_000, 12) == grid(BLOCK_VALUES, BLOCK_VALUES, 12) == (5, 5)
    assert grid(9 * BLOCK_VALUES, BLOCK_VALUES, 12) == (9, 3)


def _best(rows, songs):
    """Hits, bag, song and offset of every row's best partner, cell by cell."""
    out = {}
    for key, cells in rows.items():
        for song, theirs in songs.items():
            if song == key:
                continue
            shifts = {}
            for kind, bar in cells:
                for other, at in theirs:
                    if kind == other:
                        shifts[at - bar] = shifts.get(at - bar, 0) + 1
            offset, hits = min(shifts.items(), key=lambda kv: (-kv[1], kv[0])) if shifts else (0, 0)
            kinds = {k for k, _ in cells}
            bag = len(kinds & {k for k, _ in theirs}) / len(kinds)
            out[key] = max(out.get(key, (-1, 0.0, 0, 0)), (hits, bag, song, offset))
    return out


def test_tiles_count_every_shift(monkeypatch):
    rng = np.random.default_rng(5)
    cells = {k: {(int(rng.integers(0, 12)), int(rng.integers(-3, 9))) for _ in range(rng.integers(1, 40))} for k in range(23)}
    frame = pd.DataFrame([(k, len(c), [x for x, _ in c], [b for _, b in c]) for k, c in cells.items()], columns=["key", "total", "kinds", "bars"])
    for tile, matches, counts in ((128, 1 << 21, 1 << 21), (4, 7, 1 << 21), (5, 64, 1)):
        for name, value in (("TILE", tile), ("MATCHES", matches), ("COUNTS", counts)):
            monkeypatch.setattr(overlap, name, value)
        got = overlap._kernel(True, None)(frame, frame)
        assert {r.piece_id: (r.hits, r.bag, r.song, r.bar_offset) for r in got.itertuples()} == _best(cells, cells)


def _frame(cells):
    return pd.DataFrame([(k, len(c), [x for x, _ in c], [b for _, b in c]) for k, c in cells.items()], columns=["key", "total", "kinds", "bars"])


def _found(got):
    return {r.piece_id: (r.hits, r.bag, r.song, r.bar_offset) for r in got.itertuples()}


def test_dense_pieces_are_counted_without_a_list_of_matches(monkeypatch):
    """Every match of every pair was written out and counted one by one, 3.8 microseconds a pair of 600 notes."""
    rng = np.random.default_rng(6)
    cells = {k: {(int(rng.integers(0, 20)), int(rng.integers(-3, 29))) for _ in range(rng.integers(200, 500))} for k in range(40)}
    cells |= {k: {(kind, bar + 2) for kind, bar in cells[k - 30]} for k in range(40, 45)}  # more hits than a byte holds
    monkeypatch.setattr(overlap, "_listed_hits", None)
    for name, value in (("CALL_NS", 0.0), ("BYTE_NS", 0.0)):
        monkeypatch.setattr(overlap, name, value)
    want = _best(cells, cells)
    assert max(hits for hits, *_ in want.values()) > 255
    for tile, held in ((2048, 1 << 20), (7, 1 << 11)):
        monkeypatch.setattr(overlap, "TILE_C", tile)
        monkeypatch.setattr(overlap, "HELD", held)
        assert _found(overlap._kernel(True, None)(_frame(cells), _frame(cells))) == want


def test_two_blocks_answer_for_each_other():
    rng = np.random.default_rng(7)
    cells = {k: {(int(rng.integers(0, 6)), int(rng.integers(0, 9))) for _ in range(rng.integers(5, 30))} for k in range(31)}
    left, right = ({k: c for k, c in cells.items() if k % 3 // 2 == side} for side in (0, 1))
    got = _found(overlap._kernel(True, None)(_frame(left), _frame(right), mirrored=True))
    assert got == _best(left, right) | _best(right, left)


def test_top_bags_of_a_block_are_slid():
    rng = np.random.default_rng(8)
    cells = {k: {(int(rng.integers(0, 60)), int(rng.integers(0, 9))) for _ in range(rng.integers(5, 90))} for k in range(300)}
    got = overlap._kernel(True, 4)(_frame(cells), _frame(cells))
    kinds = {k: {x for x, _ in c} for k, c in cells.items()}
    for key, rows in got.groupby("piece_id"):
        bags = sorted(((len(kinds[key] & kinds[k]) / len(kinds[key]), k) for k in cells if k != key), reverse=True)[:4]
        assert sorted(zip(rows["bag"], rows["song"]), reverse=True) == bags
        for r in rows.itertuples():
            assert (r.hits, r.bag, r.song, r.bar_offset) == _best({key: cells[key]}, {r.song: cells[r.song]})[key]


def test_blocks_of_one_table_meet_once(spark):
    """Each pair of blocks was compared twice, once from either side."""
    df = spark.range(2000).select(F.col("id").alias("key"), F.array(F.col("id")).alias("vec"))

    def kernel(q, c, mirrored):
        assert mirrored or set(q["key"]) == set(c["key"])
        return pd.DataFrame({"n": [len(q) * len(c)], "both": [mirrored]})

    n = triangle(2000, spark.sparkContext.defaultParallelism)
    met = block_pairs_within(df, kernel, "n long, both boolean")
    assert met.count() == n * (n + 1) // 2 and triangle(9 * BLOCK_VALUES, 12) == 9
    assert met.select(F.sum(F.when(F.col("both"), 2 * F.col("n")).otherwise(F.col("n")))).first()[0] == 2000 * 2000


def test_copies_across_blocks_are_found(spark):
    """Pieces in pairs of copies, without ids in a row; a null id is a song, but asks for none."""
    rng = np.random.default_rng(9)
    tunes = [[(int(rng.integers(1, 33)), int(rng.integers(0, 16)) / 4, int(rng.integers(36, 84))) for _ in range(60)] for _ in range(40)]
    rows = [(10 * i + k, *note) for i, tune in enumerate(tunes) for k in (1, 2) for note in tune]
    rows += [(None, *note) for note in tunes[0]]
    df = spark.createDataFrame(rows, "piece_id long, bar int, onb double, midi int")
    got = {r["piece_id"]: (r["song"], r["hits"], r["bar_offset"]) for r in overlap.corpus_overlap(df, df).collect()}
    for i, tune in enumerate(tunes):
        n = len(set(tune))
        assert got[10 * i + 1] == (10 * i + 2, n, 0) and got[10 * i + 2] == (10 * i + 1, n, 0)


def test_notes_without_a_place_match_nothing(spark):
    """A note without a bar or pitch made the query fail."""
    rows = [(1, 1, 0.0, 60), (1, 2, 1.0, 62), (1, None, 2.0, 64), (2, 4, 0.0, 60), (2, 5, 1.0, None), (2, None, 2.0, 64)]
    df = spark.createDataFrame(rows, "piece_id long, bar int, onb double, midi int")
    got = {r["piece_id"]: (r["song"], r["hits"], r["total"], r["bar_offset"]) for r in overlap.corpus_overlap(df, df).collect()}
    assert got == {1: (2, 1, 3, 3), 2: (1, 1, 3, -3)}


def test_least_keeps_earlier_places_and_skips_what_is_not_finite():
    d = np.array([[2.0, 1.0, 1.0, np.inf, 1.0], [np.inf, np.nan, 5.0, np.inf, np.inf]])
    assert retrieval._least(d, 3).tolist() == [[1, 2, 4], [2, -1, -1]]


def test_nearest_across_tiles(spark):
    """More rows than a tile holds, with many equal distances."""
    rng = np.random.default_rng(11)
    n = retrieval.TILE_C + 200
    vec = rng.integers(0, 3, (n, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "key long, vec array<double>")
    got = {}
    for r in retrieval.nearest(df, df, 3).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append((r["dist"], r["neighbor"]))
    for i in range(n):
        d = np.round(np.abs(vec - vec[i]).mean(axis=1), 9)
        d[i] = np.inf
        assert got[i] == [(d[j], j) for j in np.lexsort((np.arange(n), d))[:3]]


def test_farther_vectors_are_counted_by_bytes(spark, monkeypatch):
    """Whole percentiles were compared as floats, at a third of the speed."""
    rng = np.random.default_rng(12)
    vec, songs = rng.integers(0, 101, (40, 39)).astype(float), rng.integers(0, 101, (1100, 39)).astype(float)
    limit = [float(np.abs(songs[i] - vec[i]).mean()) if i % 2 else 30.0 + i / 3 for i in range(40)]
    cases = spark.createDataFrame([(i, v.tolist(), d) for i, (v, d) in enumerate(zip(vec, limit))], "key long, vec array<double>, d_gr double")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(songs)], "key long, vec array<double>")
    monkeypatch.setattr(retrieval, "_l1", None)
    got = {r["key"]: (r["farther"], r["n"]) for r in retrieval.farther(cases, corpus).collect()}
    assert got == {i: (int((np.round(np.abs(songs - vec[i]).mean(axis=1), 9) > round(limit[i], 9)).sum()), 1100) for i in range(40)}
