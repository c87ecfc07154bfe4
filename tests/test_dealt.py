"""Notes dealt by piece, and nearest vectors of whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.operators import axes, blocks, dose, levers, regions, retrieval
from stavelake.operators.frames import Frames
from stavelake.plans import registry
from stavelake.sources import tables


@pytest.fixture
def star(spark, tmp_path):
    """A few small pieces as lineitem and supplier rows, one of them of null."""
    rows = [(i * 7 + 1, i * 13 % 101, None if i % 11 == 0 else i % 5, i % 7 + 1, float(i % 9 + 1), f"1995-01-{i % 28 + 1:02d}") for i in range(400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(6)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_grouping_by_piece_moves_no_note_again(spark, star):
    fr = registry.frames(spark, star)
    assert fr.dealt
    assert _exchanges(fr.events.groupBy("piece_id", "voice", "abs").count()) == 1
    assert _exchanges(regions.gap_regions(fr).events.groupBy("piece_id", "voice", "abs").count().groupBy("piece_id").count()) <= 3


def _rows(df):
    return sorted(map(tuple, registry.r6(df, "value").collect()), key=repr)


def test_a_piece_too_large_for_a_task_is_spread(spark, star, monkeypatch):
    fr = registry.frames(spark, star)
    whole = _rows(axes.fingerprint(fr))
    gaps = _rows(axes.fingerprint(regions.gap_regions(fr, context=True)))
    monkeypatch.setattr(tables, "WHOLE_PIECE", 10)
    spread = registry.frames(spark, star)
    assert spread.dealt == 0
    assert _rows(axes.fingerprint(spread)) == whole
    assert _rows(axes.fingerprint(regions.gap_regions(spread, context=True))) == gaps


def test_families_are_kept_until_release(spark, star):
    fr = registry.frames(spark, star)
    axes.fingerprint(fr).count()
    assert len(fr.kept) == len(axes.FAMILIES) and all(df.is_cached for df in fr.kept)
    fr.release()
    assert not any(df.is_cached for df in fr.kept)


def _persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_scored_regions_keep_nothing(spark, star):
    """What the fingerprints of regions, contexts and windows kept is released once the scores are written."""
    registry.forget()
    spark.catalog.clearCache()
    c, fr = registry.corpus_of(spark, star), registry.frames(spark, star)
    before = _persisted(spark)
    for context in (False, True):
        assert regions.scored_regions(fr, c, context).count() > 0
    assert regions.within_song_variation(fr, c).count() > 0
    assert registry.region_fitness(spark, star).columns[:2] == ["piece_id", "type"]
    assert _persisted(spark) == before


def test_regions_of_one_type_stay_where_their_pieces_are(spark, star):
    """Regions and contexts, three times the notes, were dealt anew by their own ids."""
    fr = registry.frames(spark, star)
    both = {False: regions.gap_regions(fr), True: regions.gap_regions(fr, context=True)}
    cols = [c for c in both[False].events.columns if c != "piece_id"]
    parts = regions.by_type(fr)
    for context, whole in both.items():
        events = [p[context].events.withColumn("piece_id", F.concat_ws("|", "piece_id", F.lit(t))) for p, t in zip(parts, regions.CUTS)]
        pieces = regions.all_types(p[context].pieces.select("piece_id", "source_id", "type", "genre", "n_bars") for p in parts)
        got = sorted(map(repr, (r for e in events for r in e.select("piece_id", *cols).collect())))
        assert got == sorted(map(repr, whole.events.select("piece_id", *cols).collect())) and len(got) > 0
        assert sorted(map(repr, pieces.collect())) == sorted(map(repr, whole.pieces.select(*pieces.columns).collect()))
        for p in parts:
            grouped = p[context].events.groupBy("piece_id", "voice", "abs").count()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in grouped.split("InMemoryRelation")[0]
    fr.release()


def test_claims_and_corpus_keep_nothing(spark, star):
    """Notes were dealt again for every level of a fingerprint and every kind of claim; now they are kept, and released."""
    registry.forget()
    spark.catalog.clearCache()
    before = _persisted(spark)
    registry.corpus_of(spark, star)
    assert registry.claim_grades(spark, star).count() > 0
    assert _persisted(spark) == before


def test_dose_study_in_groups_of_levers(spark, star, monkeypatch):
    """One lever at a time gives the rows of all at once, and a lever's notes are gone before the next one's are made."""
    some = ("har_chromaticism", "rhy_dur_cv", "within_song_variation")
    monkeypatch.setattr(levers, "LEVERS", {k: levers.LEVERS[k] for k in some})
    held, made = [], dose.variants
    monkeypatch.setattr(dose, "variants", lambda *a, **k: held.append(_persisted(spark)) or made(*a, **k))
    fr = registry.frames(spark, star)

    def rows():
        held.clear()
        spark.catalog.clearCache()
        variation = lambda f: f.pieces.select("piece_id", (F.length("piece_id") * 1.0).alias("wsv"))
        return sorted(map(tuple, dose.study(fr, (0.0, 0.5), variation).collect()), key=repr), list(held)

    whole, once = rows()
    monkeypatch.setattr(dose, "STUDIED", 1)
    single, thrice = rows()
    assert single == whole and len(whole) > 0
    assert len(once) == 2 and len(thrice) == 4 and len(set(thrice)) == 1


@pytest.mark.parametrize("dims", [1, 2, 39])
def test_sums_of_bytes(dims):
    rng = np.random.default_rng(dims)
    q, c = rng.integers(0, 101, (20, dims)).astype(float), rng.integers(0, 101, (50, dims)).astype(float)
    q[0], c[0] = 0, 100
    assert np.array_equal(np.round(retrieval._sums(retrieval._bytes(q), retrieval._bytes(c)) / dims, 9), retrieval._l1(q, c))


@pytest.mark.parametrize("odd", [0.5, -1.0, 101.0, np.nan])
def test_only_percentiles_are_bytes(odd):
    assert retrieval._bytes(np.array([[1.0, odd]])) is None


@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_whole_numbers_with_copies(spark, exclude):
    """Many ties and copies over several tiles of a block, repeated keys: as by sorting all distances."""
    rng = np.random.default_rng(3)
    tall = 8 * retrieval.TILE_C
    rows = [(int(k), [float(x) for x in rng.integers(0, 9, 4)]) for k in [*rng.permutation(tall), 5, 9]]
    df = spark.createDataFrame(rows, "key long, vec array<double>").repartition(2)
    asked = df.where("key % 97 = 1")
    _, n_c = blocks.grid(1, 1, spark.sparkContext.defaultParallelism)
    assert tall > 1.5 * retrieval.TILE_C * n_c
    got = sorted((r["key"], r["rank"], r["neighbor"], r["dist"]) for r in retrieval.nearest(asked, df, exclude_self=exclude).collect())
    want, keys, vecs = [], np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    for key, vec in rows:
        if key % 97 != 1:
            continue
        dist = np.round(np.abs(vecs - np.array(vec)).sum(axis=1) / 4, 9)
        dist[(keys == key) & exclude] = np.inf
        want += [(key, i + 1, int(keys[at]), float(dist[at])) for i, at in enumerate(np.lexsort((keys, dist))[:3])]
    assert got == sorted(want)


def test_frames_without_dealing(spark):
    assert Frames(None, None).dealt == 0
