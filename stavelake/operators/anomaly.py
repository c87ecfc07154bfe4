"""Labelled anomalies: six one-edit injectors, the six-check verifier, the bar heuristic and detection metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import bits
from stavelake.functions import numeric as num
from stavelake.operators.axes import MAJOR, MINOR

MARGIN = 2
KINDS = ("out_of_key", "wrong_bass", "dissonance", "meter_glitch", "voice_crossing", "parallel_fifths")
TOKEN = ["piece_id", "bar", "voice", "voice_ix", "slot", "dur_slots"]


def key_mask(tonic: Column, mode: Column) -> Column:
    """Pitch-class mask of a major or natural-minor key."""
    def mask(scale):
        return sum(1 << d for d in scale)

    base = F.when(mode == "minor", F.lit(mask(MINOR))).otherwise(F.lit(mask(MAJOR)))
    return bits.rotate_down(base, F.pmod(-tonic, F.lit(12)).cast("int"))


def tokens(notes: DataFrame) -> DataFrame:
    """Distinct pitches of every token, bounded by the pitch range."""
    return notes.groupBy(*TOKEN, "is_drum").agg(F.sort_array(F.collect_set("midi")).alias("midis"))


def _interior(toks: DataFrame, seed: int) -> DataFrame:
    """Tokens of interior bars with a seeded bar order; a piece without interior bars offers all of them."""
    w = W.partitionBy("piece_id")
    bars = toks.select("piece_id", "bar").distinct().withColumn("ix", F.row_number().over(w.orderBy("bar"))).withColumn("k", F.count(F.lit(1)).over(w))
    inner = (F.col("ix") > MARGIN) & (F.col("ix") <= F.col("k") - MARGIN)
    bars = bars.withColumn("any", F.max(inner).over(w)).filter(inner | ~F.col("any"))
    draw = num.chance(f"bar{seed}", F.col("piece_id"), F.col("bar"))
    return toks.join(bars.select("piece_id", "bar", draw.alias("draw")), ["piece_id", "bar"])


def _first_site(sites: DataFrame, *fields: str) -> DataFrame:
    """First site in seeded bar order, then voice and slot order; one per piece."""
    order = F.struct("draw", "bar", "voice_ix", "slot", "dur_slots")
    pick = F.min_by(F.struct("bar", "voice", "voice_ix", "slot", "dur_slots", *fields), order)
    return sites.groupBy("piece_id").agg(pick.alias("s")).select("piece_id", "s.*")


def site(notes: DataFrame, kind: str, seed: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """Where and how ``kind`` would be injected: old and new pitches (or duration) of one token per piece.

    ``keys`` holds (piece_id, key) as a pitch-class mask and is needed for out_of_key.
    """
    t = _interior(tokens(notes), seed)
    first, n = F.col("midis")[0], F.size("midis")
    if kind == "out_of_key":
        def inside(m):
            return F.col("key").bitwiseAND(bits.pc_bit(F.pmod(m, F.lit(12)))) != 0

        up, down = first + 1, first - 1
        new = F.when(~inside(up), up).when(~inside(down), down)
        s = t.join(keys, "piece_id").filter((n == 1) & inside(first)).withColumn("new", F.array(new)).filter(new.isNotNull())
    elif kind == "wrong_bass":
        named = F.lower("voice").contains("bass")
        has = F.max(named).over(W.partitionBy("piece_id", "bar"))
        rest = F.slice("midis", F.lit(2), F.greatest(F.lit(0), n - 1))
        s = t.withColumn("has", has).filter(named | ~F.col("has")).withColumn("new", F.concat(F.array(first + 6), rest))
    elif kind == "dissonance":
        s = t.filter((n >= 2) & ~F.array_contains("midis", first + 1)).withColumn("new", F.concat("midis", F.array(first + 1)))
    elif kind == "meter_glitch":
        s = t.withColumn("new", F.array(F.col("dur_slots") + 6))
    elif kind == "voice_crossing":
        p = t.filter(~F.col("is_drum"))
        by_bar = p.groupBy("piece_id", "bar").agg(F.max(first).alias("top"), F.count_distinct("voice").alias("lines"))
        s = p.join(by_bar, ["piece_id", "bar"]).filter((F.col("lines") >= 2) & (n == 1) & (first < F.col("top"))).withColumn("new", F.array(F.col("top") + 2))
    else:
        raise ValueError(f"no single-token site for {kind!r}")
    return _first_site(s.withColumnRenamed("midis", "old"), "old", "new").withColumn("kind", F.lit(kind))


def parallel_site(notes: DataFrame, seed: int = 0) -> DataFrame:
    """Two consecutive moving single notes of one voice with another voice striking both slots."""
    t = _interior(tokens(notes).filter(~F.col("is_drum")), seed)
    w = W.partitionBy("piece_id", "bar", "voice_ix").orderBy("slot", "dur_slots")
    a = t.select(
        "piece_id", "bar", "draw", F.col("voice_ix").alias("a"), F.col("slot").alias("s1"), F.lead("slot").over(w).alias("s2"),
        F.col("midis").alias("m1"), F.lead("midis").over(w).alias("m2"),
    ).filter((F.col("s1") < F.col("s2")) & (F.size("m1") == 1) & (F.size("m2") == 1) & (F.col("m1")[0] != F.col("m2")[0]))
    slots = t.select("piece_id", "bar", "voice", F.col("voice_ix").alias("b"), "slot").distinct()
    hit = (
        a.join(slots.withColumnRenamed("slot", "s1"), ["piece_id", "bar", "s1"])
        .join(slots.drop("voice").withColumnRenamed("slot", "s2"), ["piece_id", "bar", "s2", "b"])
        .filter("a <> b")
    )
    pick = F.min_by(F.struct("bar", "voice", F.col("b").alias("voice_ix"), "s1", "s2", "m1", "m2"), F.struct("draw", "bar", "a", "s1", "b"))
    return hit.groupBy("piece_id").agg(pick.alias("s")).select(
        "piece_id", "s.bar", "s.voice", "s.voice_ix", "s.s1", "s.s2", (F.col("s.m1")[0] - 7).alias("new1"), (F.col("s.m2")[0] - 7).alias("new2")
    )


def inject(notes: DataFrame, sites: DataFrame) -> DataFrame:
    """Apply single-token sites; every other note row is returned unchanged."""
    keys = ["piece_id", "bar", "voice", "slot", "dur_slots"]
    at = notes.join(sites.select(*keys, "new", "kind"), keys, "left")
    kept = at.filter("kind is null").drop("new", "kind")
    hit = at.filter("kind is not null").groupBy(*keys, "new", "kind").agg(
        *[F.min(c).alias(c) for c in notes.columns if c not in keys]
    )
    meter = F.col("kind") == "meter_glitch"
    longer = hit.filter(meter).withColumn("dur_slots", F.col("new")[0])
    # a lengthened token keeps all its pitches
    pitches = at.filter("kind is not null").filter(meter).select(*keys, "midi").distinct()
    longer = longer.drop("midi").join(pitches.withColumnRenamed("dur_slots", "_d"), ["piece_id", "bar", "voice", "slot"])
    repitched = hit.filter(~meter).withColumn("midi", F.explode("new"))
    return reduce(DataFrame.unionByName, [kept, longer.select(*kept.columns), repitched.select(*kept.columns)])


def inject_parallel(notes: DataFrame, sites: DataFrame) -> DataFrame:
    at = notes.join(sites.select("piece_id", "bar", "voice", "s1", "s2", "new1", "new2"), ["piece_id", "bar", "voice"], "left")
    new = F.when(F.col("slot") == F.col("s1"), F.col("new1")).when(F.col("slot") == F.col("s2"), F.col("new2")).otherwise(F.col("midi"))
    return at.withColumn("midi", new.cast("int")).select(*notes.columns)


# -- verification ----------------------------------------------------------------------------
# Fixed value: the four-part order from low to high.
PART_ORDER = ("bass", "tenor", "alto", "soprano")


def verify(notes: DataFrame, keys: DataFrame, bar_slots: int = 16) -> DataFrame:
    """Flags (piece_id, bar, kind) of the six checks on pitched notes."""
    p = notes.filter(~F.col("is_drum"))
    bars = p.groupBy("piece_id", "bar").agg(
        F.bit_or(bits.pc_bit(F.col("midi") % 12)).alias("pcs"), F.min("midi").alias("lo"), F.sort_array(F.collect_set("midi")).alias("midis")
    ).join(keys, "piece_id")
    over = notes.filter(F.col("slot") + F.col("dur_slots") - 1 > bar_slots).select("piece_id", "bar").distinct()
    outside = bars.filter(F.col("pcs").bitwiseAND(F.lit(bits.FULL) - F.col("key")) != 0)
    cluster = bars.filter(F.exists("midis", lambda m: F.array_contains("midis", m + 1)))
    roots = [F.when(bits.contains_all(F.col("pcs"), (r + 4, r + 7)) & bits.has(F.col("pcs"), r), r).when(
        bits.contains_all(F.col("pcs"), (r, r + 3, r + 7)), r) for r in range(12)]
    bass = bars.withColumn("root", F.coalesce(*roots)).filter(F.col("root").isNotNull() & (F.col("lo") % 12 != F.col("root")))
    parts = four_parts(p)
    crossed = parts.filter(F.col("seq") != F.sort_array("seq"))
    w = W.partitionBy("piece_id").orderBy("bar")
    moving = parts.withColumn("before", F.lag("seq").over(w)).filter(F.col("before").isNotNull())
    parallel = moving.filter(reduce(lambda a, b: a | b, [_parallel(i, j) for i in range(4) for j in range(i + 1, 4)]))
    flagged = zip(("out_of_key", "dissonance", "wrong_bass", "meter_glitch", "voice_crossing", "parallel_fifths"),
                  (outside, cluster, bass, over, crossed, parallel))
    return reduce(DataFrame.unionByName, [d.select("piece_id", "bar", F.lit(k).alias("kind")) for k, d in flagged])


def four_parts(p: DataFrame) -> DataFrame:
    """(piece_id, bar, seq): the four named parts low to high, where each strikes exactly one pitch row."""
    named = p.withColumn("part", F.lower("voice")).filter(F.col("part").isin(*PART_ORDER)).groupBy("piece_id", "bar").agg(
        *[F.min(F.when(F.col("part") == x, F.col("midi"))).alias(x) for x in PART_ORDER],
        *[num.count_if(F.col("part") == x).alias(f"n_{x}") for x in PART_ORDER],
    )
    single = reduce(lambda a, b: a & b, [F.col(f"n_{x}") == 1 for x in PART_ORDER])
    return named.filter(single).select("piece_id", "bar", F.array(*PART_ORDER).alias("seq"))


def _parallel(i: int, j: int) -> Column:
    a, b = F.col("before"), F.col("seq")
    i0, i1 = F.abs(a[i] - a[j]) % 12, F.abs(b[i] - b[j]) % 12
    d1, d2 = b[i] - a[i], b[j] - a[j]
    return i0.isin(0, 7) & (i0 == i1) & (d1 != 0) & (d2 != 0) & ((d1 > 0) == (d2 > 0))


def bar_heuristic(notes: DataFrame, keys: DataFrame, beats: int = 4) -> DataFrame:
    """The rule baseline: out-of-key notes, semitone clashes inside a token and overflow per bar; the worst bar."""
    t = tokens(notes).join(keys, "piece_id")
    out = F.size(F.filter("midis", lambda m: F.col("key").bitwiseAND(bits.pc_bit(m % 12)) == 0))
    clash = F.size(F.filter("midis", lambda m: F.array_contains("midis", m + 1)))
    per_bar = t.groupBy("piece_id", "bar").agg(
        F.sum(out).alias("out"), F.sum(clash).alias("clash"),
        (F.max(F.col("slot") + F.col("dur_slots") - 1) > 4 * beats + 6).cast("int").alias("over"),
    ).withColumn("score", F.col("out") + F.col("clash") + F.col("over"))
    kind = F.when(F.col("over") > 0, "meter_glitch").when(F.col("clash") > 0, "dissonance").otherwise("out_of_key")
    worst = per_bar.withColumn("kind", kind).filter("score > 0").groupBy("piece_id").agg(
        F.max_by(F.struct("bar", "kind", "score"), F.struct(F.col("score"), -F.col("bar"))).alias("w")
    )
    return worst.select("piece_id", F.lit(True).alias("anomaly"), "w.bar", "w.kind", "w.score")


def detection(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Detection, false-positive, localization and kind rates.

    cases: (piece_id, has_anomaly, bar, kind); verdicts: (piece_id, anomaly, bar, kind).
    """
    v = verdicts.select("piece_id", "anomaly", F.col("bar").alias("v_bar"), F.col("kind").alias("v_kind"))
    df = cases.join(v, "piece_id", "left").withColumn("hit", F.coalesce("anomaly", F.lit(False)))
    has, hit = F.col("has_anomaly"), F.col("hit")
    near = F.coalesce(F.abs(F.col("v_bar") - F.col("bar")) <= 1, F.lit(False))
    agg = df.agg(
        num.count_if(has).alias("n_anom"), num.count_if(~has).alias("n_clean"),
        num.count_if(has & hit).alias("detection"), num.count_if(~has & hit).alias("false_pos"),
        num.count_if(has & hit & near).alias("localized"),
        num.count_if(has & hit & F.coalesce(F.col("v_kind") == F.col("kind"), F.lit(False))).alias("kind_correct"),
    )
    rates = {"detection_rate": ("detection", "n_anom"), "false_pos_rate": ("false_pos", "n_clean"), "localized_rate": ("localized", "n_anom"), "kind_rate": ("kind_correct", "n_anom")}
    return agg.withColumns({k: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 2) for k, (a, b) in rates.items()})
