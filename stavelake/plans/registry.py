"""Query registry: name -> (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.functions import pitch
from stavelake.operators import accompany, anomaly, axes, bank, calibrate, claims, corpus, diagnose, dose, drills, extend, facts, feedback, gates, legacy, levers, lookups, models, morph, overlap, patterns, prune, regions, retrieval, rounds, saved, tags
from stavelake.operators.corpus import Corpus
from stavelake.operators.frames import Frames
from stavelake.operators.structure import Structure
from stavelake.session import checkpoint_dir, cut_lineage
from stavelake.sources import grammar, midi, tables
from stavelake.streaming import rounds as live

Query = Callable[[SparkSession, str], DataFrame]


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames(tables.notes(spark, sf_dir), tables.pieces(spark, sf_dir), tables.bars(spark, sf_dir), tables.dealt(spark, sf_dir))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _axis(axis: str) -> Query:
    return lambda spark, sf_dir: r6(axes.axis_value(frames(spark, sf_dir), axis), "value")


def fingerprint_axes(spark, sf_dir):
    return r6(axes.fingerprint(frames(spark, sf_dir)), "value")


# -- reference distribution and gates ----------------------------------------------------------
_CORPORA: dict[tuple, Corpus] = {}


def corpus_of(spark, sf_dir) -> Corpus:
    """The reference distribution of a data set, kept until another data set or new files are asked for."""
    state = tuple(tables.state_of(spark, f"{sf_dir}/{name}.parquet") for name in ("lineitem", "supplier"))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _CORPORA:
        forget()
        fr = frames(spark, sf_dir).kept_events()
        fr.pieces = corpus.admitted(fr.pieces, fr.voices)  # no level of the notes depends on the pieces
        _CORPORA[key] = Corpus(axes.fingerprint(fr, ("genre",)))
        fr.release()
    return _CORPORA[key]


def forget() -> None:
    """Drop the distributions kept by corpus_of (the bench measures from scratch)."""
    _CORPORA.clear()


def corpus_balanced_values(spark, sf_dir):
    return corpus_of(spark, sf_dir).balanced


def corpus_breakpoints(spark, sf_dir):
    return corpus_of(spark, sf_dir).breakpoints


def corpus_shapes(spark, sf_dir):
    return r6(corpus_of(spark, sf_dir).shapes(), "mean", "sd", "skew", "kurt", "bc", "modal_share")


def corpus_genre_bands(spark, sf_dir):
    return corpus_of(spark, sf_dir).genre_bands


def corpus_extreme_budget(spark, sf_dir):
    return r6(corpus_of(spark, sf_dir).extreme_budget, "mean")


def percentile_profile(spark, sf_dir):
    return corpus_of(spark, sf_dir).profile_report()


def band_profile(spark, sf_dir):
    return gates.band_profile(corpus_of(spark, sf_dir).profile)


def band_summary(spark, sf_dir):
    return r6(gates.band_summary(corpus_of(spark, sf_dir).profile), "spread", "from_center")


def genre_band_check(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return gates.genre_band_check(c, c.profile)


def global_band_check(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return gates.global_band_check(c, c.profile)


def genre_extremes(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return gates.genre_extremes(c, c.profile)


def genre_fit(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return gates.band_occupancy(c, c.profile)


# -- copy risk and retrieval -------------------------------------------------------------------
def copy_risk(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    return overlap.copy_risk(n, n)


def copy_overlap_exact(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    return r6(overlap.corpus_overlap(n, n, top_k=None).drop("bar_offset"), "overlap")


def copy_risk_prefiltered(spark, sf_dir):
    """Compatibility: the gate with only the 25 best candidates by bag score slid; it may miss a copy that copy_risk finds."""
    n = tables.notes(spark, sf_dir)
    return overlap.copy_risk(n, n, top_k=overlap.TOP_K)


def copy_budget(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    return calibrate.copy_budget(overlap.corpus_overlap(n, n), tables.pieces(spark, sf_dir))


def _neighbors(spark, sf_dir):
    v = retrieval.vectors(corpus_of(spark, sf_dir).profile)
    return retrieval.nearest(v, v)


def nearest_neighbors(spark, sf_dir):
    return r6(_neighbors(spark, sf_dir).withColumnRenamed("key", "piece_id"), "dist")


def neighbor_tendencies(spark, sf_dir):
    df = retrieval.tendencies(_neighbors(spark, sf_dir), corpus_of(spark, sf_dir).profile)
    return r6(df.withColumnRenamed("key", "piece_id"), "center")


def centroid_exemplars(spark, sf_dir):
    return r6(retrieval.exemplars(corpus_of(spark, sf_dir).profile), "dist")


def embedding_neighbors(spark, sf_dir):
    v = tables.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return r6(retrieval.nearest(v, v).withColumnRenamed("key", "vec_id"), "dist")


# -- legacy metric bank ------------------------------------------------------------------------
def _bank(part) -> Query:
    return lambda spark, sf_dir: r6(bank.bank(frames(spark, sf_dir), part), "value")


def bank_candidates(spark, sf_dir):
    return r6(bank.candidates(frames(spark, sf_dir)), "value")


def bar_similarity(spark, sf_dir):
    return r6(Structure(frames(spark, sf_dir)).similar_bars.select("piece_id", "b1", "b2", "sim"), "sim")


# -- pattern catalogue -------------------------------------------------------------------------
PATTERN_KINDS = {"harmony": "H", "melody": "M", "rhythm": "R", "form": "F", "texture": "T"}


def _patterns(kind) -> Query:
    return lambda spark, sf_dir: patterns.detect(frames(spark, sf_dir), kind)


def pattern_catalog(spark, sf_dir):
    return patterns.catalog(cut_lineage(patterns.detect(frames(spark, sf_dir))))


# -- facts, edits and anomalies ----------------------------------------------------------------
def encoding_cost(spark, sf_dir):
    return facts.encoding_cost(frames(spark, sf_dir))


def ground_truth(spark, sf_dir):
    return r6(facts.ground_truth(frames(spark, sf_dir)), "max_bar_sim")


def constant_baselines(spark, sf_dir):
    return r6(facts.constant_baselines(cut_lineage(facts.ground_truth(frames(spark, sf_dir)))), "accuracy")


def key_guess(spark, sf_dir):
    return r6(facts.key_guess(frames(spark, sf_dir)), "outside")


def difficulty_grade(spark, sf_dir):
    return facts.difficulty(frames(spark, sf_dir))


def bar_chords(spark, sf_dir):
    return facts.bar_chords(frames(spark, sf_dir))


def _keys(spark, sf_dir) -> DataFrame:
    tonic = F.array_position(F.array(*map(F.lit, pitch.SHARP_NAMES)), F.col("tonic")) - 1
    return facts.key_guess(frames(spark, sf_dir)).select("piece_id", anomaly.key_mask(tonic, F.col("mode")).alias("key"))


def anomaly_sites(spark, sf_dir):
    """The edit each single-token injector would make, one per piece and kind."""
    n, keys = tables.notes(spark, sf_dir), _keys(spark, sf_dir)
    kinds = [k for k in anomaly.KINDS if k != "parallel_fifths"]
    df = reduce(DataFrame.unionByName, [anomaly.site(n, k, 0, keys) for k in kinds])
    joined = {c: F.array_join(F.col(c).cast("array<string>"), "+") for c in ("old", "new")}
    return df.withColumns(joined).select("piece_id", "kind", "bar", "voice", "slot", "dur_slots", "old", "new")


def anomaly_verify(spark, sf_dir):
    return anomaly.verify(tables.notes(spark, sf_dir), _keys(spark, sf_dir))


def anomaly_heuristic(spark, sf_dir):
    return anomaly.bar_heuristic(tables.notes(spark, sf_dir), _keys(spark, sf_dir))


def anomaly_detection(spark, sf_dir):
    """Inject an overlong note into every piece and score the rule baseline on edited and original pieces."""
    n = tables.notes(spark, sf_dir)
    site = cut_lineage(anomaly.site(n, "meter_glitch"))
    tag = F.concat(F.col("piece_id"), F.lit("*"))
    dirty = anomaly.inject(n, site).withColumn("piece_id", tag)
    both = n.withColumn("piece_id", F.col("piece_id").cast("string")).unionByName(dirty)
    keys = _keys(spark, sf_dir)
    keys = keys.withColumn("piece_id", F.col("piece_id").cast("string")).unionByName(keys.withColumn("piece_id", tag))
    clean = tables.pieces(spark, sf_dir).select(
        F.col("piece_id").cast("string"), F.lit(False).alias("has_anomaly"), F.lit(None).cast("int").alias("bar"), F.lit(None).cast("string").alias("kind")
    )
    cases = clean.unionByName(site.select(tag.alias("piece_id"), F.lit(True).alias("has_anomaly"), "bar", "kind"))
    return anomaly.detection(cases, anomaly.bar_heuristic(both, keys))


LEVER_DOSE = 0.5


def _lever(metric) -> Query:
    def query(spark, sf_dir):
        edited = levers.perturb(tables.notes(spark, sf_dir), metric, LEVER_DOSE)
        kinds = {k: "int" for k in ("bar", "slot", "dur_slots", "midi", "grid")}
        rows = edited.select("piece_id", "voice", *(F.col(k).cast(t).alias(k) for k, t in kinds.items()))
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    return query


def _piece_fitness(spark, sf_dir) -> DataFrame:
    c, n = corpus_of(spark, sf_dir), tables.notes(spark, sf_dir)
    ext, fits = gates.extreme_counts(c, c.profile), gates.band_occupancy(c, c.profile)
    copies = cut_lineage(overlap.corpus_overlap(n, n))
    oob = gates.genre_band_check(c, c.profile).filter("state in ('LOW', 'HIGH')").groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_oob"))
    sounding = n.groupBy("piece_id").agg(F.count_distinct("bar").alias("bars"))
    return feedback.fitness(ext, fits, copies, sounding, oob, cut_lineage(calibrate.gate_thresholds(ext, fits, copies)))


def piece_fitness(spark, sf_dir):
    return _piece_fitness(spark, sf_dir)


def piece_corrections(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return feedback.corrections(cut_lineage(_piece_fitness(spark, sf_dir)), gates.genre_band_check(c, c.profile))


def genre_guardrail(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return r6(feedback.guardrail(c, c.profile), "severity")


# -- regions -----------------------------------------------------------------------------------
def within_song_variation(spark, sf_dir):
    return r6(regions.within_song_variation(frames(spark, sf_dir), corpus_of(spark, sf_dir)), "wsv")


def _regions(spark, sf_dir, context=False) -> DataFrame:
    return cut_lineage(regions.scored_regions(frames(spark, sf_dir), corpus_of(spark, sf_dir), context))


def region_profile(spark, sf_dir):
    return regions.scored_regions(frames(spark, sf_dir), corpus_of(spark, sf_dir)).select("piece_id", "axis", "value", "percentile")


def region_budget(spark, sf_dir):
    return regions.region_budget(corpus_of(spark, sf_dir), _regions(spark, sf_dir))


def region_reprise(spark, sf_dir):
    return r6(regions.region_reprise(frames(spark, sf_dir)).drop("source_id"), "reprise")


def reprise_gate(spark, sf_dir):
    return regions.reprise_gate(regions.region_reprise(frames(spark, sf_dir)))


def region_fitness(spark, sf_dir):
    """The real regions themselves as round-one candidates, against budgets and gates calibrated on them."""
    fr, c = frames(spark, sf_dir), corpus_of(spark, sf_dir)
    parts = regions.by_type(fr)
    reprise = cut_lineage(regions.all_types(regions.reprise(gap, around).select("piece_id", "type", "reprise") for gap, around in parts))
    sizes = cut_lineage(regions.all_types(
        gap.events.groupBy("piece_id").agg(F.count_distinct("bar").alias("bars")).join(gap.pieces.select("piece_id", "type", F.col("n_bars").alias("target_bars")), "piece_id")
        for gap, _ in parts
    ).drop("type"))
    region, context = (cut_lineage(regions.scored_by_type([part[k] for part in parts], c)) for k in (0, 1))
    fr.release()
    budget = cut_lineage(regions.region_budget(c, region))
    gate = cut_lineage(regions.reprise_gate(reprise))
    return regions.fitness(c, region, context, reprise, sizes, budget, gate)


def _edited(spark, sf_dir) -> Frames:
    """Generated stand-ins: every piece after the chromatic lever."""
    edited = levers.perturb(tables.notes(spark, sf_dir), "har_chromaticism", LEVER_DOSE)  # a lever of single notes leaves them where they are
    return Frames(edited, tables.pieces(spark, sf_dir), dealt=tables.dealt(spark, sf_dir))


def channel_check(spark, sf_dir):
    fr = frames(spark, sf_dir)
    df = overlap.channel_check(
        regions.gap_regions(_edited(spark, sf_dir)).events, regions.gap_regions(fr).events, regions.gap_regions(fr, context=True).events
    )
    return r6(df, "rate", "innocent")


def final_grade(spark, sf_dir):
    fr, c = frames(spark, sf_dir), corpus_of(spark, sf_dir)
    gen = _edited(spark, sf_dir)
    answer = overlap.case_overlap(regions.gap_regions(gen).events, regions.gap_regions(fr).events)
    region = cut_lineage(regions.scored_regions(gen, c))
    return regions.final_grade(region, _regions(spark, sf_dir), _regions(spark, sf_dir, context=True), c, answer)


def _candidates(spark, sf_dir) -> Frames:
    """Stand-ins for written regions: a start five semitones up, an infill with its odd bars a semitone up, and as
    continuation that of the nearest neighbour."""
    real = regions.gap_regions(frames(spark, sf_dir))
    part = F.split("piece_id", r"\|")
    up = F.when(part[1] == "start", 5).when(F.col("bar") % 2 == 1, 1).otherwise(0)
    own = real.events.where(part[1] != "cont").withColumn("midi", (F.col("midi") + up).cast("int"))
    near = _neighbors(spark, sf_dir).where("rank = 1").select("key", F.col("neighbor").cast("string").alias("song"))
    theirs = real.events.where(part[1] == "cont").withColumn("song", part[0]).join(near, "song")
    theirs = theirs.withColumn("piece_id", F.concat_ws("|", F.col("key").cast("string"), F.lit("cont"))).drop("song", "key")
    events = cut_lineage(own.withColumn("pc", F.col("midi") % 12).unionByName(theirs))
    if real.dealt:
        events = events.repartition(real.dealt, "piece_id")
    return Frames(events, real.pieces, dealt=real.dealt)


def _scored(gen: Frames, fitted: Corpus) -> DataFrame:
    return cut_lineage(regions.scored(gen.kept_events(), fitted))


def legacy_gap(spark, sf_dir):
    """Every stand-in by the legacy gap measures."""
    fr, c = frames(spark, sf_dir), corpus_of(spark, sf_dir)
    gen, real = _candidates(spark, sf_dir), regions.gap_regions(fr)
    truth = _regions(spark, sf_dir)
    near = _neighbors(spark, sf_dir).select(F.col("key").alias("source_id"), F.col("neighbor").alias("song"))
    neighbors = gen.pieces.select("piece_id", "source_id").join(near, "source_id").select("piece_id", "song")
    copied = legacy.copies(gen, real, fr, neighbors)
    budget = cut_lineage(regions.region_budget(c, truth))
    return legacy.measure(c, gen, real, _scored(gen, c), truth, _regions(spark, sf_dir, context=True), copied, budget)


def legacy_winners(spark, sf_dir):
    return legacy.winners(cut_lineage(legacy_gap(spark, sf_dir)))


def extension_measure(spark, sf_dir):
    """Every stand-in as an extension of the piece without that region."""
    fr, c = frames(spark, sf_dir), corpus_of(spark, sf_dir)
    gen, source = _candidates(spark, sf_dir), regions.gap_regions(fr, context=True)
    cases = source.pieces.select("piece_id", "type", regions.seam(F.col("type"), F.col("full_bars")).alias("seam"))
    songs = fr.events.withColumn("piece_id", F.col("piece_id").cast("string"))
    copy = overlap.corpus_overlap(gen.events, songs).select("piece_id", F.col("overlap").alias("vs_corpus"))
    return extend.measure(c, gen, source, cases, _scored(gen, c), _regions(spark, sf_dir, context=True), copy)


DRAWS = 3


def disjoint_exemplars(spark, sf_dir):
    """Three draws of two exemplars per genre."""
    return r6(retrieval.disjoint_exemplars(corpus_of(spark, sf_dir).profile, DRAWS), "dist")


def _drifted(spark, sf_dir) -> DataFrame:
    edited = _edited(spark, sf_dir).kept_events()
    after = cut_lineage(corpus_of(spark, sf_dir).score(axes.fingerprint(edited)))
    edited.release()
    return after


def drift_report(spark, sf_dir):
    """Profiles before and after the chromatic lever."""
    after = _drifted(spark, sf_dir)
    return gates.drift(corpus_of(spark, sf_dir).profile, after)


def drift_verdict(spark, sf_dir):
    c, after = corpus_of(spark, sf_dir), _drifted(spark, sf_dir)
    return r6(gates.drift_verdict(c.profile, after), "spread0", "spread1")


def gate_thresholds(spark, sf_dir):
    c, n = corpus_of(spark, sf_dir), tables.notes(spark, sf_dir)
    return calibrate.gate_thresholds(gates.extreme_counts(c, c.profile), gates.band_occupancy(c, c.profile), overlap.corpus_overlap(n, n))


# -- classifier and trajectories ---------------------------------------------------------------
def _features(spark, sf_dir) -> DataFrame:
    return cut_lineage(models.wide(corpus_of(spark, sf_dir).profile, axes.AXES))


def genre_classifier(spark, sf_dir):
    f = _features(spark, sf_dir)
    return models.GenreModel.fit(f, axes.AXES).read(f)


def genre_rank_thresholds(spark, sf_dir):
    return models.rank_thresholds(models.cross_validated_ranks(_features(spark, sf_dir), axes.AXES))


def genre_steer(spark, sf_dir):
    f = _features(spark, sf_dir)
    model = models.GenreModel.fit(f, axes.AXES, standardize=False)
    return r6(models.steer(corpus_of(spark, sf_dir).profile, model.read(f), model.coefficients()), "gap")


def axis_correlation(spark, sf_dir):
    """Pearson correlation of every axis pair over the corpus."""
    return r6(prune.correlations(corpus_of(spark, sf_dir).fingerprint), "r")


def axis_prune(spark, sf_dir):
    return prune.pruned(corpus_of(spark, sf_dir).fingerprint)


MORPH_PARTS = 4


def _morph_cases(spark, sf_dir) -> DataFrame:
    """Source and target exemplars of neighbouring genres, as (case_id, a, b, genre_a, genre_b)."""
    best = retrieval.exemplars(corpus_of(spark, sf_dir).profile, 1)
    return cut_lineage(morph.cyclic_pairs(best).withColumn("case_id", F.concat_ws("_", "a", "b")))


def _medleys(spark, sf_dir, cases) -> Frames:
    """One stand-in piece per case: the first half of A, then the second half of B."""
    n = tables.notes(spark, sf_dir).join(tables.pieces(spark, sf_dir).select("piece_id", F.floor(F.col("n_bars") / 2).alias("half")), "piece_id")
    half = F.col("half")
    first = n.filter(F.col("bar") <= half).join(cases.select(F.col("a").alias("piece_id"), "case_id"), "piece_id")
    second = n.filter(F.col("bar") > half).join(cases.select(F.col("b").alias("piece_id"), "case_id"), "piece_id")
    events = first.unionByName(second).withColumn("piece_id", F.col("case_id")).drop("case_id", "half")
    pieces = cases.select(
        F.col("case_id").alias("piece_id"), F.col("genre_a").alias("genre"), F.lit(tables.BAR_QL).alias("bar_ql"), F.lit(tables.N_BARS).alias("n_bars")
    )
    return Frames(events, pieces)


def _morph_segments(spark, sf_dir, cases) -> DataFrame:
    seg = regions.segments(_medleys(spark, sf_dir, cases), F.lit(MORPH_PARTS))
    scored = corpus_of(spark, sf_dir).score(axes.fingerprint(seg, ("source_id", "part")))
    return cut_lineage(scored.select(F.col("source_id").alias("case_id"), "part", "axis", "percentile"))


def morph_targets(spark, sf_dir):
    return morph.targets(_morph_cases(spark, sf_dir), corpus_of(spark, sf_dir).profile)


def _graduality(spark, sf_dir, cases, segments) -> DataFrame:
    p = corpus_of(spark, sf_dir).profile.select("piece_id", "axis", "percentile")
    ends = cases.join(p.withColumnsRenamed({"piece_id": "a", "percentile": "pa"}), "a").join(
        p.withColumnsRenamed({"piece_id": "b", "percentile": "pb"}), ["b", "axis"]
    )
    return morph.graduality(morph.progress(segments, ends.select("case_id", "axis", "pa", "pb")))


def morph_graduality(spark, sf_dir):
    cases = _morph_cases(spark, sf_dir)
    return _graduality(spark, sf_dir, cases, _morph_segments(spark, sf_dir, cases))


def morph_verdict(spark, sf_dir):
    cases = _morph_cases(spark, sf_dir)
    segments = _morph_segments(spark, sf_dir, cases)
    model = models.GenreModel.fit(_features(spark, sf_dir), axes.AXES, standardize=False)
    shift = morph.genre_shift(model, models.wide(segments, axes.AXES, ("case_id", "part")), cases.select("case_id", "genre_a", "genre_b"))
    medleys = _medleys(spark, sf_dir, cases).events
    corpus_notes = tables.notes(spark, sf_dir).withColumn("piece_id", F.col("piece_id").cast("string"))
    copy = overlap.corpus_overlap(medleys, corpus_notes).select(F.col("piece_id").alias("case_id"), F.col("overlap").alias("copy_risk"))
    return morph.verdict(_graduality(spark, sf_dir, cases, segments), shift, copy)


# -- dose-response -----------------------------------------------------------------------------
DOSES = (0.0, 0.25, 0.5, 1.0)


def _dose_rows(spark, sf_dir) -> DataFrame:
    """Every piece after all levers at four doses, each scored by its own metric; kept with the corpus it was measured by."""
    fitted = corpus_of(spark, sf_dir)
    if getattr(fitted, "dose_rows", None) is None:
        fitted.dose_rows = cut_lineage(dose.study(frames(spark, sf_dir), DOSES, lambda fr: regions.within_song_variation(fr, fitted)))
    return fitted.dose_rows


def dose_spearman(spark, sf_dir):
    return r6(dose.spearman(_dose_rows(spark, sf_dir), ["axis", "piece_id"], "dose", "score"), "rho")


def dose_response(spark, sf_dir):
    return r6(dose.summarize(_dose_rows(spark, sf_dir)), "within_rho", "delta", "sign_p", "entangled")


def bootstrap_overlap(spark, sf_dir):
    """Bootstrap interval of mean nearest-neighbour overlap per genre."""
    n = tables.notes(spark, sf_dir)
    df = overlap.corpus_overlap(n, n).join(tables.pieces(spark, sf_dir), "piece_id").withColumn("row_id", F.col("piece_id"))
    return r6(dose.poisson_bootstrap_mean(df, ["genre"], "overlap"), "mean", "lo", "hi")


def grammar_roundtrip(spark, sf_dir):
    """Write every piece in the notation (some bars moved to a triplet grid, silent bars and chord labels included), read
    it back and count notes and bars lost or gained; a bar counts with its grid, triplet tag and chord."""
    metric = "rhy_triplet_share"
    n = levers.perturb(tables.notes(spark, sf_dir), metric, LEVER_DOSE)
    bars = levers.perturb_bars(tables.bars(spark, sf_dir), metric, LEVER_DOSE)
    chords = facts.bar_chords(frames(spark, sf_dir))
    head = tables.pieces(spark, sf_dir).select(
        "piece_id", F.lit("KEY: C major | METER: 4/4 | TEMPO: 120 | GRID: 16th | BARS: 32").alias("header"),
        F.lit("VOICES: V1[prog=0], V2[prog=0], V3[prog=24], V4[prog=24], V5[prog=48], V6[prog=48], V7[drums]").alias("voices_line"),
    )
    texts = cut_lineage(grammar.render(n, head, chords, bars))
    cols = ["piece_id", "voice", "bar", "grid", "slot", "dur_slots", "midi", "vel"]
    want, got = n.select(*cols).distinct(), grammar.events(texts).select(*cols)
    bar_cols = ["piece_id", "bar", "grid", "is_triplet", "chord"]
    want_bars = bars.join(chords, ["piece_id", "bar"], "left").fillna({"chord": "?"}).select(*bar_cols)
    got_bars = grammar.bars(texts).select(*bar_cols)
    counted = [
        (got, "notes"), (want.exceptAll(got), "lost"), (got.exceptAll(want), "extra"),
        (got_bars, "bars"), (want_bars.exceptAll(got_bars), "lost_bars"), (got_bars.exceptAll(want_bars), "extra_bars"),
    ]
    out = tables.pieces(spark, sf_dir).select("piece_id")
    for rows, name in counted:
        out = out.join(rows.groupBy("piece_id").agg(F.count(F.lit(1)).alias(name)), "piece_id", "left")
    return out.fillna(0)


def adaptive_grid(spark, sf_dir):
    return midi.bar_grids(tables.notes(spark, sf_dir))


#: Notes that a decoding task hands on at a time.
DECODED = 1 << 16


def midi_roundtrip(spark, sf_dir):
    """Write every piece as MIDI bytes, decode them and compare notes by pitch, onset and length."""
    n = tables.notes(spark, sf_dir)
    encoded = cut_lineage(midi.encode(n, 120.0))
    cols = ["piece_id", "voice", "abs", "dur", "midi"]

    def table(rows):
        return pd.DataFrame(rows, columns=cols).astype({"piece_id": "Int64"})

    def decode(batches):
        rows = []
        for pdf in batches:
            for pid, data in zip(pdf["piece_id"], pdf["content"]):
                pid = None if pd.isna(pid) else int(pid)
                rows += ((pid, r[1], r[4], r[5], r[6]) for r in midi.read_bytes(bytes(data)))
                if len(rows) >= DECODED:
                    yield table(rows)
                    rows = []
        yield table(rows)

    got = encoded.mapInPandas(decode, "piece_id long, voice string, abs double, dur double, midi int")
    both = n.select(*cols, F.lit(1).alias("w"), F.lit(0).alias("g")).unionByName(got.select(*cols, F.lit(0).alias("w"), F.lit(1).alias("g")))
    notes = both.groupBy(*cols).agg(F.max("w").alias("w"), F.max("g").alias("g"))
    return notes.groupBy("piece_id").agg(
        F.sum("w").alias("notes"), F.sum(F.expr("w * (1 - g)")).alias("lost"), F.sum(F.expr("g * (1 - w)")).alias("extra")
    )


def abc_lines(spark, sf_dir):
    return midi.abc_lines(tables.notes(spark, sf_dir))


# -- drills, claims, accompaniment -------------------------------------------------------------
def drill_checks(spark, sf_dir):
    return drills.challenge_checks(drills.features(frames(spark, sf_dir)))


def training_tags(spark, sf_dir):
    """Tags of every piece; meter and tempo, which the tables lack, vary with the id, and the sixteenths of one voice of every
    fourth piece stand beside the whole pieces as lines."""
    fr = frames(spark, sf_dir)
    pid = F.col("piece_id")
    line = fr.events.where((F.col("voice") == "V1") & (F.col("dur_slots") == 1) & (pid % 4 == 0)).withColumn("piece_id", -1 - pid)
    heads = fr.pieces.select("piece_id").unionByName(fr.pieces.where(pid % 4 == 0).select((-1 - pid).alias("piece_id"))).select(
        "piece_id", F.when(pid % 3 == 0, "6/8").otherwise("4/4").alias("meter"), F.when(pid % 5 != 0, 40 + F.abs(pid) * 29 % 150).alias("tempo"))
    bars = levers.perturb_bars(fr.bars, "rhy_triplet_share", LEVER_DOSE)
    both = Frames(fr.events.unionByName(line), fr.pieces, bars)
    return tags.training_tags(both, heads, facts.key_guess(fr), facts.bar_chords(fr))


def drill_rhythm(spark, sf_dir):
    return r6(drills.rhythm_mix(frames(spark, sf_dir)), "change_share")


def drill_register(spark, sf_dir):
    return r6(drills.register_balance(frames(spark, sf_dir), 36, 83), "balance", "busiest_share")


def claim_grades(spark, sf_dir):
    """Grade what is true of a piece, and some guesses that vary with its id, as claims about the next piece (the last one's
    about the first)."""
    fr = frames(spark, sf_dir).kept_events()
    truth = cut_lineage(facts.ground_truth(fr))
    pid = F.col("piece_id")
    ends = truth.agg(F.min("piece_id").alias("lo"), F.max("piece_id").alias("hi")).first()
    root, voice = pitch.pc_name(pid), lambda k: F.concat(F.lit("V"), ((pid + k) % 7 + 1).cast("string"))
    claimed = truth.select(
        F.when(pid == ends["hi"], F.lit(ends["lo"])).otherwise(pid + 1).alias("piece_id"), pitch.midi_name(F.col("highest_midi")).alias("highest"),
        pitch.midi_name(F.col("lowest_midi")).alias("lowest"), F.col("most_active_voice").alias("active_voice"), F.col("active_span").alias("span"),
        F.col("longest_beats").alias("longest"), F.col("any_longer_than_bar").alias("over_bar"), F.col("densest_bar").alias("densest"),
        (pid % 3 > 0).alias("no_repeat"), F.col("densest_bar").alias("bar_a"), F.when(pid % 6 == 0, F.col("densest_bar")).otherwise(pid % 32 + 1).cast("int").alias("bar_b"),
        root.alias("query_pc"), (pid % 2 == 0).alias("pc_present"), F.col("distinct_pc_count").alias("pc_count"), root.alias("tonic"),
        F.element_at(F.array(F.lit("Major"), F.lit("chromatic"), F.lit("blues")), (pid % 3 + 1).cast("int")).alias("mode"), "subdivision", "syncopation", "note_value",
        F.col("densest_bar").alias("chord_bar"), F.array(root, pitch.pc_name(pid + 4)).alias("chord_pcs"), voice(0).alias("voice_a"), voice(2).alias("voice_b"),
        (pid % 5 > 0).alias("parallel"), voice(1).alias("interval_a"), voice(5).alias("interval_b"), (pid * 7 % 48).cast("int").alias("semis"), (pid % 4 > 0).alias("interval"),
    )
    graded = cut_lineage(claims.grade(fr, truth, claimed))
    fr.release()
    return graded


def drum_groove(spark, sf_dir):
    """The drum voice after the syncopation lever against the real one."""
    n = tables.notes(spark, sf_dir)
    real = n.filter("is_drum")
    return accompany.groove(levers.perturb(real, "rhy_syncopation_rate", LEVER_DOSE), real, tables.pieces(spark, sf_dir))


def voice_roles(spark, sf_dir):
    v = frames(spark, sf_dir).voices
    return v.select("piece_id", "voice", accompany.role(F.col("voice"), F.col("program"), F.col("is_drum"), F.col("chordality")).alias("role"))


def voice_removal(spark, sf_dir):
    """Take the busiest voice out and put it back: notes of context, answer and the spliced piece."""
    fr = frames(spark, sf_dir)
    context, answer = accompany.remove_voice(fr.events, fr.lead_voice)
    parts = {"context": context, "answer": answer, "spliced": accompany.splice(context, answer)}
    return reduce(DataFrame.unionByName, [
        df.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.sum("midi").alias("sum_midi")).withColumn("part", F.lit(k)) for k, df in parts.items()
    ])


def best_rounds(spark, sf_dir):
    """Score each region of a piece as a round of one case and keep the best."""
    return rounds.pick_best(_region_rounds(spark, sf_dir), rounds.orders()["gap"])


def streamed_best_rounds(spark, sf_dir):
    """``best_rounds`` kept by a stream that sees later rounds first and is started twice."""
    scored = cut_lineage(_region_rounds(spark, sf_dir))
    base = f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
    for part in (scored.where("round > 1"), scored.where("round = 1")):
        part.write.mode("append").parquet(f"{base}/scored")
        stream = spark.readStream.schema(scored.schema).parquet(f"{base}/scored")
        live.keep_best(stream, [F.col("score")], f"{base}/best", f"{base}/checkpoint").awaitTermination()
    return live.current(spark, f"{base}/best")


def _region_rounds(spark, sf_dir) -> DataFrame:
    fitness = region_fitness(spark, sf_dir)
    turn = F.element_at(F.create_map(*[F.lit(x) for kv in (("start", 1), ("infill", 2), ("cont", 3)) for x in kv]), F.col("type"))
    return fitness.select(F.split("piece_id", r"\|")[0].alias("case_id"), turn.alias("round"), "score", "converged")


def loop_benefit(spark, sf_dir):
    """First against best round of every case, with the regions of a piece as its rounds."""
    return r6(rounds.loop_benefit(_region_rounds(spark, sf_dir), "score", rounds.orders()["gap"]), "first", "best", "gain")


def pick_best_orders(spark, sf_dir):
    """Every pick-best order over one table of scored rounds: a piece is a case, a voice a round, its note counts the scores."""
    n = tables.notes(spark, sf_dir)
    count = lambda cond: F.count(F.when(cond, 1))
    scored = n.groupBy(F.col("piece_id").alias("case_id"), F.col("voice_ix").alias("round")).agg(
        count(F.col("midi") > 72).alias("score"), (count(F.col("vel") > 80) % 3).alias("copy_over"), (count(F.col("slot") == 1) % 4).alias("off_target"),
        (count(F.col("midi") < 40) % 5).alias("extremes"), (count(F.col("dur_slots") > 4) % 7).alias("copy"), (count(F.col("bar") > 16) % 2).alias("copy_fails"),
        F.when(count(F.col("bar") > 24) % 2 == 0, count(F.col("bar") < 9)).alias("morph_score"), (count(F.col("pc") == 0) % 3).alias("groove_fit"),
        (count(F.col("pc") == 7) % 3).alias("rhythm_sim"), (count(F.col("pc") == 4) % 3).alias("kit"), (count(F.col("pc") == 2) % 3).alias("fit"),
        (count(F.col("pc") == 5) % 3).alias("beat_pct"), (count(F.col("pc") == 9) % 2 == 0).alias("improved"), (count(F.col("pc") == 11) % 2 == 0).alias("verdict"),
        (count(F.col("slot") > 8) % 4).alias("failed_checks"), F.concat(F.lit("v"), F.max("voice_ix")).alias("path"),
    )
    parts = [rounds.pick_best(scored, order).select("case_id", F.lit(task).alias("task"), "round") for task, order in rounds.orders().items()]
    return reduce(DataFrame.unionByName, parts)


def grammar_rejects(spark, sf_dir):
    """Rejected tokens per piece after the velocity of every quiet token is cut off in the written text."""
    n = tables.notes(spark, sf_dir)
    head = tables.pieces(spark, sf_dir).select("piece_id", F.lit("KEY: C major | METER: 4/4 | GRID: 16th | BARS: 32").alias("header"), F.lit("VOICES: V1").alias("voices_line"))
    texts = cut_lineage(grammar.render(n, head).select("piece_id", F.regexp_replace("text", r"\^56\b", "^").alias("text")))
    return grammar.rejects(texts).groupBy("piece_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def voice_intervals(spark, sf_dir):
    return lookups.voice_intervals(tables.notes(spark, sf_dir).filter("not is_drum"))


def pitch_at_bars(spark, sf_dir):
    """The last pitch every voice struck at or before each barline."""
    n = tables.notes(spark, sf_dir)
    asked = n.select("piece_id", "voice").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(tables.N_BARS))).alias("bar"))
    return lookups.pitch_at(n, asked.select("piece_id", "voice", (F.col("bar") * tables.BAR_QL).alias("t")))


def copy_bars(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    return lookups.copy_bars(n, n)


def bar_attribution(spark, sf_dir):
    """Every decomposable axis with and without every bar."""
    made = r6(diagnose.bar_attribution(frames(spark, sf_dir)), "value", "without")
    return r6(made.withColumn("delta", F.col("without") - F.col("value")), "delta")


def saved_profile(spark, sf_dir):
    """The percentile profile by a distribution that was saved and read back."""
    fitted, path = corpus_of(spark, sf_dir), f"{checkpoint_dir(spark)}/distribution-{uuid.uuid4().hex}"
    saved.save(fitted, path)
    return saved.SavedCorpus(spark, path).report(fitted.fingerprint)


def copy_runs(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    return diagnose.copy_runs(n, n)


def build() -> dict[str, Query]:
    out: dict[str, Query] = {axis: _axis(axis) for axis in axes.AXES}
    for part in bank.PARTS:
        out[f"bank{part.__name__}"] = _bank(part)
    for name, kind in PATTERN_KINDS.items():
        out[f"patterns_{name}"] = _patterns(kind)
    for metric in levers.LEVERS:
        out[f"lever_{metric}"] = _lever(metric)
    for q in (
        fingerprint_axes, corpus_balanced_values, corpus_breakpoints, corpus_shapes, corpus_genre_bands,
        corpus_extreme_budget, percentile_profile, band_profile, band_summary, genre_band_check, global_band_check,
        genre_extremes, genre_fit, copy_risk, copy_risk_prefiltered, copy_overlap_exact, copy_budget, nearest_neighbors, neighbor_tendencies,
        centroid_exemplars, embedding_neighbors, bank_candidates, bar_similarity, pattern_catalog,
        encoding_cost, ground_truth, constant_baselines, key_guess, difficulty_grade, bar_chords, anomaly_sites,
        anomaly_verify, anomaly_heuristic, anomaly_detection, within_song_variation, region_profile, region_budget,
        region_reprise, reprise_gate, region_fitness, channel_check, final_grade, legacy_gap, legacy_winners, extension_measure, disjoint_exemplars, drift_report, drift_verdict, gate_thresholds,
        piece_fitness, piece_corrections, genre_guardrail, loop_benefit, pick_best_orders, grammar_rejects, voice_intervals, pitch_at_bars, copy_bars, bar_attribution, copy_runs, saved_profile,
        genre_classifier, genre_rank_thresholds, genre_steer, axis_correlation, axis_prune, morph_targets, morph_graduality,
        morph_verdict, dose_spearman, dose_response, bootstrap_overlap, grammar_roundtrip, adaptive_grid, midi_roundtrip, abc_lines,
        drill_checks, training_tags, drill_rhythm, drill_register, claim_grades, drum_groove, voice_roles, voice_removal, best_rounds, streamed_best_rounds,
    ):
        out[q.__name__] = q
    return out
