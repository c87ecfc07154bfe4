"""Dose levers: reproducible edits of a piece that push one metric by a dose in [0, 1].

A lever is a row of a table: which metric it pushes and where, which unit is drawn (a token, a bar, a voice or nothing),
how much of the dose becomes the chance of a draw, what a drawn row needs to know beyond itself, and the edit. Edits come
in five kinds, one class each: new column values, rows dropped, tones added, melody rewritten in order, bars replaced. A
token is what one voice strikes at one slot. Draws are hashes of the metric's name and the unit's key, so equal input
gives equal output on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavelake.functions import numeric as num

TOKEN = ("piece_id", "bar", "voice", "slot", "dur_slots")
UNITS = {"token": TOKEN, "bar": ("piece_id", "bar"), "voice": ("piece_id", "voice")}
TRIPLET_GRID = 12

# Metrics that no local edit isolates, as they follow from the whole chord set or the whole form.
UNCOVERED = ("har_chord_change_rate", "har_vocab_density", "har_fourth_motion_rate", "form_section_per100bars")

c = F.col
PLACE = "struct(slot, dur_slots)"


def whole(x: Column) -> Column:
    return F.rint(x).cast("int")


def in_midi(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(127), whole(x)))


# -- what an edit may ask about the piece around a row: name -> (join keys, table) ------------------
def _line_means(n: DataFrame) -> DataFrame:
    return n.groupBy("piece_id", "voice").agg(F.avg("midi").alias("_mean"), F.min("voice_ix").alias("_ix"))


def _outer_lines(n: DataFrame) -> DataFrame:
    """The highest and the lowest line by mean pitch (the earlier voice on a tie) and the mean of the highest."""
    high, low = F.struct(c("_mean"), -c("_ix")), F.struct("_mean", "_ix")
    return _line_means(n).groupBy("piece_id").agg(
        F.max_by("voice", high).alias("top_line"), F.max_by("_mean", high).alias("top_mean"),
        F.min_by("voice", low).alias("low_line"), F.count("*").alias("lines"),
    )


def _bass_home(n: DataFrame) -> DataFrame:
    """The lowest line's most frequent pitch (the lower on a tie)."""
    of_bass = n.join(_outer_lines(n), "piece_id").where(c("voice") == c("low_line"))
    counted = of_bass.groupBy("piece_id", "low_line", "midi").agg(F.count("*").alias("k"))
    return counted.groupBy("piece_id", "low_line").agg(F.max_by("midi", F.struct(c("k"), -c("midi"))).alias("home"))


def _mean_length(n: DataFrame) -> DataFrame:
    tokens = n.select(*TOKEN).distinct()
    return tokens.groupBy("piece_id").agg(F.greatest(F.lit(1), whole(F.avg("dur_slots"))).alias("mean_length"))


#: By piece a table that is joined; by finer keys minima, as windows: these read notes where they were dealt by piece, a join would deal them anew.
CONTEXT: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame] | dict[str, str]]] = {
    "outer lines": (("piece_id",), _outer_lines),
    "bass home": (("piece_id",), _bass_home),
    "mean length": (("piece_id",), _mean_length),
    "opening bar": (("piece_id",), lambda n: n.groupBy("piece_id").agg(F.min("bar").alias("opening"))),
    "first voice of bar": (("piece_id", "bar"), {"lead": "voice_ix"}),
    "first token of line": (("piece_id", "bar", "voice"), {"first": PLACE}),
    "first token of bar": (("piece_id", "bar"), {"front": "struct(voice_ix, slot, dur_slots)"}),
}


# -- kinds of edits --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Lever:
    """push: where the metric goes; unit and share: what is drawn, with chance share * dose; context: what the edit reads."""

    push: str
    unit: str | None = None
    share: float = 1.0
    context: tuple[str, ...] = ()

    def drawn(self, metric: str, dose: float) -> Column:
        if self.unit is None:
            return F.lit(True)
        return num.chance(metric, *map(c, UNITS[self.unit])) < self.share * dose

    def around(self, notes: DataFrame) -> DataFrame:
        for name in self.context:
            keys, table = CONTEXT[name]
            if callable(table):
                notes = notes.join(table(notes.select(*notes.columns)), list(keys))
            else:
                keyed = notes.dropna(subset=list(keys))
                notes = keyed.withColumns({k: F.min(F.expr(e)).over(W.partitionBy(*keys)) for k, e in table.items()})
        return notes

    def apply(self, notes: DataFrame, metric: str, dose: float) -> DataFrame:
        edited = self.edit(self.around(notes), self.drawn(metric, dose), dose)
        return edited.select(*notes.columns)

    def edit(self, notes: DataFrame, drawn: Column, dose: float) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Assign(Lever):
    """New values for columns of the drawn rows that satisfy ``where`` (SQL)."""

    values: Mapping[str, Callable[[float], Column]] = field(default_factory=dict)
    where: str = "true"

    def edit(self, notes, drawn, dose):
        hit = drawn & F.expr(self.where)
        kinds = dict(notes.dtypes)
        return notes.withColumns({k: F.when(hit, v(dose)).otherwise(c(k)).cast(kinds[k]) for k, v in self.values.items()})


@dataclass(frozen=True)
class Drop(Lever):
    """Drawn rows go, but for those that satisfy ``spare``."""

    spare: str = "false"

    def edit(self, notes, drawn, dose):
        return notes.where(~drawn | F.expr(self.spare))


@dataclass(frozen=True)
class DropButOne(Lever):
    """Drawn units go; of each group one always stays: the greatest draw, or the first token if none is left."""

    group: tuple[str, ...] = ()
    by_draw: bool = False

    def apply(self, notes, metric, dose):
        if self.by_draw:
            draw = num.chance(metric, *map(c, UNITS[self.unit]))
            units = notes.select(*UNITS[self.unit]).distinct().withColumn("_draw", draw)
            stay = units.withColumn("_most", F.max("_draw").over(W.partitionBy(*self.group))).where((c("_draw") >= dose) | (c("_draw") == c("_most")))
            return notes.join(stay.select(*UNITS[self.unit]), list(UNITS[self.unit]), "left_semi")
        stays = ~self.drawn(metric, dose)
        group = W.partitionBy(*self.group)
        left = notes.dropna(subset=list(self.group)).withColumns({"_some": F.bool_or(stays).over(group), "_first": F.min(F.expr(PLACE)).over(group)})
        kept = left.where(stays | (~c("_some") & (F.expr(PLACE) == c("_first"))))
        return kept.select(*notes.columns)


@dataclass(frozen=True)
class AddTone(Lever):
    """A tone ``above`` the lowest of every drawn token that satisfies ``where``."""

    above: Callable[[float], int] = lambda dose: 0
    where: str = "true"

    def edit(self, notes, drawn, dose):
        tokens = _one_per_token(notes.where(drawn & F.expr(self.where)), notes.columns)
        return notes.unionByName(tokens.withColumn("midi", F.least(F.lit(127), c("midi") + self.above(dose)).cast(dict(notes.dtypes)["midi"])))


@dataclass(frozen=True)
class Held(Lever):
    """In drawn bars the first voice becomes one held chord."""

    chord: tuple[int, ...] = ()
    length: int = 8

    def edit(self, notes, drawn, dose):
        hit = drawn & (c("voice_ix") == c("lead"))
        line = notes.where(hit)
        one = line.groupBy("piece_id", "bar", "voice").agg(*(F.min(x).alias(x) for x in line.columns if x not in ("piece_id", "bar", "voice")))
        kinds = dict(notes.dtypes)
        chord = one.withColumns({
            "slot": F.lit(1).cast(kinds["slot"]), "dur_slots": F.lit(self.length).cast(kinds["dur_slots"]),
            "midi": F.explode(F.array(*map(F.lit, self.chord)).cast(f"array<{kinds['midi']}>")),
        })
        return notes.where(~hit).unionByName(chord.select(*notes.columns))


@dataclass(frozen=True)
class Walk(Lever):
    """The highest line in order; a drawn token's pitch follows from the edited pitch before it and its own.

    Tokens between two undrawn ones form a run that starts at a given pitch, so runs are folded side by side.
    """

    rule: Callable[[Column, Column], Column] = lambda before, own: own

    def edit(self, notes, drawn, dose):
        is_top = c("voice") == c("top_line")
        tokens = notes.where(is_top).withColumn("_drawn", drawn).groupBy(*TOKEN, "_drawn").agg(F.min("midi").alias("_own"))
        line = W.partitionBy("piece_id").orderBy("bar", "slot", "dur_slots")
        runs = tokens.withColumn("_drawn", c("_drawn") & (F.row_number().over(line) > 1))
        runs = runs.withColumn("_run", F.sum(F.when(c("_drawn"), 0).otherwise(1)).over(line))
        folded = runs.groupBy("piece_id", "_run").agg(
            F.array_sort(F.collect_list(F.struct("bar", "slot", "dur_slots", "voice", c("_own").cast("int").alias("own"), "_drawn"))).alias("_row")
        )
        start = F.array(c("_row")[0]["own"])
        rest = F.slice("_row", 2, F.greatest(F.size("_row") - 1, F.lit(0)))
        pitches = F.aggregate(rest, start, lambda done, t: F.concat(done, F.array(self.rule(F.element_at(done, -1), t["own"]).cast("int"))))
        moved = folded.select("piece_id", F.explode(F.arrays_zip(c("_row").alias("row"), pitches.alias("pitch"))).alias("z"))
        moved = moved.select("piece_id", "z.row.*", "z.pitch").where("_drawn").select(*TOKEN, "pitch")
        kept = notes.join(moved.select(*TOKEN), list(TOKEN), "left_anti")
        single = _one_per_token(notes.where(is_top), notes.columns).join(moved, list(TOKEN))
        return kept.unionByName(single.withColumn("midi", in_midi(c("pitch")).cast(dict(notes.dtypes)["midi"])).select(*notes.columns))


@dataclass(frozen=True)
class Recast(Lever):
    """Drawn bars take the content of another bar: the piece's first one, or the bar before as edited."""

    source: str = "first"

    def edit(self, notes, drawn, dose):
        bars = notes.select("piece_id", "bar").distinct().withColumn("_hit", drawn)
        piece = W.partitionBy("piece_id")
        own = F.when(~c("_hit") | (c("bar") == F.min("bar").over(piece)), c("bar"))
        if self.source == "first":
            content = F.coalesce(own, F.min("bar").over(piece))
        else:
            content = F.last(own, ignorenulls=True).over(piece.orderBy("bar").rowsBetween(W.unboundedPreceding, W.currentRow))
        plan = bars.select("piece_id", "bar", content.alias("_from"))
        return plan.join(notes.withColumnRenamed("bar", "_from"), ["piece_id", "_from"])


def _one_per_token(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*TOKEN).agg(*(F.min(x).alias(x) for x in columns if x not in TOKEN)).select(*columns)


def _nearest_of(tones: tuple[int, ...]) -> Column:
    """The pitch moved to the nearest pitch class of ``tones`` within its octave; the earlier one on a tie."""
    pc = F.pmod("midi", F.lit(12))
    apart = lambda t: F.least(F.pmod(pc - t, F.lit(12)), F.pmod(F.lit(t) - pc, F.lit(12)))
    return c("midi") - pc + F.array_min(F.array(*(F.struct(apart(t).alias("apart"), F.lit(t).alias("tone")) for t in tones)))["tone"]


def _spread_semitones(dose: float) -> Column:
    by = round(12 * dose)
    alone = c("lines") < 2
    return in_midi(c("midi") + F.when(alone, 0).when(c("voice") == c("top_line"), by).when(c("voice") == c("low_line"), -by).otherwise(0))


# Metric names, directions and numeric factors of the levers.
LEVERS: dict[str, Lever] = {
    # column values
    "har_chromaticism": Assign("high", "token", 0.5, values={"midi": lambda d: in_midi(c("midi") + 1)}),
    "har_distinct_pc": Assign("low", "token", values={"midi": lambda d: in_midi(_nearest_of((0, 4, 7)))}),
    "har_pc_entropy": Assign("low", "token", values={"midi": lambda d: c("midi") - F.pmod("midi", F.lit(12))}),
    "har_root_motion_entropy": Assign("low", "token", context=("bass home",), values={"midi": lambda d: c("home")}, where="voice = low_line"),
    "mel_pitch_range": Assign("high", context=("outer lines",), values={"midi": _spread_semitones}),
    "mel_voice_range": Assign(
        "high", context=("outer lines",), where="voice = top_line",
        values={"midi": lambda d: in_midi(c("top_mean") + (c("midi") - c("top_mean")) * (1 + 3 * d))},
    ),
    "rhy_dur_cv": Assign("low", "token", context=("mean length",), values={"dur_slots": lambda d: c("mean_length")}),
    "rhy_mean_dur_beats": Assign("high", values={"dur_slots": lambda d: F.greatest(F.lit(1), whole(c("dur_slots") * (1 + 3 * d)))}),
    "rhy_onset_pos_entropy": Assign("low", "token", values={"slot": lambda d: F.lit(1)}),
    "rhy_syncopation_rate": Assign("high", "token", values={"slot": lambda d: c("slot") + 1}),
    "rhy_triplet_share": Assign("high", "bar", values={"grid": lambda d: F.lit(TRIPLET_GRID)}),
    # rows dropped
    "rhy_density_variability": Drop("high", "bar", 0.5, ("first token of line", "opening bar"), f"{PLACE} = first OR bar = opening"),
    "rhy_onset_density_per_bar": DropButOne("low", "token", group=("piece_id", "bar", "voice")),
    "tex_active_voice_density": Drop("low", "bar", context=("first voice of bar",), spare="voice_ix = lead"),
    "tex_voice_count": DropButOne("low", "voice", group=("piece_id",), by_draw=True),
    # tones added
    "har_dimaug_rate": Held("high", "bar", context=("first voice of bar",), chord=(60, 63, 66)),
    "tex_max_chord_width": AddTone(
        "high", context=("first token of bar",), above=lambda d: 12 + round(24 * d), where="struct(voice_ix, slot, dur_slots) = front"
    ),
    "tex_mean_simultaneity": AddTone("high", "token", above=lambda d: 4),
    # melody in order
    "mel_interval_entropy": Walk("low", "token", context=("outer lines",), rule=lambda before, own: before + 2),
    "mel_step_ratio": Walk(
        "high", "token", context=("outer lines",),
        rule=lambda before, own: before + F.when(own == before, 1).otherwise(F.greatest(F.lit(-2), F.least(F.lit(2), own - before))),
    ),
    "mel_up_ratio": Walk("high", "token", context=("outer lines",), rule=lambda before, own: F.when(own > before, own).otherwise(before + 2)),
    # bars replaced
    "form_distinct_bar_frac": Recast("low", "bar"),
    "form_novelty_rate": Recast("low", "bar", source="previous"),
    "form_self_similarity": Recast("high", "bar"),
    "within_song_variation": Recast("low", "bar"),
}


def perturb(notes: DataFrame, metric: str, dose: float) -> DataFrame:
    """Apply a lever and recompute the time columns; a dose of 0 or less changes nothing."""
    if metric not in LEVERS:
        raise KeyError(f"no lever for {metric!r}")
    return notes if dose <= 0 else retime(LEVERS[metric].apply(notes, metric, float(dose)))


def perturb_bars(bars: DataFrame, metric: str, dose: float) -> DataFrame:
    """The declared bars after a lever: the triplet lever moves its drawn bars to a triplet grid, others change none."""
    if metric != "rhy_triplet_share" or dose <= 0:
        return bars
    drawn = LEVERS[metric].drawn(metric, dose)
    return bars.withColumns({
        "grid": F.when(drawn, F.lit(TRIPLET_GRID)).otherwise(c("grid")), "is_triplet": drawn | c("is_triplet"),
    })


def retime(notes: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Recompute onset, absolute onset, duration and pitch class from the slot columns."""
    slot_ql = F.lit(4.0) / c("grid")
    onb = (c("slot") - 1) * slot_ql
    return notes.withColumns({
        "midi": c("midi").cast("int"),
        "onb": F.round(onb, 4),
        "abs": F.round((c("bar") - 1) * F.lit(bar_ql) + onb, 4),
        "dur": F.round(c("dur_slots") * slot_ql, 4),
        "pc": F.pmod(c("midi"), F.lit(12)).cast("int"),
    })
