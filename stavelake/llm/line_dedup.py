"""Cross-site line dedup by distinct-site spread, in DataFrame functions only.

Every non-blank line, trimmed, is hashed to 128 bits; a HyperLogLog sketch of the sites (``source``) that show it is
aggregated per hash, partially on the map side, so a line in a third of all documents sends one sketch per task. Lines
whose estimate stays clearly below the limit are left alone. The occurrences of the others are fetched once; those with
an estimate near the limit get an exact count of their sites. A line on at least ``min_sites`` sites is boilerplate: it
stays at its earliest place (smallest doc_id, then line number) and is removed everywhere else.

Defined results: a null text has no lines and stays null; blank lines are never counted or removed; a null source is a
site of its own; a null doc_id orders first; rows with equal doc_id and text are treated alike (a repeated row that
holds the earliest place keeps the line in each copy); an empty table gives an empty result. All columns of the documents
are kept; only columns named ``ld_lines`` or ``ld_removed`` are replaced by the results of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import cut, unused

#: Relative standard error of a sketch with 2^k registers is about 1.04 / 2^(k/2).
LG_K = 11


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, body, place, site, h1, h2) per non-blank line; body tells rows of equal doc_id apart."""
    rows = docs.select(
        docs["doc_id"].alias("doc"), F.xxhash64(docs["text"]).alias("body"), F.xxhash64(docs["source"]).alias("site"),
        F.posexplode_outer(lines_of(docs["text"])).alias("place", "line"),
    )
    line = bare(F.col("line"))
    hashed = rows.select(
        "doc", "body", "place", "site", line.alias("line")
    ).where("line <> ''")
    return hashed.select(
        "doc", "body", "place", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")
    )


def boilerplate(docs: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Occurrences to remove: (doc, body, place)."""
    seen = occurrences(docs)
    margin = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    # Written tables on the small side of a join let Spark split a hot line's rows on the large side.
    wide = cut(spread.where(F.col("estimate") >= min_sites - margin))
    found = cut(seen.join(wide, ["h1", "h2"]))
    near = found.where(F.col("estimate") <= min_sites + margin)
    exact = near.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    sure = found.where(F.col("estimate") > min_sites + margin).select("h1", "h2").distinct()
    spread_wide = sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "place")).alias("first"))
    hit = found.join(cut(spread_wide.join(first, ["h1", "h2"])), ["h1", "h2"])
    return hit.where(~F.struct("doc", "place").eqNullSafe(F.col("first"))).select("doc", "body", "place")


def cleaned(docs: DataFrame, min_sites: int = 10, counts: tuple[str, str] = ("ld_lines", "ld_removed")) -> DataFrame:
    """Documents with their columns, the text without boilerplate lines, and the numbers of lines and of removed ones.

    The numbers are named by ``counts``; columns of these names (case aside) are replaced.
    """
    drop = boilerplate(docs, min_sites).groupBy("doc", "body").agg(F.collect_set("place").alias("places"))
    doc, body, places = unused(docs, "ld_doc", "ld_body", "ld_places")
    drop = drop.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("places").alias(places))
    own = docs.select(*(docs[c] for c in docs.columns if c.lower() not in {n.lower() for n in counts}))
    joined = own.join(drop, own["doc_id"].eqNullSafe(drop[doc]) & (F.xxhash64(own["text"]) == drop[body]), "left")
    lines = lines_of(own["text"])
    kept = F.filter(lines, lambda line, i: ~F.array_contains(drop[places], i))
    text = F.when(drop[places].isNull(), own["text"]).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda line: bare(line) != "")), F.lit(0))
    return joined.select(
        *(text.alias(c) if c == "text" else own[c] for c in own.columns),
        F.greatest(n_lines, F.lit(0)).cast("long").alias(counts[0]),
        F.greatest(F.size(drop[places]), F.lit(0)).cast("long").alias(counts[1]),
    )
