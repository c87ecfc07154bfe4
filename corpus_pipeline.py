"""The corpus pipeline: quality rules, line dedup, exact near-dedup, benchmark decontamination, source mix.

Every stage takes all documents that its predecessor kept and decides by the operator's production parameters:

* quality rules drop the documents that the rules reject;
* line dedup removes cross-site boilerplate lines (the earliest place of a line stays) and drops the documents it leaves
  without any line, which showed nothing but such lines;
* near-dedup keeps the document with the smallest doc_id of each component, linked by five-word similarity of 0.8 or more;
* decontamination drops the documents that leak a benchmark item;
* the mix drops what it does not take and says how often it repeats the rest (``mix_copies``).

Null and empty texts fail the quality rules; a null id is an id like any other (in near-dedup it represents a component only
if that has no other); equal rows go through together and the first near-dedup keeps one of them; an empty table gives an
empty result. Columns of any name pass through unchanged; ``n_chars``, if there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm import decontaminate, line_dedup, near_dedup, quality_rules, source_mix
from stavelake.llm.common import read, scratch, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_lines, n_removed = unused(docs, "ld_lines", "ld_removed")
    made = line_dedup.cleaned(docs, counts=(n_lines, n_removed))
    made = made.where((F.col(n_lines) > F.col(n_removed)) | (F.col(n_lines) == 0))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.drop(n_lines, n_removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", mix),
]

#: SimHash and similarity joins over XXH64, Zstandard ratios and the cube method are not expressible in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, written to the shared folder and read again in between."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
