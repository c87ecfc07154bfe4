"""What the operators of this subpackage share: reading, byte views, lineage cuts, a shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.session import checkpoint_dir, cut_lineage

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text's bytes; null reads as empty."""
    return F.coalesce(text.cast("binary"), F.lit(bytearray()))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder, so that a lost executor costs a re-read."""
    return cut_lineage(df)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: like ``cut``, and of a size that Spark knows when it plans joins."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none of them is a column of ``df`` (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes in a text column, for choosing a number of partitions."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, each: int, least: int = 8) -> int:
    """How many parts of about ``each`` a total makes."""
    return max(least, -(-total // each))
