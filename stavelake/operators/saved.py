"""A reference distribution saved as tables: fitted once, scored anywhere without its pieces.

A save writes the tables of a new version next to the others and then replaces the small file ``CURRENT`` in one rename,
so readers see the old version or the new one, never a mixture; a save that fails leaves the old one in place. Old versions
stay for readers that have begun. Reading checks the format and every table's columns and types.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from stavelake.operators.corpus import Corpus

FORMAT = 1
TABLES = ("cumulative", "breakpoints", "genre_bands")


def _schema(df: DataFrame) -> list[list[str]]:
    return sorted([f.name, f.dataType.simpleString()] for f in df.schema.fields)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by any file system that Spark reads, and put it in place atomically."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target, part = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(part)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)


def save(corpus: Corpus, path: str) -> str:
    """Save a distribution below ``path``; the name of the new version."""
    version = uuid.uuid4().hex
    tables = {name: getattr(corpus, name) for name in TABLES}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    state = {"format": FORMAT, "version": version, "tables": {name: _schema(df) for name, df in tables.items()}}
    _replace(corpus.fingerprint.sparkSession, f"{path}/CURRENT", json.dumps(state))
    return version


class SavedCorpus(Corpus):
    """The current version of a saved distribution: scores fingerprints, knows breakpoints and bands, holds no pieces."""

    def __init__(self, spark: SparkSession, path: str):
        state = json.loads(spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0])
        if state["format"] != FORMAT:
            raise ValueError(f"saved distribution has format {state['format']}, not {FORMAT}")
        self.version = state["version"]
        for name in TABLES:
            df = spark.read.parquet(f"{path}/{self.version}/{name}")
            if _schema(df) != state["tables"].get(name):
                raise ValueError(f"table {name} of the saved distribution has other columns than were written")
            self.__dict__[name] = df

    def report(self, fingerprint: DataFrame) -> DataFrame:
        """``Corpus.profile_report`` for any pieces: (piece_id, axis, value) rows."""
        scored = copy.copy(self)
        scored.__dict__["profile"] = self.score(fingerprint)
        return scored.profile_report()
