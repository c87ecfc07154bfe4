import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that the operators might be tempted to use inside.
CLASHING = ["kept", "fp", "body", "places", "words", "shingles", "found", "mix_size", "ld_removed", "ld_places", "first_doc", "mix_doc", "size", "key", "n"]


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text, source) rows, with or without clashing extra columns."""

    def build(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        return df.selectExpr("*", *(f"doc_id AS {c}" for c in CLASHING)) if clash else df

    return build


@pytest.fixture
def prose():
    """Distinct sentences of pseudo-words, by seed."""
    import random

    def make(seed, n=120):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make
