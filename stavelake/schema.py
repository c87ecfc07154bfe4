"""Relational data model: pieces, voices, bars and note events."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("piece_id", T.StringType()),
        T.StructField("voice", T.StringType()),
        T.StructField("voice_ix", T.IntegerType()),  # place in the header; null when the header omits the voice
        T.StructField("is_drum", T.BooleanType()),
        T.StructField("program", T.IntegerType()),
        T.StructField("bar", T.IntegerType()),
        T.StructField("grid", T.IntegerType()),
        T.StructField("onb", T.DoubleType()),
        T.StructField("abs", T.DoubleType()),
        T.StructField("dur", T.DoubleType()),
        T.StructField("midi", T.IntegerType()),
        T.StructField("pc", T.IntegerType()),
        T.StructField("vel", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

PIECES = T.StructType(
    [
        T.StructField("piece_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("meter_num", T.IntegerType()),
        T.StructField("meter_den", T.IntegerType()),
        T.StructField("bar_ql", T.DoubleType()),
        T.StructField("tempo", T.DoubleType()),
        T.StructField("default_grid", T.IntegerType()),
        T.StructField("n_bars", T.IntegerType()),
        T.StructField("voices", T.ArrayType(T.StringType())),
        T.StructField("voice_programs", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("drum_voices", T.ArrayType(T.StringType())),
    ]
)

BARS = T.StructType(
    [
        T.StructField("piece_id", T.StringType()),
        T.StructField("bar", T.IntegerType()),
        T.StructField("chord", T.StringType()),
        T.StructField("grid", T.IntegerType()),
        T.StructField("is_triplet", T.BooleanType()),
    ]
)
