"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block whose texts
an array aggregation joins; blocks are concatenated. Every control string starts with ``<|``. A text (or role) that holds
``<|``, with or without backslashes between the two characters, gets one more backslash there, so no text can forge a
control string and reading back removes exactly that backslash. The loss mask is a list of (start, length) spans in code
points: the assistant texts, without any control string. Its running offsets are summed in slices of ``CHUNK`` texts, then
over the slices, so a conversation of very many turns costs little more than its length.

Format: ``<|turn|>role<|text|>first text<|part|>next text of the same role<|end|>`` and so on.

Defined results: null texts and roles read as empty; null turns sort first, and rows that agree in turn are ordered by
role and text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty
result. One conversation is one string and so one row, by the nature of the output. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
SPANS = "array<struct<start:bigint,length:bigint>>"
CHUNK = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start from 0, length; both in code points)."""
    none = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), escaped(F.coalesce("role", none)).alias("role"), escaped(F.coalesce("text", none)).alias("text")
        ).alias("row"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    index = F.sequence(F.lit(1), F.size("rows"))
    role_at = lambda i: F.element_at("rows", i)["role"]
    starts = F.filter(index, lambda i: F.when(i == 1, True).otherwise(role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    cut_up = sorted_rows.select("conv_id", "rows", starts.alias("starts"))
    blocks = F.transform(
        "starts",
        lambda start, k: F.struct(
            F.element_at("rows", start)["role"].alias("role"),
            F.slice("rows", start, F.coalesce(F.get("starts", k + 1), F.size("rows") + 1) - start)["text"].alias("texts"),
        ),
    )
    rendered = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(TURN), b["role"], F.lit(TEXT)).alias("head"), F.array_join(b["texts"], PART).alias("body"),
            (b["role"] == loss_role).alias("is_loss"), F.transform(b["texts"], F.char_length).alias("lengths"),
        ),
    )
    made = cut_up.select("conv_id", blocks.alias("blocks")).select("conv_id", rendered.alias("blocks"))
    return made.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END))), "").alias("formatted"),
        _items(F.col("blocks")).alias("items"),
    ).select("conv_id", "formatted", F.transform(_parts(F.col("items")), _local_spans).alias("parts")).select(
        "conv_id", "formatted", _placed(F.col("parts")).alias("loss_spans")
    )


def _parts(items: Column) -> Column:
    """The array in slices of CHUNK, so that what is copied per step stays small however long a conversation is."""
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


def _items(blocks: Column) -> Column:
    """Per text: code points of control strings before it, its length, and whether it is under the mask."""
    def of(block: Column, k: Column) -> Column:
        head = F.char_length(block["head"]) + F.when(k > 0, len(END)).otherwise(0)
        return F.transform(block["lengths"], lambda n, j: F.struct(
            F.when(j == 0, head).otherwise(len(PART)).cast("long").alias("lead"), n.cast("long").alias("length"), block["is_loss"].alias("is_loss"),
        ))

    return F.flatten(F.transform(blocks, of))


def _local_spans(part: Column) -> Column:
    """The spans of one slice, counted from its start, and its length."""
    def step(acc: Column, item: Column) -> Column:
        start = acc["at"] + item["lead"]
        span = F.array(F.struct(start.alias("start"), item["length"].alias("length")))
        return F.struct((start + item["length"]).alias("at"), F.when(item["is_loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans")), step)


def _placed(parts: Column) -> Column:
    """All spans, from those of the slices and the slices' running offsets."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    offsets = F.aggregate(
        parts, none, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    )["starts"]
    moved = lambda p, at: F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))
    return F.flatten(F.zip_with(parts, offsets, moved))


def _under_mask(text: Column, spans: Column) -> Column:
    """The text under the spans. A position in UTF-8 is found by counting from the start, so each slice of spans first
    cuts out the stretch that it covers."""
    def of(part: Column) -> Column:
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        stretch = F.substring(text, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
        cut_out = lambda held: F.transform(part, lambda s: unescaped(
            F.substring(held, (s["start"] - first["start"] + 1).cast("int"), s["length"].cast("int"))
        ))
        return F.array_join(F.flatten(F.transform(F.array(stretch), cut_out)), "")

    return F.array_join(F.transform(_parts(spans), of), "")


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the formatted string and its mask: the turns (role, text) and the texts under the mask."""
    chunks = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.size(F.split("formatted", r"<\|turn\|>")))

    def turns_of(chunk: Column) -> Column:
        role = F.substring_index(chunk, TEXT, 1)
        body = F.substring_index(F.substring_index(chunk, TEXT, -1), END, 1)
        return F.transform(F.split(body, r"<\|part\|>"), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return made.select(
        "conv_id", "formatted", F.flatten(F.transform(chunks, turns_of)).alias("turns"),
        _under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss_text"),
    )


def digest(made: DataFrame) -> DataFrame:
    """Counts and hashes of what reading back gives."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(made).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
