"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. A window is ``SHINGLES`` consecutive
shingles; windows follow each other shingle-complete and overlap in four words. Every template is cut into all its
windows, at every offset, so a document window inside a template passage equals one of them, and one that only touches
a passage of one shingle is half of a window. A band is one MinHash value, so 16 bands find the first for sure and the
second with probability 1 - 2^-16 > 0.99998. Retrieved (document, template)
pairs are verified exactly: the share of the template's distinct shingles that the document contains must reach the limit.

The templates are a fixed list, so their band table is small by construction and is broadcast; documents are never
shuffled. Defined results: null and short texts (no full shingle) match nothing; a template shorter than five words is
one shingle of all its words and found as such only if the document is equally short; repeated rows give repeated
results; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, SHINGLES, BANDS = 5, 2, 16
MIN_CONTAINMENT = 0.8

# Public license names and the notice texts their licenses prescribe.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 International."),
)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """xxHash of every run of five words (of the whole text, if it has fewer; none, if it has none)."""
    words = rows.select(*keys, F.transform(word_list(rows[text]), lambda w: F.xxhash64(w)).alias("words"))
    n, starts = F.size("words"), F.sequence(F.lit(0), F.greatest(F.size("words") - WORDS, F.lit(0)))
    full = F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WORDS))))
    return words.select(*keys, F.when(n > 0, full).otherwise(F.array().cast("array<bigint>")).alias("shingles"))


def windows(rows: DataFrame, step: int, *keys: str) -> DataFrame:
    """A row per window of SHINGLES shingles (every ``step`` shingles; the last may be shorter) and band, with the band's
    key: the least of the window's shingles under the band's own hash.

    The outer form keeps the optimizer from evaluating the shingles a second time for a filter below the explode; a text
    without shingles gives one window of null keys, which joins nothing. Both explodes and the probe of the broadcast
    table run in one generated loop, so the rows between them are never stored.
    """
    at = F.explode_outer(
        F.when(F.size("shingles") > 0, F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(step)))
    ).alias("at")
    banded = rows.select(*keys, "shingles", at).select("*", F.explode(F.array(*map(F.lit, range(BANDS)))).alias("n"))
    window = [F.get("shingles", F.col("at") + k) for k in range(SHINGLES)]
    key = F.least(*(F.when(s.isNotNull(), F.xxhash64("n", s)) for s in window))
    return banded.select(*keys, "shingles", key.alias("band"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, of, shingles): one row per template; ``of`` is its number of distinct shingles."""
    listed = [F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*listed)))
    made = shingled(rows, "text", "template", "license")
    return made.select("template", "license", F.array_distinct("shingles").alias("of_shingles"), "shingles")


def matches(docs: DataFrame, templates=TEMPLATES, least: float = MIN_CONTAINMENT) -> DataFrame:
    """Per document and template: doc_id, license, template, containment (the share of the template that is present)."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    banded = windows(table, 1, "template").select("template", "band").distinct()
    by_band = banded.groupBy("band").agg(F.collect_list("template").alias("templates"))
    own = docs.select(docs["doc_id"], F.monotonically_increasing_id().alias("row"), docs["text"])
    of_docs = windows(shingled(own, "text", "doc_id", "row"), SHINGLES, "doc_id", "row")
    found = of_docs.join(F.broadcast(by_band), "band").select("doc_id", "row", "shingles", F.explode("templates").alias("template"))
    shared = found.join(F.broadcast(table.select("template", "license", "of_shingles")), "template").select(
        "doc_id", "row", "template", "license",
        (F.size(F.array_intersect("of_shingles", "shingles")) / F.size("of_shingles")).alias("containment"),
    )
    verified = shared.where(F.col("containment") >= least)
    once = verified.groupBy("doc_id", "row", "template", "license").agg(F.max("containment").alias("containment"))
    return once.drop("row")
