"""Operator 9: license scans by MinHash bands over overlapping windows, in DataFrame functions only.

Words are lower case, split at white space and ASCII punctuation; shingles are runs of three words. Windows of six shingles
(eight words) start at every fourth word of a text and at every word of a template. A band is one MinHash: the smallest
shingle of the window by the band's own hash. Windows that share a band retrieve the template;
then the shingles of the template are looked up exactly in the text around the hit, and the match stands if at least
``CONTAINED`` of them are there.

The bands guarantee retrieval: a template of at least five words that occurs unchanged lies, with three shingles or more, in
one window of at most six, so that their Jaccard similarity is 1/2 at least, and one of eight bands collides with probability
1 - 2^-8 (99.6 %). In a longer template some window of the text is a window of the template, and all bands collide. Shorter
templates are refused.

A band value whose bit is not set in the bit map of the templates' values is dropped in its row; the others are joined with
the templates, which are broadcast: their number is checked against ``MOST_WORDS``, and beyond it the join is shuffled.
Nothing else moves but matches. Null and empty texts match nothing; an empty table gives an empty result; rows that repeat an
id give one row per template, the best match, at its first place. Of templates found at the same place only the best stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.llm.common import keyed, table

GRAM, WINDOW, STRIDE, BANDS = 3, 6, 4, 8
CONTAINED = 0.8
LEAST_WORDS = 5
MOST_WORDS = 200_000
_BITS = 1 << 18

# --- fixed values: public license notices ---
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# --- end of fixed values ---


def _shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds w (hashes of the words) and g (hashes of the shingles); a text with fewer words has its whole sequence as one."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\s\p{Punct}]+"), lambda x: x != "")
    df = df.withColumn("w", F.transform(words, lambda x: F.xxhash64(x)))
    runs = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + k) for k in range(1, GRAM)]))
    return df.withColumn("g", F.slice(runs, F.lit(1), F.greatest(F.size("w") - (GRAM - 1), F.least(F.size("w"), F.lit(1)))))


def _bands(df: DataFrame, stride: int) -> DataFrame:
    """Adds bands: (at, band, value) of all windows that start at multiples of the stride."""
    for p in range(BANDS):
        df = df.withColumn(f"g{p}", F.expr(f"transform(g, x -> xxhash64(x, {p}))"))
    last = F.greatest(F.size("g") - (WINDOW if stride == 1 else 1), F.lit(0))
    df = df.withColumn("starts", F.sequence(F.lit(0), last, F.lit(stride)))

    def band(p: int) -> Column:
        least = lambda s: F.array_min(F.slice(F.col(f"g{p}"), s + 1, F.lit(WINDOW)))
        return F.transform("starts", lambda s: F.struct(s.alias("at"), F.lit(p).alias("band"), least(s).alias("value")))

    return df.withColumn("bands", F.concat(*[band(p) for p in range(BANDS)])).drop("starts", *[f"g{p}" for p in range(BANDS)])


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, template, containment, first_word): the templates (template, text) found in each document."""
    known = _shingles(templates.filter(F.col("text").isNotNull()).select(F.col("template"), F.col("text")), "text")
    size = known.agg(
        F.coalesce(F.min(F.size("w")), F.lit(LEAST_WORDS)).alias("least"), F.coalesce(F.max(F.size("w")), F.lit(0)).alias("most"),
        F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("all"),
    ).first()
    if size["least"] < LEAST_WORDS:
        raise ValueError(f"a template needs at least {LEAST_WORDS} words")
    longest = int(size["most"])
    pieces = _bands(known, 1).select("template", F.array_distinct("g").alias("t"), F.get("g", F.lit(0)).alias("t0"), F.size("g").alias("length"), F.inline("bands")).select(
        "template", "t", "t0", "length", F.col("at").alias("t_at"), "band", "value"
    )
    word = F.shiftright(F.col("value").bitwiseAND(F.lit(_BITS - 1)), 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(value & 63 as int))")
    bits = [0] * (_BITS // 64)
    for row in pieces.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect():  # _BITS / 64 rows at most
        bits[row["word"]] = row["bits"]
    bit_map = "array(" + ",".join(f"{b}L" if b != -(1 << 63) else "shiftleft(1L, 63)" for b in bits) + ")"

    rows = _bands(_shingles(keyed(docs, id_col, text_col).filter(F.col("text") != ""), "text").select("id", "g"), STRIDE)
    at_word = f"get({bit_map}, cast(shiftright(b.value & {_BITS - 1}, 6) as int))"
    is_set = f"(shiftrightunsigned({at_word}, cast(b.value & 63 as int)) & 1L) = 1L"
    hits = rows.select("id", "g", F.expr(f"filter(bands, b -> {is_set})").alias("hits"))
    # each hit takes along the shingles around it
    from_ = lambda at: F.greatest(at - F.lit(longest), F.lit(0))
    around = F.transform("hits", lambda b: F.struct(
        b["at"].alias("at"), b["band"].alias("band"), b["value"].alias("value"), from_(b["at"]).alias("start"),
        F.slice(F.col("g"), from_(b["at"]) + 1, F.lit(2 * longest + WINDOW)).alias("near"),
    ))
    hits = hits.select("id", F.inline(around))
    found = hits.join(F.broadcast(pieces) if size["all"] <= MOST_WORDS else pieces, ["band", "value"])
    # the text beside the template; to spare on either side are a fifth of its length and the width of a window
    spare = F.floor(F.col("length") / 5).cast("int") + WINDOW
    left = F.greatest(F.col("at") - F.col("t_at") - spare, F.col("start"))
    beside = F.slice("near", left - F.col("start") + 1, F.col("length") + 2 * spare)
    share = F.size(F.array_intersect("t", beside)) / F.size("t")
    begins = F.array_position(beside, F.col("t0")).cast("int")
    first = F.when(begins > 0, left + begins - 1).otherwise(F.greatest(F.col("at") - F.col("t_at"), F.lit(0)))
    kept = found.select("id", "template", share.alias("share"), first.alias("first")).filter(F.col("share") >= contained)
    best = kept.groupBy("id", "template").agg(F.max(F.struct("share", -F.col("first"))).alias("m"))
    best = best.select("id", "template", F.col("m.share").alias("containment"), (-F.col("m.col2")).alias("first_word"))
    # a place has at most as many rows as there are templates
    place = W.partitionBy("id", "first_word")
    best = best.withColumn("top", F.max("containment").over(place)).filter(F.col("containment") == F.col("top"))
    return best.select(F.col("id").alias(id_col), "template", "containment", "first_word")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(f"{i}:{name}", text) for i, (name, text) in enumerate(TEMPLATES)]
    found = scan(table(spark, sf_dir, "documents"), spark.createDataFrame(names, "template string, text string"))
    # a license is told by its best template
    best = found.withColumn("license", F.regexp_replace("template", r"^\d+:", "")).groupBy("doc_id", "license").agg(
        F.max(F.struct("containment", -F.col("first_word"))).alias("m")
    )
    return best.select("doc_id", "license", F.col("m.containment").alias("containment"), (-F.col("m.col2")).alias("first_word"))
