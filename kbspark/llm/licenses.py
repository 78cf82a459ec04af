"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

Words of five make shingles. A window holds twice as many shingles as the templates of its size class and the next one begins half a window
later, so every occurrence of a template lies wholly in some window. Each band is one MinHash value of the window's shingles; a window that
contains at least eight tenths of its template has a similarity of 0.19 or more to it, so one of 64 bands agrees with a probability of at least
1 - 0.81**64 > 0.999998. Templates too small for their class to reach that similarity are met by shingles instead: a window that lacks so few of
a template's shingles as the containment allows holds one of any so many and one more. Windows and templates that share a band or such a
shingle are verified exactly: the share of the template's distinct shingles that the window holds.

A band can only agree on a shingle that both hold. So texts and windows without any shingle of a template go before bands are made, which
changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
SIMILAR = 0.19  # similarity from which bands find a template
CLASSES = (8, 16, 32, 64, 128)  # shingles of the largest template of a class

# Notices by which texts declare a license, and the first sentences of common license texts.
TEMPLATES = {
    "mit-short": "Released under the MIT License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it; a column that is merely named may be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(own: Column) -> Column:
    """Hashes of the shingles of an array of words, in order; none for fewer words than a shingle has."""
    at = lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(SHINGLE)])
    return F.when(F.size(own) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(own) - SHINGLE), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def _bands(column: str) -> Column:
    """(band, smallest hash) of an array of shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.array_min(F.transform(F.col(column), lambda s: F.xxhash64(s, i))).alias("low")),
    )


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``license``, its distinct shingles and size class. Texts shorter than a shingle or longer than the last class cannot be templates."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in texts.items()])
    own = let(words(F.col("t.text")), lambda w: F.array_distinct(shingles(w)))
    out = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", own.alias("template")).where(F.size("template") > 0)
    size = F.lit(None).cast("int")
    for c in reversed(CLASSES):
        size = F.when(F.size("template") <= c, F.lit(c)).otherwise(size)
    return out.withColumn("class", size)


def keys(own: list[int], size: int, containment: float) -> list[int]:
    """Shingles of which every window that holds enough of a template holds one; none for a template that bands find."""
    need = max(1, math.ceil(containment * len(own) - 1e-9))
    similar = need / (2 * size + len(own) - need)
    return [] if similar >= SIMILAR else sorted(own)[: len(own) - need + 1]


def scan(docs: DataFrame, key: str, text: str, texts: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row per document and license found: ``key``, ``license``, ``containment`` (the best of a window), ``windows`` (how many hold it) and
    ``first_word`` (where the first of these begins).

    Null and empty texts hold no license, nor do texts shorter than a template. Repeated rows with one key count their windows together.
    """
    known = templates(docs.sparkSession, texts)
    found = known.collect()  # as many as templates are given
    if bad := [r["license"] for r in found if r["class"] is None]:
        raise ValueError(f"templates too long: {bad}")
    wanted = sorted({s for r in found for s in r["template"]})
    name = fresh(docs, "license")[0]
    by_class = {c: sorted({s for r in found if r["class"] == c for s in r["template"]}) for c in sorted({r["class"] for r in found})}

    def of_class(own: Column, c: int) -> Column:
        one = lambda at: F.struct(at.alias("start"), F.lit(c).alias("class"), F.array_distinct(F.slice(own, at + 1, 2 * c)).alias("window"))
        every = F.transform(F.sequence(F.lit(0), F.size(own) - 1, F.lit(c)), one)
        return F.filter(every, lambda x: F.exists(x["window"], lambda s: s.isin(by_class[c])))

    def of_text(own: Column) -> Column:
        return F.when(F.exists(own, lambda s: s.isin(wanted)), F.flatten(F.array(*[of_class(own, c) for c in by_class])))

    # one expression gives a text's windows, so its words and shingles are made once
    made = let(words(F.col(text)), lambda w: let(shingles(w), of_text))
    windows = docs.select(F.col(key).alias("key"), F.inline(made))
    exact = {r["license"]: k for r in found if (k := keys(r["template"], r["class"], containment))}
    single = lambda held: F.transform(held, lambda s: F.struct(F.lit(-1).alias("band"), s.alias("low")))
    met_by, of_template = _bands("window"), _bands("template")
    if exact:
        listed = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
        met_by = F.concat(met_by, single(F.array_intersect("window", listed(sorted({s for k in exact.values() for s in k})))))
        for name_of, own in exact.items():
            of_template = F.when(F.col("license") == name_of, single(listed(own))).otherwise(of_template)
    banded = windows.select("*", F.explode(met_by).alias("b")).select("key", "start", "class", "window", "b.band", "b.low")
    index = known.select("license", "template", "class", F.explode(of_template).alias("b")).select(
        "license", "template", F.col("class").alias("t_class"), F.col("b.band").alias("t_band"), F.col("b.low").alias("t_low")
    )
    met = banded.join(
        F.broadcast(index), (F.col("class") == F.col("t_class")) & (F.col("band") == F.col("t_band")) & (F.col("low") == F.col("t_low"))
    )  # the index has at most BANDS rows a template, or those of its keys
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    kept = met.withColumn("share", share).where(F.col("share") >= containment).select("key", "start", "license", "share")
    # several bands or shingles may find one window
    once = kept.groupBy("key", "license", "start").agg(F.max("share").alias("share"))
    return once.groupBy("key", "license").agg(
        F.max("share").alias("containment"), F.count(F.lit(1)).alias("windows"), F.min("start").cast("long").alias("first_word")
    ).select(F.col("key").alias(key), F.col("license").alias(name), "containment", "windows", "first_word")


def oracle(texts: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result over ``documents`` in SQL, by comparing every window."""
    rows = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in texts.items())
    classes = " ".join(f"WHEN n <= {c} THEN {c}" for c in CLASSES)
    split = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    shingled = f"SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM"
    return f"""WITH given(license, text) AS (VALUES {rows}),
    t AS (SELECT DISTINCT license, list_aggregate(w[i:i + {SHINGLE - 1}], 'string_agg', ' ') AS s
          FROM ({shingled} (SELECT license, {split} AS w FROM given))),
    sized AS (SELECT license, count(*) AS n FROM t GROUP BY license),
    classed AS (SELECT license, n, CASE {classes} END AS class FROM sized),
    d AS (SELECT doc_id, i - 1 AS pos, list_aggregate(w[i:i + {SHINGLE - 1}], 'string_agg', ' ') AS s
          FROM ({shingled} (SELECT doc_id, {split} AS w FROM documents))),
    hit AS (SELECT d.doc_id, d.pos, d.s, license, n, class FROM d JOIN t USING (s) JOIN classed USING (license)),
    win AS (SELECT *, unnest([pos // class, pos // class - 1]) AS k FROM hit),
    held AS (SELECT doc_id, license, k * class AS start, count(DISTINCT s) / any_value(n) AS share FROM win WHERE k >= 0
             GROUP BY doc_id, license, k, class)
    SELECT doc_id, license, max(share) AS containment, count(*) AS windows, min(start) AS first_word
    FROM held WHERE share >= {containment} GROUP BY doc_id, license"""
