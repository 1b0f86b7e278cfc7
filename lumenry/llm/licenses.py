"""License scans: MinHash bands over text windows, in DataFrame expressions only.

Templates are license notices as sets of five-word shingles.  A document's
words are cut into overlapping windows, for each size that a template has; a
window's MinHash bands retrieve the templates that share a band, and exact
containment of the template's shingles in the window, at 0.8 or more, verifies
the match.

Bands hold one value each and there are ``BANDS``.  A window that starts within
an eighth of its size of a match shares at least J = 0.5 of its shingles with
the template, so it is missed with a probability below 2 ** -BANDS; a window
on the spot, with nothing but the fifth that may differ, with one of 1 in
10 ** 9 or less.

Only windows near an anchor are made.  Anchors are words chosen so that of each
template more than a fifth of the shingles hold one; where none stands, no
template can be matched, so nothing is lost.  All of it happens inside the row:
no shuffle, no join, whatever a document repeats.

Results: a null or empty text has no matches.  A template is reported at every
place it stands; overlapping windows of one template are one place, where it
fits best (ties: the first).  A place that overlaps one that stays and is
contained better goes.  Places are resolved in runs that no match spans, so
the cost follows the matches.  Repeated rows get equal results, whole texts are read,
and an empty table gives an empty one.  Columns of any name pass through, but
for one of the result's name, which the result replaces.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import set_aside

WORDS, CONTAINED, BANDS = 5, 0.8, 24

# Notices as licenses ask for them, by their public identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingle_words(text: str) -> list[list[str]]:
    w = template_words(text)
    return [w[i : i + WORDS] for i in range(max(1, len(w) - WORDS + 1))]


def anchors(templates=TEMPLATES) -> list[str]:
    """Words of some length such that without them no template reaches the containment."""
    sets = [list({" ".join(s): s for s in _shingle_words(t)}.values()) for _, t in templates]
    chosen: list[str] = []

    def open_ones() -> list[list[list[str]]]:
        return [s for s in sets if sum(not set(x) & set(chosen) for x in s) >= CONTAINED * len(s)]

    while left := open_ones():
        words = sorted({w for s in left for x in s for w in x if len(w) >= 6 or w == "cc"})
        chosen.append(max(words, key=lambda w: (sum(sum(w in x for x in s) > (1 - CONTAINED) * len(s) for s in left), len(w), w)))
    return chosen


def _shingle_hashes(words: Column) -> Column:
    """A hash of the five words from each place; a shorter text is one shingle."""
    last = F.greatest(F.size(words) - WORDS, F.lit(0))
    return F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))


def _permuted(hashes: Column) -> Column:
    """For each band, the shingle hashes in another order."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.transform(hashes, lambda x: F.xxhash64(b, x)))


def _bands(permuted: Column, start: Column, n: Column) -> Column:
    """Band values of the n shingles from start (1-based): the least of each order, named by its band."""
    return F.transform(permuted, lambda p, b: F.xxhash64(b, F.array_min(F.slice(p, start, n))))


_COMPILED = "array<struct<license: string, template: int, n: int, set: array<bigint>, bands: array<bigint>>>"


def compiled(spark: SparkSession, templates=TEMPLATES) -> tuple[Column, list[int]]:
    """The templates with their shingle hashes and bands, as a literal; they come from
    the expressions that documents go through."""
    rows = [{"i": i, "license": name, "words": template_words(text)} for i, (name, text) in enumerate(templates)]
    df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<i: int, license: string, words: array<string>>>")))
    df = df.withColumn("sh", _shingle_hashes(F.col("words"))).withColumn("pm", _permuted(F.col("sh")))
    one = F.struct("license", F.col("i").alias("template"), F.size("sh").alias("n"), F.array_distinct("sh").alias("set"), _bands(F.col("pm"), F.lit(1), F.size("sh")).alias("bands"))
    made = [json.loads(r[0]) for r in df.orderBy("i").select(F.to_json(one)).collect()]
    return F.from_json(F.lit(json.dumps(made)), _COMPILED), sorted({m["n"] for m in made})


def scan(docs: DataFrame, *, text: str = "text", templates=TEMPLATES, name: str = "_licenses") -> DataFrame:
    """docs with an array column ``name`` of (license, template, start, end,
    contained): words from start, end exclusive.

    Each array is a column that the next one uses twice, so that it is computed
    once a row and not once an element.
    """
    docs, own, keep = set_aside(docs, name)
    text = own[text]
    table, sizes = compiled(docs.sparkSession, templates)
    marks = anchors(templates)
    kind = "array<struct<license:string,template:int,start:int,end:int,contained:double>>"
    some = F.coalesce(F.lower(F.col(text)).rlike("|".join(marks)), F.lit(False))
    empty = lambda t: F.array().cast(f"array<{t}>")
    df = docs.withColumn("_w", F.when(some, F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).otherwise(empty("string")))
    mark = F.array(*[F.lit(m) for m in marks])
    at = F.filter(F.transform("_w", lambda w, i: F.when(F.array_contains(mark, w), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.when(F.size("_w") > 0, at).otherwise(empty("int")))
    df = df.withColumn("_sh", F.when((F.size("_at") > 0) & (F.size("_w") > 0), _shingle_hashes(F.col("_w"))).otherwise(empty("bigint")))
    df = df.withColumn("_pm", F.when(F.size("_sh") > 0, _permuted(F.col("_sh"))).otherwise(empty("array<bigint>")))

    def windows(n: Column) -> Column:
        """(n, start): starts on a grid from which an anchor is reached."""
        step, last = F.greatest(F.lit(1), F.floor(n / 8).cast("int")), F.greatest(F.size("_sh") - n, F.lit(0))
        first = lambda p: F.floor(F.greatest(p - n - WORDS + 2, F.lit(0)) / step).cast("int")
        final = lambda p: F.ceil(F.least(p, last) / step).cast("int")
        grids = F.flatten(F.transform("_at", lambda p: F.when(first(p) <= final(p), F.sequence(first(p), final(p))).otherwise(empty("int"))))
        return F.transform(F.array_distinct(grids), lambda g: F.struct(n.alias("n"), F.least(g * step, last).cast("int").alias("s")))

    every = F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), windows))
    df = df.withColumn("_win", F.when((F.size("_at") > 0) & (F.size("_sh") > 0), every).otherwise(empty("struct<n:int,s:int>")))
    banded = F.transform("_win", lambda w: F.struct(w["n"].alias("n"), w["s"].alias("s"), _bands(F.col("_pm"), w["s"] + 1, w["n"]).alias("bands")))
    df = df.withColumn("_band", F.when((F.size("_win") > 0) & (F.size("_pm") > 0), banded).otherwise(empty("struct<n:int,s:int,bands:array<bigint>>")))

    df = df.withColumn("_tpl", F.when(F.size("_band") > 0, table).otherwise(F.from_json(F.lit("[]"), _COMPILED)))

    def retrieved(w: Column) -> Column:
        """Templates that share a band, with how much of each the window holds; the
        window for this check reaches an eighth further on both sides."""
        slack = F.floor(w["n"] / 8).cast("int")
        begin = F.greatest(w["s"] - slack, F.lit(0))
        held = lambda t: F.size(F.array_intersect(t["set"], F.slice(F.col("_sh"), begin + 1, w["n"] + 2 * slack))) / F.size(t["set"])
        hit = F.filter(F.col("_tpl"), lambda t: (t["n"] == w["n"]) & F.arrays_overlap(t["bands"], w["bands"]))
        return F.transform(hit, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), w["s"].alias("start"), (w["s"] + w["n"] + WORDS - 1).alias("end"), held(t).alias("contained")))

    found = F.filter(F.flatten(F.transform("_band", retrieved)), lambda m: m["contained"] >= CONTAINED)
    df = df.withColumn("_all", F.when((F.size("_band") > 0) & (F.size("_sh") > 0) & (F.size("_tpl") > 0), found).otherwise(empty(kind[6:-1])))
    df = df.withColumn("_fit", F.when((F.size("_all") > 0) & (F.size("_sh") > 0) & (F.size("_tpl") > 0), F.transform("_all", _fitted)).otherwise(empty(f"struct<at:struct<held:int,back:int>,m:{kind[6:-1]}>")))
    placed = F.array_sort(F.transform("_fit", _placed))
    df = df.withColumn("_placed", F.when(F.size("_fit") > 0, placed).otherwise(empty(_PLACE)))
    before = lambda c, i: F.get(F.col(c), i - 1)
    fresh = lambda m, i: F.coalesce((before("_placed", i)["start"] != m["start"]) | (before("_placed", i)["template"] != m["template"]), F.lit(True))
    df = df.withColumn("_one", F.when(F.size("_placed") > 0, F.filter("_placed", fresh)).otherwise(empty(_PLACE)))
    far = lambda m, i: F.coalesce(m["start"] - before("_one", i)["start"] >= max(sizes) + WORDS - 1, F.lit(True))
    cuts = F.filter(F.transform("_one", lambda m, i: F.when(far(m, i), i)), lambda i: i.isNotNull())
    df = df.withColumn("_cut", F.when(F.size("_one") > 0, cuts).otherwise(empty("int")))
    runs = F.transform("_cut", lambda b, j: F.slice(F.col("_one"), b + 1, F.coalesce(F.get(F.col("_cut"), j + 1), F.size("_one")) - b))
    kept = F.flatten(F.transform(runs, _resolved))
    out = F.transform(kept, lambda m: F.struct(m["license"].alias("license"), m["template"].alias("template"), m["start"].alias("start"), m["end"].alias("end"), (-m["less"]).alias("contained")))
    return df.select(*keep, F.when((F.size("_cut") > 0) & (F.size("_one") > 0), out).otherwise(empty(kind[6:-1])).alias(name))


#: A match at its place; less and loose are negative: how much the wider window, and the template's own size, hold.
_PLACE = "struct<start:int,template:int,less:double,loose:int,license:string,end:int>"


def _fitted(m: Column) -> Column:
    """The match with the place in its wider window where the template's own size holds most (ties: the first)."""
    n = m["end"] - m["start"] - (WORDS - 1)
    slack = F.floor(n / 8).cast("int")
    own = F.element_at(F.col("_tpl"), m["template"] + 1)["set"]
    starts = F.sequence(F.greatest(m["start"] - slack, F.lit(0)), F.greatest(m["start"], F.least(m["start"] + slack, F.size("_sh") - n)))
    held = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(own, F.slice(F.col("_sh"), s + 1, n))).alias("held"), (-s).alias("back")))
    return F.struct(F.array_max(held).alias("at"), m.alias("m"))


def _placed(f: Column) -> Column:
    m, start = f["m"], -f["at"]["back"]
    return F.struct(
        start.alias("start"), m["template"].alias("template"), (-m["contained"]).alias("less"), (-f["at"]["held"]).alias("loose"), m["license"].alias("license"),
        (start + m["end"] - m["start"]).alias("end"),
    )


def _resolved(run: Column) -> Column:
    """The places that stay: neighbouring windows of one template become the one that
    fits best, then what overlaps a place that is contained better goes."""
    overlap = lambda k, m: (k["start"] < m["end"]) & (k["end"] > m["start"])

    def kept(places: Column, by: tuple[str, ...], goes) -> Column:
        """Those, best first, that no place kept before sends away."""
        order = F.array_sort(F.transform(places, lambda m: F.struct(*[m[c].alias(f"_{c}") for c in by], m.alias("m"))))
        none = F.array().cast(f"array<{_PLACE}>")
        return F.aggregate(order, none, lambda a, x: F.when(F.exists(a, lambda k: overlap(k, x["m"]) & goes(k, x["m"])), a).otherwise(F.concat(a, F.array(x["m"]))))

    places = kept(run, ("loose", "less", "start"), lambda k, m: k["template"] == m["template"])
    return kept(places, ("less", "start"), lambda k, m: k["less"] < m["less"])
