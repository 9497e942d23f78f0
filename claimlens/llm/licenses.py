"""Licence scan: lines and word windows against licence templates by the Dice coefficient over
word bigrams.

Built from DataFrame functions only.  Every line of a text is normalised to lower-case words;
its distinct bigrams are compared with those of each template whose size lets the coefficient
reach the threshold.  Windows of words of the whole text are compared in the same way, so a notice
counts however it is wrapped and whatever stands around it.  The templates are literals of the
plan, so nothing is joined, and only matches reach the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual one-line grants and file headers of common licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_OTHER = "[^a-z0-9]+"


def template_words(text: str) -> list[str]:
    return re.sub(_OTHER, " ", text.lower()).split()


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Licence and distinct word bigrams of each template; those of one word are refused."""
    out = []
    for name, text in templates:
        words = template_words(text)
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if not grams:
            raise ValueError(f"template of {name} has no two words")
        out.append((name, grams))
    return out


def scan_lines(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every line that matches: ``doc_id, line_no`` (from 0), ``license, dice`` (the best template,
    ties to the name that sorts first) and ``line``.

    Both sizes and the shared bigrams are counts of distinct bigrams; a template can only reach
    the threshold ``t`` if ``t * (a + b) <= 2 * min(a, b)``.  Lines of fewer than two words and null
    texts match nothing.  Lines end at a line feed.
    """
    grams = template_bigrams(templates)
    least = min(-(-threshold * len(g) // (2 - threshold)) for _, g in grams)
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # a line of b bigrams has b+1 words at least, each a character and a separator
    lines = lines.where(F.length("line") >= int(2 * least + 1))
    # each explode of one value ends a projection: what it computes is computed once
    words = F.split(F.trim(F.regexp_replace(F.lower("line"), _OTHER, " ")), " ")
    lines = lines.select("doc_id", "line_no", "line", F.explode(F.array(words)).alias("words")).where(F.size("words") > int(least))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i))))
    lines = lines.select("doc_id", "line_no", "line", F.explode(F.array(pairs)).alias("grams"))
    literal = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*[F.lit(g) for g in gs]).alias("grams")) for name, gs in grams])

    def dice(t: Column) -> Column:
        a, b = F.size("grams"), F.size(t["grams"])
        shared = F.size(F.array_intersect(F.col("grams"), t["grams"]))
        return F.struct(F.when(F.lit(threshold) * (a + b) <= 2 * F.least(a, b), -(2.0 * shared / (a + b))).otherwise(F.lit(0.0)).alias("less"), t["license"].alias("license"))

    # the smallest struct: the largest coefficient, then the name that sorts first
    best = F.array_min(F.filter(F.transform(literal, dice), lambda x: -x["less"] >= threshold))
    found = lines.select("doc_id", "line_no", "line", F.explode(F.array(best)).alias("best")).where("best is not null")
    return found.select("doc_id", "line_no", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"), "line")


def scan_windows(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Notices in the words of the whole text, across line ends and inside sentences: ``doc_id, license,
    dice, first, last`` (numbers of bigrams, from 0).

    Every run of words counts that is at most ``(2 - t) / t`` times as long as its template (longer ones cannot
    reach ``t`` unless they repeat themselves).  The best run of a template begins and ends with one of its
    bigrams, so only those are scored.  Of matches that overlap, the one with the largest coefficient
    stays (ties: the longer, then the name that sorts first).  Rows with a null doc_id are left out.
    """
    grams = template_bigrams(templates)
    needs = [int(-(-threshold * len(g) // (2 - threshold))) for _, g in grams]
    # a match lacks at most size - need bigrams, so one of any size - need + 1 stands in the text
    seeds = sorted({x for (_, g), need in zip(grams, needs) for x in sorted(g, key=lambda x: (-len(x), x))[: len(g) - need + 1]})
    known = sorted({x for _, g in grams for x in g})
    lengths = [len(template_words(text)) - 1 for _, text in templates]
    literal = F.array(*[
        F.struct(F.lit(name).alias("license"), F.array(*[F.lit(x) for x in g]).alias("grams"), F.lit(need).alias("need"), F.lit(int(n * (2 - threshold) / threshold)).alias("most"))
        for (name, g), need, n in zip(grams, needs, lengths)
    ])
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.explode(F.array(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), _OTHER, " ")), F.lit(" ")))).alias("norm"))
    rows = rows.where(F.col("norm").rlike(f" (?:{'|'.join(seeds)}) "))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(F.split(F.trim("norm"), " "))).alias("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    rows = rows.select("row", "doc_id", F.explode(F.array(pairs)).alias("grams"))
    rows = rows.select("row", "doc_id", "grams", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.get("grams", i).isin(known)))).alias("hits"))
    rows = rows.select("row", "doc_id", "grams", "hits", F.explode(literal).alias("t"))
    rows = rows.select("row", "doc_id", "grams", "t", F.explode(F.array(F.filter("hits", lambda i: F.array_contains(F.col("t.grams"), F.get("grams", i))))).alias("mine")).where(F.size("mine") >= F.col("t.need"))
    fits = F.filter(F.sequence(F.lit(0), F.size("mine") - F.col("t.need")), lambda k: F.get("mine", k + F.col("t.need") - 1) - F.get("mine", k) < F.col("t.most"))
    rows = rows.select("row", "doc_id", "grams", "t", "mine", F.explode(fits).alias("k"))
    first = F.get("mine", F.col("k"))
    ends = F.filter(F.slice("mine", F.col("k") + F.col("t.need"), F.col("t.most")), lambda p: p - first < F.col("t.most"))
    rows = rows.select("row", "doc_id", "t", first.alias("first"), F.slice("grams", first + 1, F.col("t.most")).alias("part"), F.transform(ends, lambda p: p - first + 1).alias("sizes"))
    rows = rows.select("row", "doc_id", "t", "first", "part", F.explode("sizes").alias("size"))
    rows = rows.select("row", "doc_id", "t", "first", "size", F.explode(F.array(F.array_distinct(F.slice("part", 1, F.col("size"))))).alias("own"))
    a, b = F.size("own"), F.size("t.grams")
    rows = rows.where(F.lit(threshold) * (a + b) <= 2 * F.least(a, b))
    rows = rows.select("row", "doc_id", F.col("t.license").alias("license"), "first", "size", F.explode(F.array(2.0 * F.size(F.array_intersect("own", "t.grams")) / (a + b))).alias("dice")).where(F.col("dice") >= threshold)
    # the best of each first bigram, then the best of those that overlap
    best = rows.groupBy("row", "doc_id", "license", "first").agg(F.min(F.struct((-F.col("dice")).alias("less"), (-F.col("size")).alias("shorter"))).alias("m"))
    one = F.struct(F.col("m.less").alias("less"), F.col("m.shorter").alias("shorter"), "license", "first", (F.col("first") - F.col("m.shorter") - 1).alias("last"))
    kind = "array<struct<less:double,shorter:int,license:string,first:int,last:int>>"

    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(x)))

    kept = best.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(one)).cast(kind).alias("all"))
    kept = kept.select("doc_id", F.explode(F.aggregate("all", F.array().cast(kind), add)).alias("m"))
    return kept.select("doc_id", "m.license", (-F.col("m.less")).alias("dice"), "m.first", "m.last")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id, n_lines`` (that match as a whole), ``licenses`` (of lines and of
    windows, so also of wrapped notices and of grants inside a line; distinct, sorted, comma-joined;
    empty where there is none) and ``best`` (largest coefficient of both, else 0).

    Rows with a null doc_id come back without matches; rows of one doc_id share theirs.
    """
    both = scan_lines(docs, templates, threshold).select("doc_id", "license", "dice", F.lit(1).alias("line")).unionByName(scan_windows(docs, templates, threshold).select("doc_id", "license", "dice", F.lit(0).alias("line")))
    found = both.groupBy("doc_id").agg(F.sum("line").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.max("dice").alias("top"))
    ids = docs.select(F.col("doc_id").cast("long"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("names", F.lit("")).alias("licenses"), F.coalesce("top", F.lit(0.0)).alias("best"))


def oracle(templates=TEMPLATES, threshold: float = 0.8) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, g))}])" for n, g in template_bigrams(templates))
    return f"""
    WITH templates(license, grams) AS (VALUES {rows}),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    cut AS (SELECT row_number() OVER () AS k, doc_id, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM lines),
    grams AS (SELECT k, doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM cut WHERE len(w) > 1),
    scored AS (SELECT k, doc_id, license, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice FROM grams JOIN templates t ON {threshold} * (len(g) + len(t.grams)) <= 2 * least(len(g), len(t.grams))),
    best AS (SELECT k, doc_id, license, dice FROM scored WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, license) = 1),
    found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(dice) AS top FROM best GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(names, '') AS licenses, coalesce(top, 0.0)::DOUBLE AS best FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
    """
