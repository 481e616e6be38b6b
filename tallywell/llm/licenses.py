"""Licence notices in documents: Dice coefficient over word bigrams, in built-in functions only.

Text is normalised (lower case, runs of anything but letters and digits become one space) and
compared with the templates as a whole, by paragraph, by line and by sentence, and by windows of
consecutive words wherever they start and end, so that a notice is found when it is wrapped over
lines, stands in a comment or inside other prose. The best window starts and ends with a bigram of the
template, as cutting any other bigram off lowers no coefficient; a window holds at most (2-t)/t times as
many bigrams as the template, repetitions included. With t the least
coefficient, a template of m distinct bigrams can only match a unit of m*t/(2-t) to m*(2-t)/t of
them; these size bounds prune the candidate templates, and a match shares at least m*t/(2-t) of the
template's bigrams. So a document that holds none of a few words of each template, chosen such
that too few bigrams are left without them, needs no further look; that prune loses nothing.

Versions and variants of one text differ in a word or two, so their coefficients are high for each
other. Where a licence has marks (``MARKS``), a template that holds them matches only what
holds them too: "version 2" is no match for the template of version 3, however like the rest is.

Defined cases: null and empty texts match nothing; a template needs two words at least. Rows of
one id are reported together. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import stored

LEAST_DICE = 0.8

# Notices of well-known licences, as their publishers word them.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
]

# What tells licences of nearly the same wording apart.
MARKS = {
    "GPL-2.0": ("gnu general", "version 2"),
    "GPL-3.0": ("gnu general", "version 3"),
    "AGPL-3.0": ("gnu affero", "version 3"),
    "LGPL-2.1": ("gnu lesser", "version 2"),
    "LGPL-3.0": ("gnu lesser", "version 3"),
    "CC-BY-4.0": ("attribution 4", "by 4"),
    "CC-BY-SA-4.0": ("sharealike 4", "sa 4"),
    "CC-BY-NC-4.0": ("nc 4",),
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def marks_of(name: str, body: str) -> list[str]:
    """The bigrams of the template that a match must have."""
    own = bigrams_of(normal_words(body))
    return [mark for mark in MARKS.get(name, ()) if mark in own]


def required_words(body: str, least: float) -> tuple[list[str], int]:
    """The template's longest words, as many as leave fewer bigrams without them than a match must share: every
    match holds one of them. And how many of the template's words a match holds at least: n shared bigrams of
    a template without repeated words touch n + 1 words or more; otherwise as many words as begin n of its bigrams
    together, those that begin most of them taken first."""
    words = normal_words(body)
    rest = bigrams_of(words)
    needed = math.ceil(len(rest) * least / (2 - least) - 1e-9)
    begun = sorted(Counter(b.split()[0] for b in rest).values(), reverse=True)
    held = needed + 1
    if len(set(words)) < len(words):
        held = next(v for v in range(1, len(begun) + 1) if sum(begun[:v]) >= needed)
    some: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(rest) < needed:
            break
        some.append(word)
        rest = {b for b in rest if word not in b.split()}
    return some, held


def may_match(text: str, templates: list[tuple[str, str]], least: float) -> list[str]:
    """Per template an SQL condition, false only for texts without a match: plain substring tests on the lower-cased
    text that the name ``text`` stands for."""
    tests = []
    for _, body in templates:
        some, held = required_words(body, least)
        test = " OR ".join(f"contains({text}, '{w}')" for w in some)
        if held > 1:
            found = " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in dict.fromkeys(normal_words(body)))
            test = f"({test}) AND {found} >= {held}"
        tests.append(f"({test})")
    return tests


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, level, unit, times)``: the normalised units of each document, each once per level."""
    text = F.col("text")
    by_level = {
        "document": F.array(text),
        "paragraph": F.split(text, r"\n\s*\n"),
        "line": F.split(text, "\n"),
        "sentence": F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"),
    }
    levels = F.array(*[F.struct(F.lit(k).alias("level"), v.alias("units")) for k, v in by_level.items()])
    return (
        docs.select("doc_id", F.explode(levels).alias("of"))
        .select("doc_id", "of.level", F.explode("of.units").alias("unit"))
        .select("doc_id", "level", normalised(F.col("unit")).alias("unit"))
        .filter(F.instr("unit", " ") > 0)
        .groupBy("doc_id", "level", "unit")
        .agg(F.count("*").alias("times"))
    )


def bigrams_in_order(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1),
        F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def bigrams(unit: Column) -> Column:
    return F.array_distinct(bigrams_in_order(unit))


def best_window(grams: Column, own: Column, marks: Column, low: Column, span: Column) -> Column:
    """The greatest coefficient of a window of ``grams`` with the bigrams ``own``; null if no window of up to
    ``span`` bigrams has ``low`` of them and all ``marks``."""

    def dice(start: Column, end: Column) -> Column:
        window = F.slice(grams, start, end - start + 1)
        found = 2.0 * F.size(F.array_intersect(window, own)) / (F.size(own) + F.size(F.array_distinct(window)))
        return F.when(F.size(F.array_except(marks, window)) == 0, found)

    def best(hits: Column) -> Column:
        return F.array_max(
            F.flatten(
                F.transform(
                    hits,
                    lambda start, i: F.transform(
                        # places increase, so the window's other hits are among the next ``span``
                        F.filter(F.slice(hits, i + low, span), lambda end: end < start + span),
                        lambda end: dice(start, end),
                    ),
                )
            )
        )

    places = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(own, F.element_at(grams, p)))
    # bound as the only element of an array, so that it is computed once
    return F.element_at(F.transform(F.array(places), best), 1)


def windows(likely: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``(doc_id, license, dice)`` of the best window per document and licence, of ``likely (doc_id, text, tried)``
    with the numbers of the templates to try."""
    rows = []
    for number, (name, body) in enumerate(templates):
        words = normal_words(body)
        own = sorted(bigrams_of(words))
        low = math.ceil(len(own) * least / (2 - least) - 1e-9)
        rows.append((number, name, own, marks_of(name, body), low, math.floor((len(words) - 1) * (2 - least) / least + 1e-9)))
    # bounded by the templates, whatever the data
    known = F.broadcast(
        likely.sparkSession.createDataFrame(rows, "template int, license string, own array<string>, marks array<string>, low int, span int")
    )
    texts = likely.withColumn("unit", normalised(F.col("text"))).filter(F.instr("unit", " ") > 0)
    tried = texts.select("doc_id", bigrams_in_order(F.col("unit")).alias("grams"), F.explode("tried").alias("template"))
    return (
        tried.join(known, "template")
        .filter((F.size(F.array_intersect("grams", "own")) >= F.col("low")) & (F.size(F.array_except("marks", "grams")) == 0))
        .select("doc_id", "license", best_window(*map(F.col, ("grams", "own", "marks", "low", "span"))).alias("dice"))
        .groupBy("doc_id", "license")
        .agg(F.max("dice").alias("dice"))
        .filter(F.col("dice") >= least - 1e-12)
    )


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE
) -> DataFrame:
    """``(doc_id, license, dice, level, n_lines)``, a row per document and licence found: the best coefficient, the
    finest level that reaches it ("window" if no unit does), and in how many lines the licence stands."""
    spark = docs.sparkSession
    # bound as the only element of an array, so that a text is lowered once
    tests = may_match("t", templates, least)
    some = F.expr(f"exists(array(lower(text)), t -> {' OR '.join(tests)})")
    numbers = ", ".join(f"CASE WHEN {test} THEN {number} END" for number, test in enumerate(tests))
    tried = F.expr(f"transform(array(lower(text)), t -> array_compact(array({numbers})))[0]")
    # written, as both ways of looking at the few likely texts start here
    likely = stored(docs.select("doc_id", "text").filter(some).withColumn("tried", tried), "likely")
    rows = []
    for number, (name, body) in enumerate(templates):
        own = bigrams_of(normal_words(body))
        low = math.ceil(len(own) * least / (2 - least) - 1e-9)
        high = math.floor(len(own) * (2 - least) / least + 1e-9)
        marks = marks_of(name, body)
        rows += [(number, name, b, len(own), low, high, b in marks, len(marks)) for b in sorted(own)]
    # bounded by the templates, whatever the data
    known = F.broadcast(
        spark.createDataFrame(rows, "template int, license string, bigram string, m int, low int, high int, mark boolean, marks int")
    )
    found = units(likely.select("doc_id", "text")).withColumn("bigrams", bigrams(F.col("unit"))).withColumn("u", F.size("bigrams"))
    shared = (
        found.select("doc_id", "level", "unit", "times", "u", F.explode("bigrams").alias("bigram"))
        .join(known, "bigram")
        .filter(F.col("u").between(F.col("low"), F.col("high")))
        .groupBy("doc_id", "level", "unit", "times", "u", "template", "license", "m", "marks")
        .agg(F.count("*").alias("c"), F.count_if("mark").alias("marked"))
        .filter("marked = marks")
        .withColumn("dice", 2.0 * F.col("c") / (F.col("m") + F.col("u")))
        .filter(F.col("dice") >= least - 1e-12)
    )
    # several templates stand for one licence: a line counts once
    best = shared.groupBy("doc_id", "level", "unit", "times", "license").agg(F.max("dice").alias("dice"))
    fine = F.when(F.col("level") == "sentence", 3).when(F.col("level") == "line", 2)
    fine = fine.when(F.col("level") == "paragraph", 1).when(F.col("level") == "document", 0).otherwise(-1)
    inside = windows(likely, templates, least).select(
        "doc_id", F.lit("window").alias("level"), F.lit("").alias("unit"), F.lit(0).cast("long").alias("times"), "license", "dice"
    )
    top = F.max(F.struct("dice", fine.alias("fine"), "level"))
    return (
        best.union(inside)
        .groupBy("doc_id", "license")
        .agg(top.alias("top"), F.sum(F.when(F.col("level") == "line", F.col("times")).otherwise(0)).alias("n_lines"))
        .select("doc_id", "license", F.col("top.dice").alias("dice"), F.col("top.level").alias("level"), "n_lines")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The same result as DuckDB SQL, by comparing every unit with every template that shares a bigram."""
    values = ",\n    ".join(
        f"({k}, {_quoted(n)}, {_quoted(b)}, [{', '.join(map(_quoted, marks_of(n, b)))}]::VARCHAR[])"
        for k, (n, b) in enumerate(templates)
    )
    return rf"""
WITH templates(template, license, body, marks) AS (
  VALUES
    {values}
), cut AS (
  SELECT doc_id, 'document' AS level, 0 AS fine, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', 1, unnest(regexp_split_to_array(text, '\n\s*\n')) FROM documents
  UNION ALL
  SELECT doc_id, 'line', 2, unnest(string_split(text, chr(10))) FROM documents
  UNION ALL
  SELECT doc_id, 'sentence', 3,
         unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) FROM documents
), normal AS (
  SELECT doc_id, level, fine, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS unit FROM cut
), units AS (
  SELECT doc_id, level, fine, unit, count(*) AS times, string_split(unit, ' ') AS words
  FROM normal WHERE contains(unit, ' ') GROUP BY ALL
), grams AS (
  SELECT doc_id, level, fine, unit, times,
         list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
  FROM units
), template_words AS (
  SELECT template, license, marks,
         string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words
  FROM templates
), template_grams AS (
  SELECT template, license, marks,
         list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
  FROM template_words
), known AS (
  SELECT template, license, marks, len(bigrams) AS m, unnest(bigrams) AS bigram FROM template_grams
), shared AS (
  SELECT g.doc_id, g.level, g.fine, g.unit, g.times, k.license, k.template,
         2.0::DOUBLE * count(*) / (k.m + g.u) AS dice
  FROM (SELECT *, len(bigrams) AS u, unnest(bigrams) AS bigram FROM grams) g JOIN known k USING (bigram)
  GROUP BY g.doc_id, g.level, g.fine, g.unit, g.times, g.u, k.license, k.template, k.m, k.marks
  HAVING dice >= {least} - 1e-12 AND count(*) FILTER (WHERE list_contains(k.marks, k.bigram)) = len(k.marks)
), best AS (
  SELECT doc_id, level, fine, unit, times, license, max(dice) AS dice FROM shared GROUP BY ALL
)
SELECT doc_id, license, max(dice) AS dice, arg_max(level, dice * 1000 + fine) AS level,
       CAST(sum(CASE WHEN level = 'line' THEN times ELSE 0 END) AS BIGINT) AS n_lines
FROM best GROUP BY doc_id, license
"""
