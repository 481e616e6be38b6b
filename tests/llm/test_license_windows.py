"""Notices that are wrapped over lines, stand in comments or inside prose."""

from __future__ import annotations

import textwrap

import pytest

from tallywell.llm import licenses

BODY = {name: body for name, body in licenses.TEMPLATES}
LONG = {name: max((b for n, b in licenses.TEMPLATES if n == name), key=len) for name in BODY}


def brute(text, templates, least=licenses.LEAST_DICE):
    """The best coefficient per licence over all windows of consecutive words."""
    words, found = licenses.normal_words(text), {}
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, body in templates:
        own = licenses.bigrams_of(licenses.normal_words(body))
        span = int((len(licenses.normal_words(body)) - 1) * (2 - least) / least + 1e-9)
        for i in range(len(grams)):
            for j in range(i + 1, min(i + span, len(grams)) + 1):
                part = set(grams[i:j])
                if not part.issuperset(licenses.marks_of(name, body)):
                    continue
                found[name] = max(found.get(name, 0.0), 2 * len(part & own) / (len(own) + len(part)))
    return {name: dice for name, dice in found.items() if dice >= least - 1e-12}


TEXTS = [
    "/*\n * Copyright 2020 Some One and many others\n *\n"
    + textwrap.indent(textwrap.fill(LONG["MIT"], 60), " * ")
    + "\n *\n * The above notice shall be included in all copies.\n */\nint main() { return 0; }\n",
    "// thing.c - does things\n" + textwrap.indent(textwrap.fill(LONG["GPL-3.0"], 60), "// ") + "\n// See the file COPYING.\nint x;",
    "Some prose goes before it here\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License.\nand goes on",
    "It was Licensed under CC BY 4.0, and later on it was changed by somebody else",
    "all all all rights rights reserved reserved of the software",
    "nothing of that kind is written here, by no one",
    "word",
]


def test_windows_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    want = {(k, name): dice for k, text in enumerate(TEXTS) for name, dice in brute(text, licenses.TEMPLATES).items()}
    assert {(0, "MIT"), (1, "GPL-3.0"), (2, "CC-BY-4.0"), (3, "CC-BY-4.0")} <= set(want)
    assert got == pytest.approx(want)


GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as " \
    "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
NAMED = {
    "GPL-2.0": GNU.format("program", ";", "General", ";", 2),
    "GPL-3.0": GNU.format("program", ":", "General", ",", 3),
    "AGPL-3.0": GNU.format("program", ":", "Affero General", ",", 3),
    "LGPL-2.1": GNU.format("library", ";", "Lesser General", ";", "2.1"),
    "LGPL-3.0": GNU.format("library", ":", "Lesser General", ",", 3),
}


def test_versions_are_told_apart(spark):
    docs = [(k, wrapped) for k, text in enumerate(NAMED.values()) for wrapped in (text, "/*\n" + textwrap.indent(textwrap.fill(text, 50), " * ") + "\n*/ int x;")]
    docs += [(9, "This work is licensed under the GNU General Public License, version 2.")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(k, name) for k, name in enumerate(NAMED)} | {(9, "GPL-2.0")}


def test_every_template_is_found_as_itself(spark):
    docs = spark.createDataFrame([(k, "Preamble of some words\n" + body + "\nand an end") for k, (_, body) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[k, name] == 1.0
        assert {n for i, n in got if i == k} == {name}


def test_a_text_of_many_notices_takes_time_in_proportion(spark):
    import time

    def seconds(times: int) -> float:
        docs = spark.createDataFrame([(1, (LONG["ISC"] + "\n") * times)], "doc_id long, text string")
        started = time.perf_counter()
        assert {(r["license"], r["n_lines"]) for r in licenses.scan(docs).collect()} == {("ISC", times)}
        return time.perf_counter() - started

    seconds(10)
    assert seconds(400) < 12 * max(seconds(100), 0.5)
