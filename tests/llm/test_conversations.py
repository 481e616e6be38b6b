"""Conversation repair: the lattice against a plain dynamic program, the query against SQL and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywell.llm import conversations, edit_lattice, queries
from tests.compare import connect, spark_rows, sql_rows

WORDS = ["Well.", "And then", "", " \t", "Why?", "no end", "Yes!  \n"]


def plain_repair(symbols: str) -> tuple[int, str]:
    """Suffix costs from the last row to the first, over the rules written out again."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best: dict) -> dict:
        best = dict(best)
        for _ in range(4):
            for state, role in turn.items():
                if role in best:
                    way = (best[role][0] + 5, "I" + best[role][1])
                    best[state] = min(best.get(state, way), way)
        return best

    best = inserted({"": (0, ""), "a": (0, "")})
    for symbol in reversed(symbols):
        now = {}
        for state in turn:
            ways = [(best[state][0] + 2, "D" + best[state][1])] if state in best else []
            if symbol != "D":
                extra, role = 5 * symbol.isupper(), symbol.lower()
                if (state == "" and role == "s") or role == turn[state]:
                    ways += [(best[role][0] + extra, "K" + best[role][1])] if role in best else []
                if turn[state] in best:
                    ways.append((best[turn[state]][0] + 1 + extra, "R" + best[turn[state]][1]))
            if ways:
                now[state] = min(ways)
        best = inserted(now)
    return best[""]


def test_lattice_finds_the_least_audit():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5] * 60 + [30, 90]:
        symbols = "".join(rng.choices("DsuaxSUAX", k=n))
        want = plain_repair(symbols)
        assert edit_lattice.repair(symbols) == want
        assert edit_lattice.repair(symbols, chunk=4) == want


def test_long_conversation_is_chained_from_chunks():
    symbols = "".join(random.Random(6).choices("DsuaxSUAX", k=3000))
    assert edit_lattice.repair(symbols) == plain_repair(symbols)


def plain(rows: list[tuple]) -> dict:
    """The whole report in plain Python."""
    damaged: dict = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    report = {}
    for conv, turns in damaged.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = plain_repair(symbols)
        lines, left, last = [], iter(turns), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{text}")
                last = role[:1]
        known = [t for t, *_ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        report[conv] = {
            "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            **counts,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return report


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    rows = [
        (conv, rng.choice([*range(12), None]), rng.choice(roles), rng.choice([*WORDS, None]))
        for conv in [*range(150), None]
        for _ in range(rng.randrange(1, 9))
    ]
    rows += [(900, k, ("user", "assistant")[k % 2], f"Turn {k // 3}.") for k in range(5000)]  # over several stretches
    rows += [(901, 3, "user", "again and again.")] * 3000  # copies of one row
    rows += [(902, k, "user", "x" * 300_000 + ".") for k in range(3)]
    return rows


def test_against_plain_python(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("place", "digest", "_n", "low", "stretch", "SYMBOLS"):
        table = table.withColumn(name, F.lit("extra"))
    got = {r["conv_id"]: r.asDict() for r in conversations.damage_and_repair(table).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert got[conv] == {"conv_id": conv} | row, conv


def test_empty_table_and_text_ids(spark):
    schema = "conv_id string, turn long, role string, text string"
    assert conversations.damage_and_repair(spark.createDataFrame([], schema)).collect() == []
    rows = [("b", 1, "user", "Hi."), ("b", 2, "assistant", "Ho."), ("a", None, "user", None)]
    got = {r["conv_id"]: r.asDict() for r in conversations.damage_and_repair(spark.createDataFrame(rows, schema)).collect()}
    assert {k: {"conv_id": k} | v for k, v in plain(rows).items()} == got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, size):
    folder = f"/root/testdata/{size}"
    df = queries.op12_conversation_repair(spark, folder)
    columns, want = sql_rows(connect(folder), queries.oracle_sql()["op12_conversation_repair"])
    assert sorted(df.columns) == sorted(columns)
    assert spark_rows(df) == want
