"""Conversation structure repair: faults per conversation, cheapest edits, and the repaired text's digest.

The rows are brought in order once, by a range sort that also splits a conversation of any
length, and written. Everything up to the search is column work on that table's small
columns: faults, duplicates (first place of each role and text, combined before the
shuffle) and one symbol per row. Symbols meet per stretch of ``STRETCH`` places and then
per conversation, as one text with a letter per row: as long as the audit that the
conversation's result row holds anyway. ``edit_lattice`` finds the edits, once per distinct
symbol text in a worker. At last the rows stream past their conversation's audit in
order, and a running SHA-256 takes the repaired lines: a task holds a batch of rows,
never a conversation's texts.

Defined cases: null role and text are one space; null conv_id is a conversation of its own;
null turns come first and don't count for gaps; rows of one turn are ordered by role and
digest of the text; repeated rows are duplicates after the first; an empty text is blank; a
conversation without rows after damage has zeros, an empty audit and the digest of the
empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.cache import GenerationCache, held
from tallywell.llm.common import remove_stored, ship_package, stored
from tallywell.llm.edit_lattice import repair

WHITE = r"\x20\x09-\x0D"
#: Places per stretch, a power of two: symbols gathered in one step.
STRETCH_BITS = 11
EMPTY = hashlib.sha256(b"").hexdigest()


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that the row's checksum names."""
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = _filled("text")
    return (
        rows.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(_filled("role")).alias("role"),
            F.when(F.col("_kind") == 1, "")
            .when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with a ``place`` that grows along every conversation, and what their texts alone tell.

    The running number keeps equal rows apart, so that the range sort can split any number of them.
    """
    initial = F.substring("role", 1, 1)
    return (
        rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        .withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange("conv_id", "turn", "role", "digest", "_n")
        .sortWithinPartitions("conv_id", "turn", "role", "digest", "_n")
        .select(
            "conv_id",
            F.monotonically_increasing_id().alias("place"),
            "turn",
            "role",
            "text",
            "digest",
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"),
            (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("cut"),
        )
    )


def _joined(parts: Column, field: str) -> Column:
    return F.array_join(F.transform(parts, lambda x: x[field]), "")


def shapes(placed: DataFrame) -> DataFrame:
    """A row per conversation: symbols, gaps and the counts of faults."""
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"))
    known = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    duplicate = ~F.col("blank") & (F.col("place") > F.col("first"))
    cut = ~F.col("blank") & ~duplicate & F.col("cut")
    symbol = F.when(F.col("blank") | duplicate, "D").when(cut, F.upper("initial")).otherwise(F.col("initial"))
    stretches = (
        placed.join(known, same)
        .groupBy("conv_id", F.shiftright("place", STRETCH_BITS).alias("stretch"))
        .agg(
            F.sort_array(F.collect_list(F.struct("place", symbol.alias("symbol"), "initial"))).alias("rows"),
            F.min("turn").alias("low"),
            F.max("turn").alias("high"),
            F.size(F.collect_set("turn")).alias("turns"),
            F.count_if("blank").alias("blank"),
            F.count_if(duplicate).alias("duplicate"),
            F.count_if(cut).alias("truncated"),
        )
        .withColumn("symbols", _joined(F.col("rows"), "symbol"))
        .withColumn("initials", _joined(F.col("rows"), "initial"))
    )
    whole = stretches.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("stretch", "symbols", "initials", "low", "high"))).alias("parts"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("turns").alias("turns"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    # turns are in order: one that runs on into the next stretch was counted in both
    again = F.expr("size(filter(sequence(1, size(parts)), i -> i < size(parts) AND parts[i].low = parts[i - 1].high))")
    turns = F.col("turns") - again
    initials = _joined(F.col("parts"), "initials")
    legal = sum((F.regexp_count(F.col("initials"), F.lit(pair)) for pair in ("su", "ua", "au")), F.lit(0))
    return (
        whole.withColumn("initials", initials)
        .select(
            "conv_id",
            _joined(F.col("parts"), "symbols").alias("symbols"),
            F.coalesce(F.col("high") - F.col("low") + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            (F.length("initials") - 1 - legal).cast("long").alias("illegal"),
        )
    )


def with_repair(found: DataFrame) -> DataFrame:
    """Adds ``cost`` and ``audit`` of the cheapest edits of ``symbols``."""

    @F.pandas_udf("cost long, audit string")
    def solved(symbols: pd.Series) -> pd.DataFrame:
        cache = held("edit_lattice", lambda: GenerationCache(50_000))
        ways = []
        for text in symbols:
            way = cache.get(text)
            if way is None:
                way = repair(text)
                if len(text) <= 64:
                    cache.put(text, way)
            ways.append(way)
        return pd.DataFrame(ways, columns=["cost", "audit"])

    return found.withColumn("_way", solved("symbols")).select(*found.columns, "_way.cost", "_way.audit")


class _Rewriter:
    """Takes one conversation's rows in order and digests its repaired lines."""

    def __init__(self, conv_id: object, audit: str) -> None:
        self.conv_id, self.audit = conv_id, audit
        self.at, self.last, self.digest, self.lines = 0, "", hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        self.last = role[:1]

    def _turn(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._turn(), text)

    def result(self) -> tuple[object, str]:
        self.inserts()
        return self.conv_id, self.digest.hexdigest()


def repaired_digests(placed: DataFrame, repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: rows stream in order behind a row that carries the audit."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = placed.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("repaired_sha256", pa.string())])
    audits = repaired.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    lines = audits.unionByName(placed.select("conv_id", "place", "role", "text"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Rewriter | None = None
        for batch in batches:
            done = []
            for conv_id, place, role, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if place < 0:
                    if current is not None:
                        done.append(current.result())
                    current = _Rewriter(conv_id, text)
                else:
                    current.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*done), schema)], schema=schema)
        if current is not None:
            one = current.result()
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(one, schema)], schema=schema)

    return (
        lines.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
        .mapInArrow(rewrite, f"conv_id {kind.simpleString()}, repaired_sha256 string")
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation of ``rows (conv_id, turn, role, text)``."""
    ship_package(rows.sparkSession)
    placed = stored(ordered(rows), "turns")
    repaired = stored(with_repair(shapes(placed)).drop("symbols"), "repairs")
    digests = repaired_digests(placed, repaired).withColumnRenamed("conv_id", "_d")
    whole = stored(
        repaired.join(digests, F.col("conv_id").eqNullSafe(F.col("_d"))).drop("_d"), "conversations"
    )
    remove_stored(placed)
    remove_stored(repaired)
    return whole


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The report on every conversation of the table after ``damaged``; those that lost all rows have zeros."""
    found = repair_conversations(damaged(conversations)).withColumnRenamed("conv_id", "_c")
    every = conversations.select("conv_id").distinct()
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    missing = zeros | {"audit": F.lit(""), "repaired_sha256": F.lit(EMPTY)}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), value).alias(c) for c, value in missing.items()]
    )


def _plus(letter: str, cost: int, value: str) -> str:
    """SQL: a suffix text (nine digits of cost, then the audit) with one more edit in front."""
    return f"(lpad(CAST(CAST(left({value}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({value}, 10))"


def _with_inserts(values: list[str]) -> list[str]:
    """SQL: the best suffixes of the four states when rows may also be inserted first."""
    none, system, user, assistant = values
    first = f"least({user}, {_plus('I', 5, assistant)})"
    return [
        f"least({none}, {_plus('I', 5, first)})",
        f"least({system}, {_plus('I', 5, first)})",
        first,
        f"least({assistant}, {_plus('I', 5, user)})",
    ]


def _over_row() -> list[str]:
    """SQL: the best suffixes of the four states before a row whose symbol is ``symbol``."""
    states, turn = ["v0", "v1", "v2", "v3"], ["v2", "v2", "v3", "v2"]
    kept = [{"s": "v1", "u": "v2"}, {"u": "v2"}, {"a": "v3"}, {"u": "v2"}]
    before = []
    for q in range(4):
        extra = "CASE WHEN symbol = upper(symbol) THEN 5 ELSE 0 END"
        keeps = " ".join(f"WHEN '{k}' THEN {_plus('K', extra, v)}" for k, v in kept[q].items())
        before.append(
            f"least({_plus('D', 2, states[q])}, CASE WHEN symbol <> 'D' THEN least("
            f"{_plus('R', f'1 + {extra}', turn[q])}, CASE lower(symbol) {keeps} END) END)"
        )
    return before


SQL = rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM filled
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place,
         NOT regexp_matches(text, '[^{WHITE}]') AS blank,
         NOT regexp_matches(text, '[.!?][{WHITE}]*$') AS cut
  FROM damaged
), seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM placed
), marked AS (
  SELECT *, NOT blank AND NOT duplicate AND cut AS truncated,
         CASE WHEN blank OR duplicate THEN 'D' WHEN cut THEN upper(initial) ELSE initial END AS symbol
  FROM seen
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), search AS (
  SELECT conv_id, n AS place, {", ".join(f"{v} AS v{q}" for q, v in enumerate(_with_inserts(["'000000000'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "'000000000'"])))}
  FROM counted
  UNION ALL
  SELECT conv_id, place, {", ".join(f"{v} AS v{q}" for q, v in enumerate(_with_inserts(["b0", "b1", "b2", "b3"])))}
  FROM (SELECT s.conv_id, s.place - 1 AS place, {", ".join(f"{b} AS b{q}" for q, b in enumerate(_over_row()))}
        FROM search AS s JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.place = s.place) AS r
), best AS (
  SELECT conv_id, CAST(left(v0, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM search WHERE place = 0
), steps AS (
  SELECT conv_id, nr, audit[nr] AS edit, length(replace(left(audit, nr), 'I', '')) AS place,
         length(replace(left(audit, nr), 'D', '')) AS line
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS nr FROM best) AS b
), lines AS (
  SELECT s.conv_id, s.nr, s.edit, s.line, m.role, CASE WHEN s.edit = 'I' THEN '' ELSE m.text END AS text,
         coalesce(bool_or(s.edit = 'K' AND m.initial = 's') OVER (PARTITION BY s.conv_id), false) AS led
  FROM steps AS s LEFT JOIN marked AS m
    ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.place = s.place AND s.edit <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line % 2 = 1) <> led THEN 'user' ELSE 'assistant' END
                             || ':' || text, chr(10) ORDER BY nr) AS body
  FROM lines WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(k.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(k.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(k.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(k.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(k.illegal, 0) AS BIGINT) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted AS k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
