"""Exact, interpolated quantiles of groups of any size.

``F.percentile`` keeps every distinct value of a group in one task's memory. A
month of events can be most of the table, so that does not scale. Here the
wanted rank is located by counting:

1. cells of about 1/128 relative width over the whole double range,
2. the distinct values inside the one or two cells that hold the rank, counted once;
   2**21 equal cells over each of these find the finer cell of the rank, and the same
   counts, restricted to it, the value (at most 2**26 doubles to a finer cell).

The rows are read twice and combined map-side; only values inside located cells are
shuffled by value. No task ever sees a group's rows, only its cells. Several ranks, and several
sources labelled in the key, go through the same two reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_E_FOLD = 128  # some thousand cells per group: small hash tables, small shuffles
LEAST_LOG = -746.0  # below the logarithm of the smallest double
LARGEST_LOG = 710.0  # above that of the largest; infinity is put here
FINE_CELLS = 1 << 21


def _coarse_cell(x: Column) -> Column:
    """Order-preserving cell number; NaN sorts above everything, as in Spark. Cells are
    logarithmic on both sides of zero, which has its own."""
    log = F.least(F.ln(F.abs(x)), F.lit(LARGEST_LOG)) - F.lit(LEAST_LOG)
    size = F.floor(log * F.lit(CELLS_PER_E_FOLD)) + F.lit(1).cast("bigint")
    above_all = int(2 * (LARGEST_LOG - LEAST_LOG) * CELLS_PER_E_FOLD)
    return (
        F.when(F.isnan(x), F.lit(above_all).cast("bigint"))
        .when(x == 0, F.lit(0).cast("bigint"))
        .when(x < 0, -size)
        .otherwise(size)
    )


def _fine_cell(x: Column, lo: Column, hi: Column) -> Column:
    """Equal cells between the smallest and largest value seen in the coarse cell.

    Never NULL, and written so that the planner sees it: a test for NULL pushed into one of
    its two uses would part the exchange that they share."""
    part = F.try_divide(x - lo, hi - lo)
    return F.coalesce(F.when(lo < hi, F.floor(part * F.lit(FINE_CELLS))), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Rank:
    """A wanted quantile: interpolated between two values, or the first value that at least ``q`` of
    all do not exceed."""

    q: float
    interpolated: bool = True

    def position(self, n: Column) -> Column:
        """0-based position among ``n`` ordered values."""
        if self.interpolated:
            return F.lit(float(self.q)) * (n - 1)
        return F.greatest(F.ceil(F.lit(float(self.q)) * n) - 1, F.lit(0)).cast("double")

    def covered(self, before: Column, count: Column) -> Column:
        """Whether ranks ``[before, before + count)`` meet the two ranks around the position."""
        position = self.position(F.col("_n"))
        return (before + count > F.floor(position)) & (before <= F.ceil(position))


def _running_before(before: Column, partition: Sequence[str], order: str) -> Column:
    """Rank of the first value of a cell: ``before`` plus the counts of the earlier cells."""
    upto = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return before + F.sum("_count").over(upto) - F.col("_count")


def _same(keys: Sequence[str], prefix: str) -> list[Column]:
    """Null-safe, so NULL keys stay groups."""
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


# Moments of a whole group, as window aggregates over its coarse cells.
MOMENTS = {
    "rows": "sum(_rows)",
    "n": "sum(_count)",
    "total": "sum(_sum)",
    "lowest": "min(_lo)",
    "highest": "max(_hi)",
    "stddev": "sum(_spread)",
}


def distribution(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float = 0.5,
    moments: Sequence[str] = tuple(MOMENTS),
    sums: Mapping[str, Column] | None = None,
    quantile: str = "quantile",
    ranks: Mapping[str, Rank] | None = None,
) -> DataFrame:
    """Per group: the asked ``moments``, the ``sums`` and the exact quantile, or with ``ranks`` several by name.

    NULL values are no values, but their rows count in ``rows`` and ``sums``; a group
    without values has NULL statistics. ``sums`` are extra sum-able columns of ``rows``.
    Moments and sums come from the first step. ``stddev`` merges the cells' own
    spreads around their own means, so large offsets do not cancel it.
    """
    if "stddev" in moments and "n" not in moments:
        raise ValueError("stddev needs n")
    keys, extra = list(keys), dict(sums or {})
    wanted = dict(ranks) if ranks is not None else {quantile: Rank(q)}

    def covers_any(before: Column, count: Column) -> Column:
        return reduce(or_, [rank.covered(before, count) for rank in wanted.values()])

    x, count = F.col("_x"), F.col("_count")
    number = F.col(value).cast("double")
    base = rows.select(
        *keys,
        number.alias("_x"),
        _coarse_cell(number).alias("_coarse"),
        *[column.alias(name) for name, column in extra.items()],
    )

    # Step 1: coarse cells (NULL values have their own), carrying the moments of the group along.
    cells = base.groupBy(*keys, "_coarse").agg(
        F.expr("count(*) AS _rows"),
        F.expr("count(_x) AS _count"),
        F.expr("min(_x) AS _lo"),
        F.expr("max(_x) AS _hi"),
        F.expr("sum(_x) AS _sum"),
        *([F.expr("var_pop(_x) AS _var")] if "stddev" in moments else []),
        *[F.sum(name).alias(name) for name in extra],
    )
    group = Window.partitionBy(*keys)
    if "stddev" in moments:
        mean = F.sum("_sum").over(group) / F.nullif(F.sum("_count").over(group), F.lit(0))
        cells = cells.withColumn("_spread", count * (F.col("_var") + F.pow(F.col("_sum") / F.nullif(count, F.lit(0)) - mean, 2)))
    over_group = {m: F.expr(MOMENTS[m]) for m in moments} | {name: F.sum(name) for name in extra}
    carried = ["_n", *[f"_g_{name}" for name in over_group]]
    whole = cells.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_coarse").alias("_cell"),
        "_count", "_lo", "_hi",
        _running_before(F.lit(0), keys, "_coarse").alias("_before"),
        F.sum("_count").over(group).alias("_n"),
        *[agg.over(group).alias(f"_g_{name}") for name, agg in over_group.items()],
    )
    if "stddev" in moments:
        # here, below both uses, where "no values" can't be folded into it and part their exchanges
        degrees = F.col("_g_n") - 1
        whole = whole.withColumn("_g_stddev", F.when(degrees > 0, F.sqrt(F.col("_g_stddev") / degrees)))
    located = whole.filter(F.col("_cell").isNotNull() & covers_any(F.col("_before"), count)).drop("_count")
    # Implied by _n = 0; with the same columns in use, both share one exchange of the cells.
    without = whole.filter("_n = 0 AND _lo IS NULL AND _hi IS NULL")

    # Step 2: distinct values inside the located coarse cells. The coarse cell joins the key,
    # which spreads the rows of a large group. What is carried is the same for every row of a
    # coarse cell, so any aggregate keeps it.
    inside = [*_same(keys, "_k_"), F.col("_coarse") == F.col("_cell")]
    values = (
        base.select(*keys, "_x", "_coarse")
        .filter("_x IS NOT NULL")
        .join(located, reduce(and_, inside))
        .groupBy(*keys, "_cell", _fine_cell(x, F.col("_lo"), F.col("_hi")).alias("_fine"), "_x")
        .agg(F.expr("count(*) AS _count"), *[F.expr(f"max({c}) AS {c}") for c in ("_before", *carried)])
    )
    fine = (
        values.groupBy(*keys, "_cell", "_fine")
        .agg(F.expr("sum(_count) AS _count"), *[F.expr(f"max({c}) AS {c}") for c in ("_before", *carried)])
        .select(
            *[F.col(k).alias(f"_f_{k}") for k in keys],
            F.col("_cell").alias("_f_cell"),
            F.col("_fine").alias("_f_fine"),
            "_count", "_n",
            *[F.col(c).alias(f"_c{c}") for c in carried],
            _running_before(F.col("_before"), [*keys, "_cell"], "_fine").alias("_f_before"),
        )
        .filter(covers_any(F.col("_f_before"), count))
        .drop("_count", "_n")
    )

    # The ranks may lie far apart, so the values are counted on within each located cell.
    # Reading the carried columns on both sides (they agree) lets both share one exchange of values.
    first_rank = F.greatest("_f_before", "_before")
    finer = [*_same(keys, "_f_"), F.col("_cell") == F.col("_f_cell"), F.col("_fine") == F.col("_f_fine")]
    inner = (
        values.join(fine, reduce(and_, finer))
        .select(
            *keys, "_x", "_count",
            *[F.coalesce(c, f"_c{c}").alias(c) for c in carried],
            _running_before(first_rank, [*keys, "_cell", "_fine"], "_x").alias("_before"),
        )
        .filter(covers_any(F.col("_before"), count))
    )
    ends = []
    for i, rank in enumerate(wanted.values()):
        met = F.when(rank.covered(F.col("_before"), count), x)
        ends += [F.min(met).alias(f"_low{i}"), F.max(met).alias(f"_high{i}")]
    picked = inner.groupBy(*keys).agg(*ends, *[F.expr(f"max({c}) AS {c}") for c in carried])

    def value_at(i: int, rank: Rank) -> Column:
        low, high, position = F.col(f"_low{i}"), F.col(f"_high{i}"), rank.position(F.col("_n"))
        return F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))

    return picked.select(
        *keys,
        *[F.col(f"_g_{name}").alias(name) for name in over_group],
        *[value_at(i, rank).alias(name) for i, (name, rank) in enumerate(wanted.items())],
    ).unionByName(
        without.select(
            *[F.col(f"_k_{k}").alias(k) for k in keys],
            *[F.col(f"_g_{name}").alias(name) for name in over_group],
            *[F.lit(None).cast("double").alias(name) for name in wanted],
        )
    )


def exact_quantile(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float = 0.5,
    alias: str = "quantile",
) -> DataFrame:
    """``keys`` and the exact interpolated quantile of ``value`` per group that has values."""
    found = distribution(rows, keys, value, q, moments=(), quantile=alias)
    return found.filter(F.col(alias).isNotNull())
