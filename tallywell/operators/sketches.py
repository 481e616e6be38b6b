"""Quantiles that roll up: a mergeable sketch per group, merged to any coarser grouping.

An exact median of a year can't be had from the medians of its months. A KLL sketch of each
month and country can be merged into one of the year, of a country, or of everything, without
going back to the recordings. A sketch holds some kilobytes whatever the size of its
group, is combined map-side, and answers any quantile with a bounded error of rank. NULL and
NaN are no values; count, minimum and maximum stay exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch; its size grows with it.
ACCURACY = 1024


def rank_error(accuracy: int = ACCURACY) -> float:
    """Error of rank, as a share of all values, that one quantile of a sketch exceeds in a hundredth of cases."""
    return 2.296 / accuracy**0.9021


def sketch_table(rows: DataFrame, keys: Sequence[str], value: str, accuracy: int = ACCURACY) -> DataFrame:
    """``(keys, n, lowest, highest, sketch)``: the table to keep."""
    number = F.col(value).cast("double")
    x = F.when(~F.isnan(number), number)
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.min(x).alias("lowest"),
        F.max(x).alias("highest"),
        F.kll_sketch_agg_double(x, F.lit(accuracy)).alias("sketch"),
    )


def rolled_up(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A sketch table of coarser groups from one of finer groups."""
    return table.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def levels(table: DataFrame, groupings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several roll-ups of one table as one: ``(level, keys, n, lowest, highest, sketch)``, NULL in the
    keys that a level leaves out."""
    names = list(dict.fromkeys(k for keys in groupings.values() for k in keys))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    parts = []
    for level, keys in groupings.items():
        found = rolled_up(table, keys)
        shown = [F.col(k) if k in keys else F.lit(None).cast(kinds[k]).alias(k) for k in names]
        parts.append(found.select(F.lit(level).alias("level"), *shown, "n", "lowest", "highest", "sketch"))
    return reduce(DataFrame.unionByName, parts)


def quantiles(table: DataFrame, wanted: Mapping[str, float]) -> DataFrame:
    """Replaces the sketch by the quantiles asked for; NULL where a group has no values."""
    return table.select(
        *[c for c in table.columns if c != "sketch"],
        *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(name) for name, q in wanted.items()],
    )


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def rank_check(
    rows: DataFrame,
    groupings: Mapping[str, Sequence[str]],
    value: str,
    estimates: DataFrame,
    quantile: str,
    q: float,
    bound: float,
) -> DataFrame:
    """``(level, keys, below, upto, within)``: shares of the recordings below the estimate and up to it, and
    whether the wanted rank lies between them but for ``bound``.

    One read of the recordings serves all levels: a row is doubled inside its task, once per level, and
    counted map-side against the estimates, which are as few as the groups.
    """
    names = list(dict.fromkeys(k for keys in groupings.values() for k in keys))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    entries = [
        F.struct(
            F.lit(level).alias("level"),
            *[(F.col(k) if k in keys else F.lit(None)).cast(kinds[k]).alias(k) for k in names],
        )
        for level, keys in groupings.items()
    ]
    number = F.col(value).cast("double")
    exploded = rows.filter(number.isNotNull() & ~F.isnan(number)).select(number.alias("_x"), F.inline(F.array(*entries)))
    goal = estimates.select(*[F.col(c).alias(f"_{c}") for c in ("level", *names)], F.col(quantile).alias("_estimate"))
    counted = exploded.join(goal, _same(["level", *names])).groupBy("level", *names).agg(
        (F.count_if(F.col("_x") < F.col("_estimate")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("_x") <= F.col("_estimate")) / F.count(F.lit(1))).alias("upto"),
    )
    return counted.withColumn("within", (F.col("below") <= q + bound) & (F.col("upto") >= q - bound))
