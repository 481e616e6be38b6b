"""Totals over monthly tables: by month, overall, per source, and schema-driven."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.numbers import hours, is_numeric
from tallywell.functions.periods import month_literal, month_start, since_month
from tallywell.sources.tables import stack, tag


Labelled = Mapping[str, DataFrame] | DataFrame


def labelled(sources: Labelled, columns: Sequence[str]) -> DataFrame:
    """All sources as one frame of ``source``, month and ``columns``: a frame per source, or one that
    holds them all with a ``source`` column (and is read once)."""
    if isinstance(sources, DataFrame):
        return sources.select("source", month_start(sources).alias("month"), *columns)
    return stack(
        tag(df.select(month_start(df).alias("month"), *columns), label) for label, df in sources.items()
    )


def _sum_of(label: str, column: str) -> Column:
    return F.sum(F.when(F.col("source") == label, F.col(column)))


def full_join_on(frames: Iterable[DataFrame], key: str) -> DataFrame:
    """Full outer join of any number of frames on one shared key column."""
    return reduce(lambda left, right: left.join(right, key, "full"), frames)


SOURCES = ("audio", "video", "livestream")


def recording_totals_by_month(
    sources: Labelled, since: str | date, names: Sequence[str] = SOURCES
) -> DataFrame:
    """Tracks and seconds of every source per month, 0 where a source has no month.

    Equals the full outer join of one aggregate per source; stacking the sources
    and summing conditionally needs a single shuffle of partial sums.
    """
    names = names if isinstance(sources, DataFrame) else list(sources)
    rows = labelled(sources, ["num_tracks", "total_duration_sec"])
    zero_tracks, zero_seconds = F.lit(0).cast("bigint"), F.lit(0.0)
    return (
        rows.filter(since_month(F.col("month"), since))
        .groupBy("month")
        .agg(
            *[F.coalesce(_sum_of(s, "num_tracks"), zero_tracks).alias(f"{s}_tracks") for s in names],
            *[
                F.coalesce(_sum_of(s, "total_duration_sec"), zero_seconds).alias(f"{s}_duration_sec")
                for s in names
            ],
        )
        .orderBy("month")
    )


def recording_grand_totals(sources: Labelled, names: Sequence[str] = SOURCES) -> DataFrame:
    """One row: total tracks and hours of every source."""
    names = names if isinstance(sources, DataFrame) else list(sources)
    rows = labelled(sources, ["num_tracks", "total_duration_sec"])
    return rows.agg(
        *[_sum_of(s, "num_tracks").alias(f"{s}_tracks") for s in names],
        *[hours(_sum_of(s, "total_duration_sec")).alias(f"{s}_hours") for s in names],
    )


def recording_lookup_by_source(sources: Labelled, month: str | date, country: str) -> DataFrame:
    """One month and country, a row per source that has it."""
    rows = labelled(sources, ["country", "num_tracks", "total_duration_sec"])
    return (
        rows.filter((F.col("month") == month_literal(month)) & (F.col("country") == country))
        .select("source", "country", "month", "num_tracks", "total_duration_sec")
        .orderBy("source")
    )


def three_source_vs_reference_delta(
    sources: Mapping[str, tuple[DataFrame, str]] | tuple[DataFrame, str],
    reference: DataFrame,
    reference_columns: Mapping[str, str],
    since: str | date,
) -> DataFrame:
    """Per month and label: value from its own table, value from the reference, delta.

    ``sources`` gives each label its table and value column, or one table with a ``source`` column
    and its value column; ``reference_columns`` the matching column of ``reference``. Months come from
    the sources (missing values 0); a month the reference lacks leaves its value
    and the delta NULL.
    """
    if isinstance(sources, tuple):
        table, value = sources
        sources = dict.fromkeys(reference_columns)
        own = labelled(table, [value]).groupBy("month").agg(
            *[_sum_of(label, value).alias(f"{label}_from_sources") for label in sources]
        )
    else:
        own = full_join_on(
            (
                df.groupBy(month_start(df).alias("month")).agg(F.sum(column).alias(f"{label}_from_sources"))
                for label, (df, column) in sources.items()
            ),
            "month",
        )
    own = own.fillna(0, [f"{label}_from_sources" for label in sources])
    theirs = reference.groupBy(month_start(reference).alias("month")).agg(
        *[F.sum(reference_columns[label]).alias(f"{label}_from_reference") for label in sources]
    )
    joined = own.filter(since_month(F.col("month"), since)).join(theirs, "month", "left")
    columns = []
    for label in sources:
        ours, other = F.col(f"{label}_from_sources"), F.col(f"{label}_from_reference")
        columns += [ours, other, (ours - other).alias(f"{label}_delta")]
    return joined.select("month", *columns).orderBy("month")


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns other than the month, in schema order, or those asked for."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f) and f.name != "month"]
    if unknown := set(columns or ()) - set(df.columns):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return numeric if columns is None else [c for c in numeric if c in columns]


def numeric_totals_by_month(
    tables: Labelled,
    start: str | date,
    end: str | date,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """SUM of every numeric column per table and month, both ends inclusive.

    Tables without a numeric column are left out. Sums of means or medians carry
    no meaning; ``columns`` picks the ones that do.
    """
    if isinstance(tables, DataFrame):
        wanted = numeric_columns(tables, columns)
        month = month_start(tables)
        return (
            tables.filter(month.between(month_literal(start), month_literal(end)))
            .groupBy("source", F.date_format(month, "yyyy-MM").alias("month"))
            .agg(*[F.sum(c).alias(c) for c in wanted])
            .orderBy("source", "month")
        )
    parts = []
    for label, df in tables.items():
        wanted = numeric_columns(df, columns)
        if not wanted:
            continue
        month = month_start(df)
        summed = (
            df.filter(month.between(month_literal(start), month_literal(end)))
            .groupBy(F.date_format(month, "yyyy-MM").alias("month"))
            .agg(*[F.sum(c).alias(c) for c in wanted])
        )
        parts.append(tag(summed, label))
    return stack(parts, allow_missing=True).orderBy("source", "month")


def numeric_grand_totals(tables: Labelled, columns: Sequence[str] | None = None) -> DataFrame:
    """SUM of every numeric column per table over all months; tables without one are left out."""
    if isinstance(tables, DataFrame):
        wanted = numeric_columns(tables, columns)
        return tables.groupBy("source").agg(*[F.sum(c).alias(c) for c in wanted]).orderBy("source")
    wanted = {label: numeric_columns(df, columns) for label, df in tables.items()}
    return stack(
        (
            tag(tables[label].agg(*[F.sum(c).alias(c) for c in names]), label)
            for label, names in wanted.items()
            if names
        ),
        allow_missing=True,
    ).orderBy("source")


# The count column a trend prefers, first match wins.
COUNT_COLUMNS = ("num_tracks", "num_exports", "num_imports", "total_tracks")


def preferred_column(df: DataFrame, prefer: Sequence[str] = COUNT_COLUMNS) -> str | None:
    """First preferred numeric column, else the first numeric one, else none."""
    numeric = numeric_columns(df)
    return next((c for c in prefer if c in numeric), numeric[0] if numeric else None)


def six_source_trend(
    tables: Labelled,
    start: str | date,
    end: str | date,
    prefer: Sequence[str] = COUNT_COLUMNS,
    names: Sequence[str] = (),
) -> DataFrame:
    """Month by source, the preferred count of each table, 0 where missing. A single labelled table
    has NULL in the columns that a source lacks; ``names`` are its sources."""
    if isinstance(tables, DataFrame):
        month = month_start(tables)
        rows = tables.filter(month.between(month_literal(start), month_literal(end))).select(
            "source",
            F.date_format(month, "yyyy-MM").alias("month"),
            F.coalesce(*[c for c in prefer if c in tables.columns]).alias("val"),
        )
        zero = F.lit(0).cast(rows.schema["val"].dataType)
        return (
            rows.groupBy("month").agg(*[F.coalesce(_sum_of(n, "val"), zero).alias(n) for n in names]).orderBy("month")
        )
    parts = []
    for label, df in tables.items():
        column = preferred_column(df, prefer)
        if column is None:
            continue
        month = month_start(df)
        parts.append(
            tag(
                df.filter(month.between(month_literal(start), month_literal(end))).select(
                    F.date_format(month, "yyyy-MM").alias("month"), F.col(column).alias("val")
                ),
                label,
            )
        )
    rows = stack(parts)
    zero = F.lit(0).cast(rows.schema["val"].dataType)
    return (
        rows.groupBy("month")
        .agg(*[F.coalesce(_sum_of(label, "val"), zero).alias(label) for label in tables])
        .orderBy("month")
    )


def top_countries(recordings: DataFrame, month: str | date, k: int = 5) -> DataFrame:
    """The ``k`` countries with most tracks in a month (ties by name)."""
    return (
        recordings.filter(month_start(recordings) == month_literal(month))
        .orderBy(F.col("num_tracks").desc(), F.col("country"))
        .limit(k)
        .select(
            "month", "country", "num_tracks",
            "mean_duration_sec", "median_duration_sec", "total_duration_sec",
        )
    )


def ordered_sample(
    rows: DataFrame, order: Sequence[str] = ("month", "country"), n: int = 10
) -> DataFrame:
    """First ``n`` rows in the given order."""
    return rows.orderBy(*order).limit(n)


def sample_facts(df: DataFrame, n: int) -> DataFrame:
    """``(rows, columns, complete)`` of any ``n`` rows: what can be said of a bare limit whichever rows it took.

    ``complete`` counts the rows without a NULL. The limit stands right above the scan, so reading
    stops with the first rows.
    """
    taken = sample(df, n)
    complete = reduce(and_, [F.col(f"`{c}`").isNotNull() for c in df.columns])
    return taken.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_if(complete).alias("complete"),
    )


def sample(rows: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows."""
    return rows.limit(n)
