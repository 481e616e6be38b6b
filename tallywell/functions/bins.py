"""Fixed-edge bins as integer ordinals.

Rows are grouped by a small integer, never by the label, so the aggregation
key stays cheap and the report order survives (labels do not sort). Labels are
attached after aggregation, when at most one row per bin is left.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_ORDINAL = 99  # sort position of a label no bin carries


@dataclass(frozen=True)
class BinSpec:
    """Half-open bins ``[lower[i], lower[i + 1])``; the lower edge belongs to the bin.

    ``upper=None`` leaves the last bin open and makes the bins total: anything
    not below an inner edge, NULL and NaN included, lands in the last bin and
    values under the first edge land in the first. With ``upper`` set, values
    outside ``[lower[0], upper)`` belong to no bin. ``null_label`` gives NULL
    and NaN a bin of their own.
    """

    labels: tuple[str, ...]
    lower: tuple[float, ...]
    upper: float | None = None
    null_label: str | None = None

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.lower):
            raise ValueError("one label per lower edge is needed")
        edges = [*self.lower] + ([] if self.upper is None else [self.upper])
        if any(a >= b for a, b in zip(edges, edges[1:])):
            raise ValueError("bin edges must increase")

    @property
    def all_labels(self) -> tuple[str, ...]:
        return self.labels + (() if self.null_label is None else (self.null_label,))

    @property
    def ordinals(self) -> range:
        return range(1, len(self.all_labels) + 1)

    def with_null_bin(self, label: str) -> BinSpec:
        return replace(self, null_label=label)

    def ordinal(self, value: Column) -> Column:
        """1-based bin number of ``value`` (NULL where a bounded spec has no bin)."""
        last = len(self.labels)
        # When branches are tried in order, so each test only needs its upper edge.
        branches: list[tuple[Column, Column]] = []
        if self.null_label is not None:
            branches.append((value.isNull() | F.isnan(value), F.lit(last + 1)))
        if self.upper is not None:
            outside = value.isNull() | F.isnan(value) | (value < float(self.lower[0]))
            branches.append((outside | (value >= float(self.upper)), F.lit(None).cast("int")))
        branches += [
            (value < float(edge), F.lit(i)) for i, edge in enumerate(self.lower[1:], start=1)
        ]
        if not branches:
            return F.lit(last)
        (test, number), *rest = branches
        chain = F.when(test, number)
        for test, number in rest:
            chain = chain.when(test, number)
        return chain.otherwise(F.lit(last))

    def label(self, ordinal: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.all_labels]), ordinal)

    def ordinal_of_label(self, label: Column) -> Column:
        """Report position of a label; labels outside the spec sort last."""
        position = F.array_position(F.array(*[F.lit(x) for x in self.all_labels]), label)
        known = position.isNotNull() & (position > 0)
        return F.when(known, position.cast("int")).otherwise(F.lit(UNKNOWN_ORDINAL))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(bin_ord, label, lo, hi)``, one row per bin."""
        highs = [*self.lower[1:], self.upper]
        rows = [
            (i, label, float(lo), None if hi is None else float(hi))
            for i, (label, lo, hi) in enumerate(zip(self.labels, self.lower, highs), start=1)
        ]
        if self.null_label is not None:
            rows.append((len(self.labels) + 1, self.null_label, None, None))
        return spark.createDataFrame(rows, "bin_ord int, label string, lo double, hi double")


# The duration bins of the report, in seconds.
DURATION_BINS = BinSpec(
    labels=(
        "0-1m", "1-5m", "5-10m", "10-15m", "15-20m", "20-25m",
        "25-30m", "0.5-1h", "1-8h", "8-24h", ">24h",
    ),
    lower=(0, 60, 300, 600, 900, 1200, 1500, 1800, 3600, 28800, 86400),
)

# The fine bins under one minute, in seconds.
FINE_BINS = BinSpec(
    labels=(
        "0-2s", "2-8s", "8-14s", "14-20s", "20-26s", "26-32s",
        "32-38s", "38-44s", "44-50s", "50-56s", "56-60s",
    ),
    lower=(0, 2, 8, 14, 20, 26, 32, 38, 44, 50, 56),
    upper=60,
)
