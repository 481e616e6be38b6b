"""The registered queries: every report operator run over the driver tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.functions.bins import DURATION_BINS
from tallywell.functions.numbers import at_least
from tallywell.functions.periods import before, within
from tallywell.operators import durations, histograms, reconcile, sketches, sweeps, totals, users
from tallywell.plans import settings as S
from tallywell.sources import star, storage
from tallywell.sources.tables import read_table, stack, tag

Query = Callable[[SparkSession, str], DataFrame]
SOURCES = ("audio", "video", "livestream")

_queries: dict[str, Query] = {}


class ReportTables:
    """The report's tables over one scale-factor directory; nothing is read until used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        # Stored timestamps carry no zone and are read as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._shards: tuple[str, T.StructType] | None = None

    def table(self, name: str) -> DataFrame:
        """One DataFrame per table, so its footer is read once per query."""
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def events(self, source: str) -> DataFrame:
        return star.recording_events(self.table("events"), source)

    def view(self, source: str) -> DataFrame:
        return star.duration_view(self.table("events"), source)

    def raw(self) -> DataFrame:
        return star.raw_events(self.table("events"))

    def people(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.table("orders"), self.table("customer"), self.table("nation")

    # A month range given here prunes the scan.

    def monthly(self, source: str, start=None, end=None, median: bool = True) -> DataFrame:
        return star.recordings_monthly(*self.people(), source, start, end, median)

    def by_source(self, sources=SOURCES, start=None, end=None, median: bool = False) -> DataFrame:
        return star.recordings_by_source(*self.people(), sources, start, end, median)

    def events_beside_tables(self, source: str) -> DataFrame:
        orders, customer, nation = self.people()
        return star.events_beside_tables(self.table("events"), orders, customer, nation, source)

    def users(self, start=None, end=None) -> DataFrame:
        return star.active_users_monthly(*self.people(), start, end)

    def users_by_source(self) -> DataFrame:
        return star.active_users_by_source(*self.people())

    def transfers(self, start=None, end=None, tracks: bool = False) -> DataFrame:
        return star.transfers_by_source(self.table("lineitem"), start, end, tracks)


    def written_shards(self) -> tuple[str, T.StructType]:
        """The events in the layout of an export, one folder per day; once per query."""
        if self._shards is None:
            rows = star.located_events(self.table("events"), self.table("customer"), self.table("nation"))
            root = storage.work_path(self.spark, "events")
            storage.write_shards(rows, root, files_per_day=1 + self.table("events").count() // S.SHARD_ROWS)
            self._shards = root, rows.schema
        return self._shards

    def shards(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        return storage.read_day_shards(self.spark, *self.written_shards(), first_day, last_day)

    def shard_events(self, source: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        return self.shards(first_day, last_day).filter(F.col("source") == source).drop("source")


def portable(df: DataFrame, places: Mapping[str, int] | None = None, default: int = 6) -> DataFrame:
    """Result columns as two engines print them alike: rounded doubles, dates as text.

    Adding 0.0 turns a rounded -0.0 into 0.0. Only registered queries go through
    this; the operators return full precision.
    """
    places = places or {}

    def shown(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DoubleType):
            digits = places.get(field.name, default)
            return f"round({name} + {S.guard(digits)}, {digits}) + 0.0D AS {name}"
        if isinstance(field.dataType, T.DateType):
            return f"date_format({name}, 'yyyy-MM-dd') AS {name}"
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') AS {name}"
        return name

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


def query(places: Mapping[str, int] | None = None, default: int = 6, name: str | None = None):
    """Register ``build(tables)`` under its name."""

    def register(build: Callable[[ReportTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(ReportTables(spark, sf_dir)), places, default)

        run.__doc__ = build.__doc__
        _queries[name or build.__name__] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


# --- active users -----------------------------------------------------------------------


@query()
def active_users_from_events(t: ReportTables) -> DataFrame:
    return users.active_users_from_events(t.raw(), star.EVENT_TYPES, grain="MONTH")


@query()
def active_users_from_events_by_day(t: ReportTables) -> DataFrame:
    return users.active_users_from_events(t.raw(), star.EVENT_TYPES, grain="DAY")


@query()
def event_parameter_rows(t: ReportTables) -> DataFrame:
    """The unnested export, summarised per event name so that the result stays a report."""
    rows = users.event_parameters(t.raw(), "duration")
    return rows.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("parameters"),
        F.count("double_value").alias("typed_double"),
        F.count("string_value").alias("typed_string"),
        F.max("double_value").alias("largest_double"),
    )


@query()
def distinct_user_months(t: ReportTables) -> DataFrame:
    return users.distinct_users(t.raw(), star.EVENT_TYPES, grain="MONTH")


def _day_bitmaps(t: ReportTables) -> DataFrame:
    """The users of every day as bitmaps, kept as a table: later questions read it, not the events."""
    path = storage.work_path(t.spark, "user_bitmaps")
    users.user_bitmaps(t.raw(), star.EVENT_TYPES).write.parquet(path)
    return t.spark.read.parquet(path)


@query()
def active_users_from_bitmaps(t: ReportTables) -> DataFrame:
    return users.active_users_from_bitmaps(_day_bitmaps(t), "MONTH")


@query()
def active_users_of_range(t: ReportTables) -> DataFrame:
    """Distinct users of any range of days, which monthly counts can't give."""
    days = _day_bitmaps(t).filter(F.col("period").between(F.lit(S.FIRST_DAY).cast("date"), F.lit(S.AFTER_LAST_DAY).cast("date")))
    return users.active_users_from_bitmaps(days, None)


@query()
def active_users_by_month(t: ReportTables) -> DataFrame:
    return users.active_users_by_month(t.users(start=S.SINCE_DAY), S.SINCE)


@query()
def active_users_lookup(t: ReportTables) -> DataFrame:
    monthly = t.users(S.LOOKUP_MONTH, S.LOOKUP_NEXT)
    return users.active_users_lookup(monthly, S.LOOKUP_MONTH, S.LOOKUP_COUNTRY)


# --- totals -----------------------------------------------------------------------------


@query(default=2)
def recording_totals_by_month(t: ReportTables) -> DataFrame:
    return totals.recording_totals_by_month(t.by_source(start=S.SINCE_DAY), S.SINCE)


@query(default=4)
def recording_grand_totals(t: ReportTables) -> DataFrame:
    return totals.recording_grand_totals(t.by_source())


@query(default=2)
def recording_lookup_by_source(t: ReportTables) -> DataFrame:
    sources = t.by_source(start=S.LOOKUP_MONTH, end=S.LOOKUP_NEXT)
    return totals.recording_lookup_by_source(sources, S.LOOKUP_MONTH, S.LOOKUP_COUNTRY)


@query()
def three_source_vs_reference_delta(t: ReportTables) -> DataFrame:
    return totals.three_source_vs_reference_delta(
        (t.users_by_source(), "active_users"),
        t.users(),
        {s: f"active_{s}_users" for s in SOURCES},
        S.SINCE,
    )


@query(default=4)
def numeric_totals_by_month(t: ReportTables) -> DataFrame:
    tables = t.transfers(S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    return totals.numeric_totals_by_month(tables, S.FIRST_MONTH, S.LAST_MONTH)


@query(places={"stddev_duration_sec": 4}, default=5)
def numeric_totals_of_recordings(t: ReportTables) -> DataFrame:
    """Every numeric column of the recordings tables, means and medians included."""
    rows = t.by_source(("audio", "video"), S.FIRST_MONTH, S.AFTER_LAST_MONTH, median=True)
    tables = rows.withColumn("source", F.concat("source", F.lit("_recording")))
    return totals.numeric_totals_by_month(tables, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=2)
def numeric_grand_totals(t: ReportTables) -> DataFrame:
    return totals.numeric_grand_totals(t.transfers())


@query()
def six_source_trend(t: ReportTables) -> DataFrame:
    tables = t.transfers(S.FIRST_MONTH, S.AFTER_LAST_MONTH, tracks=True)
    names = [f"{s}_{kind}" for s in ("audio", "video") for kind in ("recording", "imports", "exports")]
    return totals.six_source_trend(tables, S.FIRST_MONTH, S.LAST_MONTH, names=names)


@query(default=4)
def top_countries(t: ReportTables) -> DataFrame:
    return totals.top_countries(t.monthly("video", S.LOOKUP_MONTH, S.LOOKUP_NEXT), S.LOOKUP_MONTH)


@query(default=4)
def ordered_sample(t: ReportTables) -> DataFrame:
    first = star.recordings_sample(*t.people(), "audio", n=10)
    return totals.ordered_sample(first)


@query()
def bare_limit(t: ReportTables) -> DataFrame:
    """Any rows will do: only what holds for all of them is reported."""
    return totals.sample_facts(t.table("events").select("event_id", "event_type", "value"), S.SAMPLE_ROWS)


@query(default=4)
def rewritten_day(t: ReportTables) -> DataFrame:
    """Totals by day and source, written once; one day is then replaced, twice, by what was known at the cutoff."""
    path = storage.work_path(t.spark, "day_totals")

    def day_totals(events: DataFrame) -> DataFrame:
        dated = storage.with_day(events)
        return dated.groupBy(storage.DAY_COLUMN, "source").agg(
            F.count(F.lit(1)).alias("events"), F.sum("duration_sec").alias("total_duration_sec")
        )

    events = star.recording_events_by_source(t.table("events"))
    totals_by_day = day_totals(events)
    storage.replace_partitions(totals_by_day, path, [storage.DAY_COLUMN])
    known = events.filter(within(events, "event_timestamp", S.REFINE_START, S.CUTOFF))
    for _ in range(2):
        storage.replace_partitions(day_totals(known), path, [storage.DAY_COLUMN])
    return t.spark.read.schema(totals_by_day.schema).parquet(path)


# --- durations --------------------------------------------------------------------------


@query(default=8)
def max_hours_by_month_agg(t: ReportTables) -> DataFrame:
    return durations.max_hours_by_month_agg(t.monthly("audio", median=False))


@query(default=8)
def max_hours_by_month_agg_filtered(t: ReportTables) -> DataFrame:
    monthly = t.monthly("video", S.FIRST_MONTH, S.AFTER_LAST_MONTH, median=False)
    return durations.max_hours_by_month_agg(monthly, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=8)
def max_hours_by_month_events(t: ReportTables) -> DataFrame:
    return durations.max_hours_by_month_events(t.events("audio"))


@query(default=8)
def max_hours_by_day_events(t: ReportTables) -> DataFrame:
    return durations.max_hours_by_month_events(t.events("audio"), "DAY")


@query(default=4)
def mean_approx_median_by_month(t: ReportTables) -> DataFrame:
    monthly = t.monthly("audio", S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    return durations.mean_approx_median_by_month(monthly, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=4)
def mean_exact_median_by_month(t: ReportTables) -> DataFrame:
    monthly = t.monthly("audio", S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    return durations.mean_exact_median_by_month(monthly, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=4)
def mean_median_aggregate_form(t: ReportTables) -> DataFrame:
    monthly = t.monthly("video", S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    return durations.mean_median_aggregate_form(monthly, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=6)
def mean_weighted_vs_unweighted(t: ReportTables) -> DataFrame:
    monthly = t.monthly("video", S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    return durations.mean_weighted_vs_unweighted(monthly, S.FIRST_MONTH, S.LAST_MONTH)


@query(default=6)
def weighted_mean_two_sources(t: ReportTables) -> DataFrame:
    return durations.weighted_mean_by_source(t.by_source(("audio", "video")))


@query(default=7)
def event_stats_by_month(t: ReportTables) -> DataFrame:
    return durations.event_stats_by_month(t.events("video"))


@query(default=7)
def event_stats_by_day(t: ReportTables) -> DataFrame:
    return durations.event_stats_by_month(t.events("video"), "DAY")


@query(default=7)
def event_stats_by_hour(t: ReportTables) -> DataFrame:
    return durations.event_stats_by_month(t.events("audio"), "HOUR")


@query(default=7)
def event_stats_side_by_side(t: ReportTables) -> DataFrame:
    names = ("audio", "video")
    return durations.event_stats_side_by_side(star.recording_events_by_source(t.table("events"), names), "DAY", names)


@query(default=8)
def events_vs_agg_delta(t: ReportTables) -> DataFrame:
    return durations.statistics_delta(t.events_beside_tables("audio"))


@query(default=8)
def events_vs_agg_candidates(t: ReportTables) -> DataFrame:
    return durations.statistics_candidates(t.events_beside_tables("audio"))


ROLL_UPS = {"month": ("source", "month"), "country": ("source", "country"), "source": ("source",), "all": ()}


@query(default=4)
def sketched_medians(t: ReportTables) -> DataFrame:
    """Medians of every roll-up of the monthly table from its kept sketches, held against all recordings.

    The estimate itself depends on how the rows were split, so the report shows what is exact and
    whether the median's rank lies within twice the sketch's error.
    """
    rows = star.recordings(*t.people())
    path = storage.work_path(t.spark, "sketches")
    sketches.sketch_table(rows, ["source", "month", "country"], "duration_sec").write.parquet(path)
    found = sketches.quantiles(sketches.levels(t.spark.read.parquet(path), ROLL_UPS), {"median": 0.5})
    checked = sketches.rank_check(rows, ROLL_UPS, "duration_sec", found, "median", 0.5, 2 * sketches.rank_error())
    keys = ("level", "source", "month", "country")
    right = checked.select(*[F.col(c).alias(f"_{c}") for c in keys], "within")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return found.join(right, same, "left").select(*keys, "n", "lowest", "highest", "within")


@query(places={"avg_ms": 1}, default=4)
def unit_ratio_check(t: ReportTables) -> DataFrame:
    monthly = t.monthly("video", S.FIRST_MONTH, S.AFTER_LAST_MONTH, median=False)
    return durations.unit_ratio_check(
        monthly, S.LOOKUP_MONTH, S.RATIO_TARGET, S.FIRST_MONTH, S.LAST_MONTH
    )


# --- histograms -------------------------------------------------------------------------


@query()
def duration_histogram(t: ReportTables) -> DataFrame:
    return histograms.duration_histogram(t.events("audio"))


@query()
def duration_histogram_view(t: ReportTables) -> DataFrame:
    return histograms.duration_histogram(t.view("video"))


@query()
def duration_histogram_date_range(t: ReportTables) -> DataFrame:
    return histograms.duration_histogram_date_range(t.events("audio"), S.FIRST_DAY, S.AFTER_LAST_DAY)


@query()
def duration_histogram_cutoff(t: ReportTables) -> DataFrame:
    return histograms.duration_histogram_cutoff(t.events("audio"), S.CUTOFF)


@query()
def duration_histogram_cutoff_view(t: ReportTables) -> DataFrame:
    return histograms.duration_histogram_cutoff(t.view("video"), S.CUTOFF)


@query()
def histogram_from_aggregate(t: ReportTables) -> DataFrame:
    return histograms.histogram_from_aggregate(t.monthly("video", median=False))


@query(places={"pct_delta": 9})
def histogram_cutoff_comparison(t: ReportTables) -> DataFrame:
    return histograms.histogram_cutoff_comparison(t.events("audio"), S.CUTOFF)


@query()
def shard_histogram_date_range(t: ReportTables) -> DataFrame:
    """The date range read from the shards of its days alone."""
    events = t.shard_events("audio", S.FIRST_SHARD, S.LAST_SHARD)
    return histograms.duration_histogram_date_range(events, S.FIRST_DAY, S.AFTER_LAST_DAY)


@query()
def shard_histogram_cutoff(t: ReportTables) -> DataFrame:
    """The cutoff compared with times stored as whole microseconds."""
    return histograms.duration_histogram_cutoff(t.shard_events("audio"), S.CUTOFF)


@query(default=7)
def shard_event_stats_by_day(t: ReportTables) -> DataFrame:
    return durations.event_stats_by_month(t.shard_events("audio"), "DAY")


@query(default=10)
def shard_cutoff_sweep_hourly(t: ReportTables) -> DataFrame:
    target = histograms.duration_histogram_cutoff(t.shard_events("audio"), S.CUTOFF)
    return sweeps.cutoff_sweep(t.shard_events("audio"), target.select("bin", F.col("pct").alias("target")), "HOUR")


@query(default=4)
def shard_countries(t: ReportTables) -> DataFrame:
    """Every shard, no day asked for: recordings by source and country."""
    return t.shards().groupBy("source", "country").agg(
        F.count(F.lit(1)).alias("num_tracks"),
        F.sum("duration_sec").alias("total_duration_sec"),
        F.count_distinct(storage.DAY_COLUMN).alias("days"),
    )


@query(places={"pct_delta": 9})
def histogram_snapshot_labels(t: ReportTables) -> DataFrame:
    """A range of days against a snapshot of shorter recordings, over the labels of either."""
    days = histograms.duration_histogram_date_range(t.events("audio"), S.FIRST_DAY, S.AFTER_LAST_DAY)
    short = t.events("audio").filter(F.col("duration_sec") < S.SNAPSHOT_LONGEST)
    return histograms.snapshot_comparison(days, histograms.duration_histogram_cutoff(short, S.CUTOFF), ("days", "short"))


def _fine_counts(t: ReportTables) -> DataFrame:
    return stack(tag(histograms.fine_bin_counts(t.events(s)), s) for s in ("audio", "video"))


@query()
def fine_bin_counts(t: ReportTables) -> DataFrame:
    return _fine_counts(t)


@query()
def interpolated_median(t: ReportTables) -> DataFrame:
    return histograms.interpolated_median(_fine_counts(t), "source")


@query()
def interpolated_quartile(t: ReportTables) -> DataFrame:
    return histograms.interpolated_median(_fine_counts(t), "source", q=0.25)


@query()
def cumulative_distribution(t: ReportTables) -> DataFrame:
    return histograms.cumulative_distribution(_fine_counts(t), "source")


# --- reconciliation ---------------------------------------------------------------------


def _target(t: ReportTables, cutoff: str = S.CUTOFF) -> DataFrame:
    """Observed shares: the audio histogram as it was at a known cutoff."""
    return histograms.duration_histogram_cutoff(t.events("audio"), cutoff).select(
        "bin", F.col("pct").alias("target")
    )


def _scenarios(t: ReportTables) -> DataFrame:
    def in_range(df: DataFrame) -> Column:
        return within(df, "event_timestamp", S.FIRST_DAY, S.AFTER_LAST_DAY)

    long_enough = at_least(F.col("duration_sec"), 2.0)
    hypotheses = {
        "all": None,
        "all_ge2": long_enough,
        "range": in_range,
        "range_ge2": lambda df: in_range(df) & long_enough,
        "cutoff": lambda df: before(df, "event_timestamp", S.CUTOFF),
    }
    return reconcile.histogram_scenarios(
        {"events": t.events("audio"), "view": t.view("video")},
        {f"{source}_{name}": (source, test) for source in ("events", "view") for name, test in hypotheses.items()},
    )


@query()
def histogram_scenarios(t: ReportTables) -> DataFrame:
    return _scenarios(t)


@query(default=10)
def scenario_scores(t: ReportTables) -> DataFrame:
    return reconcile.scenario_scores(_scenarios(t), _target(t))


@query(default=9)
def scenario_deltas(t: ReportTables) -> DataFrame:
    return reconcile.scenario_deltas(_scenarios(t), _target(t))


@query(default=10)
def cutoff_sweep_hourly(t: ReportTables) -> DataFrame:
    return sweeps.cutoff_sweep(t.events("audio"), _target(t), "HOUR")


@query(default=9)
def cutoff_sweep_hourly_deltas(t: ReportTables) -> DataFrame:
    best = sweeps.cutoff_sweep(t.events("video"), _target(t), "HOUR")
    return sweeps.best_cutoff_deltas(best, _target(t))


@query(default=10)
def cutoff_sweep_detail(t: ReportTables) -> DataFrame:
    return sweeps.cutoff_sweep_detail({"audio": t.events("audio")}, _target(t), "DAY")


@query(default=10)
def cutoff_sweep_sources(t: ReportTables) -> DataFrame:
    sources = {"events": t.events("audio"), "view": t.view("video")}
    return sweeps.cutoff_sweep_sources(sources, _target(t), "HOUR")


@query(default=10)
def cutoff_refine_seconds(t: ReportTables) -> DataFrame:
    target = _target(t, S.SECOND_CUTOFF)
    return sweeps.cutoff_refine(t.events("audio"), target, S.REFINE_START, S.REFINE_END, "SECOND")


def _series(t: ReportTables) -> tuple[DataFrame, DataFrame]:
    """The median series of every month and, as target, the same by the MEDIAN form with one month shifted; ours lacks a month."""
    monthly = t.monthly("video", S.FIRST_MONTH, S.AFTER_LAST_MONTH)
    key, value = F.date_format("month", "yyyy-MM").alias("key"), F.col("median_duration_sec")
    got = durations.mean_exact_median_by_month(monthly).select(key, value.alias("got"))
    target = durations.mean_median_aggregate_form(monthly).select(key, value.alias("target"))
    shifted = F.when(F.col("key") == S.SHIFTED_KEY, F.col("target") + 1.0).otherwise(F.col("target"))
    return got.filter(F.col("key") != S.MISSING_KEY), target.withColumn("target", shifted)


@query(default=4)
def series_compare(t: ReportTables) -> DataFrame:
    return reconcile.series_compare(*_series(t), tol=S.SERIES_TOLERANCE)


@query(default=4)
def series_compare_summary(t: ReportTables) -> DataFrame:
    return reconcile.series_summary(reconcile.series_compare(*_series(t), tol=S.SERIES_TOLERANCE))


@query(default=9)
def histogram_compare(t: ReportTables) -> DataFrame:
    got = histograms.duration_histogram(t.view("audio"))
    return reconcile.histogram_compare(got, _target(t), tol=1e-3, bins=DURATION_BINS)
