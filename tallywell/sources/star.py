"""Report tables derived from the star-schema tables (orders, lineitem, events, ...).

"Country" is the nation of the customer. Joins carry no broadcast hint: Spark
broadcasts customer or nation only while they are under its own size threshold
and otherwise runs a shuffle join that adaptive execution splits on hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.numbers import at_least
from tallywell.functions.periods import Instant, micros_of, within
from tallywell.operators.quantiles import Rank, distribution

# Which rows stand for which source.
EVENT_TYPES = {"audio": "click", "video": "view", "livestream": "purchase"}
ORDER_STATUS = {"audio": "F", "video": "O", "livestream": "P"}
IMPORT_FLAGS = {"audio": ("A", "F"), "video": ("R", "F")}
EXPORT_FLAGS = {"audio": ("A", "O"), "video": ("R", "O")}
TRACK_FLAGS = {"audio": ("N", "F"), "video": ("N", "O")}
URGENT = "1-URGENT"


def recording_events(events: DataFrame, source: str, as_micros: bool = False) -> DataFrame:
    """``(event_id, event_timestamp, duration_sec)``, one row per recording.

    ``event_timestamp`` keeps the stored type so that time filters reach the
    scan; ``as_micros`` converts it to epoch microseconds.
    """
    time = micros_of(events, "ts") if as_micros else F.col("ts")
    return events.filter(F.col("event_type") == EVENT_TYPES[source]).select(
        F.col("event_id").cast("string").alias("event_id"),
        time.alias("event_timestamp"),
        (F.col("value") * F.col("value")).alias("duration_sec"),
    )


def recording_events_by_source(events: DataFrame, sources: Sequence[str] = tuple(EVENT_TYPES)) -> DataFrame:
    """``(source, event_id, event_timestamp, duration_sec)`` of several sources from one read of the events."""
    kinds = {s: EVENT_TYPES[s] for s in sources}
    return events.filter(F.col("event_type").isin(*kinds.values())).select(
        _source_of(F.col("event_type"), kinds).alias("source"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_timestamp"),
        (F.col("value") * F.col("value")).alias("duration_sec"),
    )


def located_events(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """All recordings in the layout of an event export: ``(event_id, event_timestamp, country, duration_sec, source)``,
    the time as BIGINT microseconds, the country that of the user."""
    rows = events.select(
        "user_id",
        F.col("event_id").cast("string").alias("event_id"),
        micros_of(events, "ts").alias("event_timestamp"),
        (F.col("value") * F.col("value")).alias("duration_sec"),
        _source_of(F.col("event_type"), EVENT_TYPES).alias("source"),
    ).filter("source IS NOT NULL")
    return with_country(rows, "user_id", customer, nation).select(
        "event_id", "event_timestamp", "country", "duration_sec", "source"
    )


def duration_view(events: DataFrame, source: str, as_micros: bool = False) -> DataFrame:
    """The second population: recordings of at least two seconds."""
    rows = recording_events(events, source, as_micros)
    return rows.filter(at_least(F.col("duration_sec"), 2.0)).select("event_timestamp", "duration_sec")


def with_country(rows: DataFrame, customer_key: str, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Every row with the nation of its customer; an unknown country is the empty text."""
    who = customer.select(F.col("c_custkey").alias(customer_key), "c_nationkey")
    where = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    found = rows.join(who, customer_key, "left").join(where, "c_nationkey", "left").drop("c_nationkey")
    return found.withColumn("country", F.coalesce("country", F.lit("")))


def raw_events(events: DataFrame) -> DataFrame:
    """Nested export: one ``duration`` parameter, typed by the parity of the event id."""
    even = F.col("event_id") % 2 == 0
    value = F.struct(
        F.when(even, F.col("value")).alias("double_value"),
        F.when(~even, F.col("value").cast("string")).alias("string_value"),
    )
    return events.select(
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        F.col("event_type").alias("event_name"),
        F.array(F.struct(F.lit("duration").alias("key"), value.alias("value"))).alias("event_params"),
    )


def _month(column: str) -> Column:
    return F.trunc(F.col(column), "MM")


def _statistics(rows: DataFrame, keys: list[str], median: bool) -> DataFrame:
    """The recordings table over ``(keys, seconds, lossless)``: one row per group, NULL seconds counted as
    recordings without a duration. ``median`` adds a column and changes no other."""
    seconds = F.col("seconds")
    if not median:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("num_tracks"),
            F.sum(seconds).alias("total_duration_sec"),
            F.min(seconds).alias("min_duration_sec"),
            F.max(seconds).alias("max_duration_sec"),
            F.avg(seconds).alias("mean_duration_sec"),
            F.stddev_samp(seconds).alias("stddev_duration_sec"),
            F.count_if("lossless").alias("num_lossless"),
        )
    spread = distribution(
        rows, keys, "seconds", sums={"num_lossless": F.when(F.col("lossless"), 1).otherwise(0)}, quantile="median_duration_sec"
    )
    return spread.select(
        *keys,
        F.col("rows").alias("num_tracks"),
        F.col("total").alias("total_duration_sec"),
        F.col("lowest").alias("min_duration_sec"),
        F.col("highest").alias("max_duration_sec"),
        F.try_divide("total", "n").alias("mean_duration_sec"),
        F.col("stddev").alias("stddev_duration_sec"),
        "median_duration_sec",
        "num_lossless",
    )


def _source_of(kind: Column, kinds: dict[str, str]) -> Column:
    """The source that a row stands for; NULL for none."""
    return F.coalesce(*[F.when(kind == known, source) for source, known in kinds.items()])


def _sold(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """``(source, month, country, seconds, lossless)``, a row per order."""
    sold = orders.select(
        "o_custkey",
        _source_of(F.col("o_orderstatus"), ORDER_STATUS).alias("source"),
        _month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("seconds"),
        (F.col("o_orderpriority") == URGENT).alias("lossless"),
    )
    return with_country(sold, "o_custkey", customer, nation)


def recordings(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, sources: Sequence[str] = tuple(ORDER_STATUS)
) -> DataFrame:
    """``(source, month, country, duration_sec)``: the single recordings behind the monthly tables."""
    wanted = orders.filter(F.col("o_orderstatus").isin([ORDER_STATUS[s] for s in sources]))
    return _sold(wanted, customer, nation).select("source", "month", "country", F.col("seconds").alias("duration_sec"))


def recordings_monthly(
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    source: str,
    start: Instant | None = None,
    end: Instant | None = None,
    median: bool = True,
) -> DataFrame:
    """Month x country table of one source; ``start``/``end`` (half-open) prune the scan."""
    wanted = orders.filter(
        (F.col("o_orderstatus") == ORDER_STATUS[source]) & within(orders, "o_orderdate", start, end)
    )
    return _statistics(_sold(wanted, customer, nation).drop("source"), ["month", "country"], median)


def recordings_by_source(
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    sources: Sequence[str] = tuple(ORDER_STATUS),
    start: Instant | None = None,
    end: Instant | None = None,
    median: bool = False,
) -> DataFrame:
    """The tables of several sources as one, labelled by ``source``, from one read of the orders."""
    wanted = orders.filter(
        F.col("o_orderstatus").isin([ORDER_STATUS[s] for s in sources]) & within(orders, "o_orderdate", start, end)
    )
    return _statistics(_sold(wanted, customer, nation), ["source", "month", "country"], median)


def recordings_sample(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, source: str, n: int = 10
) -> DataFrame:
    """The first ``n`` rows of ``recordings_monthly`` by month and country, medians of these groups only."""
    wanted = orders.filter(F.col("o_orderstatus") == ORDER_STATUS[source])
    sold = _sold(wanted, customer, nation).drop("source")
    first = sold.groupBy("month", "country").agg(F.count(F.lit(1)).alias("_n")).orderBy("month", "country").limit(n)
    keys = first.select(F.col("month").alias("_m"), F.col("country").alias("_c"))
    same = F.col("month").eqNullSafe(F.col("_m")) & F.col("country").eqNullSafe(F.col("_c"))
    return _statistics(sold.join(F.broadcast(keys), same, "left_semi"), ["month", "country"], median=True)


def events_beside_tables(
    events: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, source: str
) -> DataFrame:
    """Duration statistics per ``(kind, month, country)`` from one labelled job over both tables.

    Kind ``events`` holds the events of a month as a whole (no country), ``events_table`` the monthly table
    made of them by the users' countries, and ``orders_table`` that of the orders. An event counts in both
    of its kinds by being doubled inside the task, before the counting that combines it.
    """
    played = events.filter(F.col("event_type") == EVENT_TYPES[source]).select(
        "user_id", _month("ts").alias("month"), (F.col("value") * F.col("value")).alias("seconds")
    )
    played = with_country(played, "user_id", customer, nation)
    whole = F.struct(F.lit("events").alias("kind"), F.lit(None).cast("string").alias("country"))
    listed = F.struct(F.lit("events_table").alias("kind"), F.col("country").alias("country"))
    played = played.select("month", "seconds", F.inline(F.array(whole, listed)))
    sold = _sold(orders.filter(F.col("o_orderstatus") == ORDER_STATUS[source]), customer, nation)
    sold = sold.select("month", "seconds", F.lit("orders_table").alias("kind"), "country")
    spread = distribution(
        played.unionByName(sold),
        ["kind", "month", "country"],
        "seconds",
        moments=("rows", "n", "total"),
        ranks={"median_duration_sec": Rank(0.5), "middle_duration_sec": Rank(0.5, interpolated=False)},
    )
    return spread.select(
        "kind",
        "month",
        "country",
        F.col("rows").alias("num_tracks"),
        F.col("total").alias("total_duration_sec"),
        F.try_divide("total", "n").alias("mean_duration_sec"),
        "median_duration_sec",
        "middle_duration_sec",
    )


def active_users_monthly(
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
) -> DataFrame:
    """Distinct customers per month and country, by source and overall.

    A customer has one country, so customers are made distinct per month first
    and the country is joined to what is left.
    """
    known = orders.filter(F.col("o_custkey").isNotNull() & within(orders, "o_orderdate", start, end))
    flags = known.groupBy(_month("o_orderdate").alias("month"), "o_custkey").agg(
        *[
            F.max(F.when(F.col("o_orderstatus") == status, 1).otherwise(0)).alias(source)
            for source, status in ORDER_STATUS.items()
        ]
    )
    return with_country(flags, "o_custkey", customer, nation).groupBy("month", "country").agg(
        *[F.sum(source).alias(f"active_{source}_users") for source in ORDER_STATUS],
        F.count(F.lit(1)).alias("total_active_users"),
    )


def active_users_by_source(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """``(source, month, country, active_users)`` from one read of the orders: distinct customers."""
    people = (
        orders.filter(F.col("o_custkey").isNotNull())
        .select(_source_of(F.col("o_orderstatus"), ORDER_STATUS).alias("source"), _month("o_orderdate").alias("month"), "o_custkey")
        .filter("source IS NOT NULL")
        .distinct()
    )
    return with_country(people, "o_custkey", customer, nation).groupBy("source", "month", "country").agg(
        F.count(F.lit(1)).alias("active_users")
    )


def _lines(
    lineitem: DataFrame, flags: tuple[str, str], start: Instant | None, end: Instant | None
) -> DataFrame:
    returned, status = flags
    return lineitem.filter(
        (F.col("l_returnflag") == returned)
        & (F.col("l_linestatus") == status)
        & within(lineitem, "l_shipdate", start, end)
    ).withColumn("month", _month("l_shipdate"))


def imports_monthly(
    lineitem: DataFrame, source: str, start: Instant | None = None, end: Instant | None = None
) -> DataFrame:
    return _lines(lineitem, IMPORT_FLAGS[source], start, end).groupBy("month").agg(
        F.count(F.lit(1)).alias("num_imports"),
        F.sum("l_extendedprice").alias("total_track_duration"),
        F.sum("l_quantity").alias("total_import_duration"),
        F.count_if(F.col("l_linenumber") == 1).alias("num_batch_imports"),
    )


def exports_monthly(
    lineitem: DataFrame, source: str, start: Instant | None = None, end: Instant | None = None
) -> DataFrame:
    exported = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _lines(lineitem, EXPORT_FLAGS[source], start, end).groupBy("month").agg(
        F.count(F.lit(1)).alias("num_exports"),
        F.sum("l_extendedprice").alias("total_duration"),
        F.sum(exported).alias("total_exported_track_duration"),
        F.sum("l_tax").alias("total_exporting_time"),
    )


def tracks_monthly(
    lineitem: DataFrame, source: str, start: Instant | None = None, end: Instant | None = None
) -> DataFrame:
    return _lines(lineitem, TRACK_FLAGS[source], start, end).groupBy("month").agg(
        F.count(F.lit(1)).alias("num_tracks")
    )


def transfers_by_source(
    lineitem: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
    tracks: bool = False,
) -> DataFrame:
    """Imports and exports of audio and video (and with ``tracks`` their recordings) as one table, labelled by
    ``source``, from one read of the lines. Columns that a table does not have are NULL."""
    kinds = {f"{s}_imports": f for s, f in IMPORT_FLAGS.items()} | {f"{s}_exports": f for s, f in EXPORT_FLAGS.items()}
    if tracks:
        kinds |= {f"{s}_recording": f for s, f in TRACK_FLAGS.items()}
    pair = F.concat("l_returnflag", "l_linestatus")
    lines = lineitem.filter(pair.isin([r + s for r, s in kinds.values()]) & within(lineitem, "l_shipdate", start, end))
    rows = lines.select(
        _source_of(pair, {name: r + s for name, (r, s) in kinds.items()}).alias("source"),
        _month("l_shipdate").alias("month"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber",
    )
    imported, exported = F.col("source").endswith("_imports"), F.col("source").endswith("_exports")
    price = F.col("l_extendedprice")
    measures = [
        F.count_if(imported).alias("num_imports"),
        F.sum(F.when(imported, price)).alias("total_track_duration"),
        F.sum(F.when(imported, F.col("l_quantity"))).alias("total_import_duration"),
        F.count_if(imported & (F.col("l_linenumber") == 1)).alias("num_batch_imports"),
        F.count_if(exported).alias("num_exports"),
        F.sum(F.when(exported, price)).alias("total_duration"),
        F.sum(F.when(exported, price * (1 - F.col("l_discount")))).alias("total_exported_track_duration"),
        F.sum(F.when(exported, F.col("l_tax"))).alias("total_exporting_time"),
    ]
    counts = {"num_imports": imported, "num_batch_imports": imported, "num_exports": exported}
    if tracks:
        recorded = F.col("source").endswith("_recording")
        measures.append(F.count_if(recorded).alias("num_tracks"))
        counts["num_tracks"] = recorded
    found = rows.groupBy("source", "month").agg(*measures)
    return found.withColumns({c: F.when(test, F.col(c)) for c, test in counts.items()})
