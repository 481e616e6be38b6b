"""Plain SQL for every registered query, over the same driver tables."""

from __future__ import annotations

from tallywell.functions.bins import DURATION_BINS, FINE_BINS
from tallywell.plans import settings as S
from tallywell.sources.star import (
    EVENT_TYPES,
    EXPORT_FLAGS,
    IMPORT_FLAGS,
    ORDER_STATUS,
    TRACK_FLAGS,
    URGENT,
)

SOURCES = ("audio", "video", "livestream")
N_BINS = len(DURATION_BINS.labels)


def _r(expression: str, places: int = 6) -> str:
    return f"round(({expression}) + {S.guard(places)}, {places}) + 0.0"


def _bin_ord(value: str) -> str:
    tests = " ".join(
        f"WHEN {value} < {edge} THEN {i}" for i, edge in enumerate(DURATION_BINS.lower[1:], start=1)
    )
    return f"CASE {tests} ELSE {N_BINS} END"


_BIN_NAMES = "bin_names AS (SELECT * FROM (VALUES {}) AS v(bin_ord, bin))".format(
    ", ".join(f"({i}, '{label}')" for i, label in enumerate(DURATION_BINS.labels, start=1))
)


def _events(source: str) -> str:
    return (
        "SELECT ts, value * value AS duration_sec FROM events "
        f"WHERE event_type = '{EVENT_TYPES[source]}'"
    )


def _view(source: str) -> str:
    return f"SELECT * FROM ({_events(source)}) AS e WHERE duration_sec >= 2"


def _histogram(rows: str, value: str = "duration_sec", count: str = "count(*)") -> str:
    """bin_ord, bin, cnt, pct (unrounded) of a row source."""
    return f"""
      SELECT c.bin_ord, n.bin, c.cnt,
             CAST(c.cnt AS DOUBLE) / nullif(sum(c.cnt) OVER (), 0) AS pct
      FROM (SELECT {_bin_ord(value)} AS bin_ord, CAST({count} AS BIGINT) AS cnt
            FROM ({rows}) AS r GROUP BY 1) AS c
      JOIN bin_names AS n ON n.bin_ord = c.bin_ord"""


def _shown_histogram(rows: str, value: str = "duration_sec", count: str = "count(*)") -> str:
    return (
        f"WITH {_BIN_NAMES} SELECT bin, bin_ord, cnt, {_r('pct')} AS pct "
        f"FROM ({_histogram(rows, value, count)}) AS h"
    )


def _monthly(source: str) -> str:
    return f"""
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, coalesce(n_name, '') AS country,
             count(*) AS num_tracks, sum(o_totalprice) AS total_duration_sec,
             min(o_totalprice) AS min_duration_sec, max(o_totalprice) AS max_duration_sec,
             avg(o_totalprice) AS mean_duration_sec, stddev_samp(o_totalprice) AS stddev_duration_sec,
             quantile_cont(o_totalprice, 0.5) AS median_duration_sec,
             count(*) FILTER (WHERE o_orderpriority = '{URGENT}') AS num_lossless
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderstatus = '{ORDER_STATUS[source]}'
      GROUP BY 1, 2"""


def _monthly_of_events(source: str) -> str:
    return f"""
      SELECT CAST(date_trunc('month', ts) AS DATE) AS month, coalesce(n_name, '') AS country,
             count(*) AS num_tracks, sum(value * value) AS total_duration_sec,
             avg(value * value) AS mean_duration_sec,
             quantile_cont(value * value, 0.5) AS median_duration_sec
      FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      WHERE event_type = '{EVENT_TYPES[source]}'
      GROUP BY 1, 2
      UNION ALL
      SELECT month, country, num_tracks, total_duration_sec, mean_duration_sec, median_duration_sec
      FROM ({_monthly(source)}) AS m"""


def _users() -> str:
    counts = ", ".join(
        f"count(DISTINCT CASE WHEN o_orderstatus = '{status}' THEN o_custkey END) AS active_{s}_users"
        for s, status in ORDER_STATUS.items()
    )
    return f"""
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, coalesce(n_name, '') AS country, {counts},
             count(DISTINCT o_custkey) AS total_active_users
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      GROUP BY 1, 2"""


def _text(column: str = "month") -> str:
    return f"strftime({column}, '%Y-%m-%d')"


_RANGE = f"month BETWEEN DATE '{S.FIRST_MONTH}' AND DATE '{S.LAST_MONTH}'"


def _active_from_events(period: str) -> str:
    counts = ", ".join(
        f"count(DISTINCT CASE WHEN event_type = '{kind}' THEN user_id END) AS active_{label}"
        for label, kind in EVENT_TYPES.items()
    )
    kinds = ", ".join(f"'{k}'" for k in EVENT_TYPES.values())
    return f"""
      SELECT strftime(date_trunc('{period}', ts), '%Y-%m-%d') AS period, {counts},
             count(DISTINCT user_id) AS total_active
      FROM events WHERE event_type IN ({kinds}) AND value >= 2.0 GROUP BY 1"""


def _totals_by_month() -> str:
    parts = [
        f"{s} AS (SELECT month, sum(num_tracks) AS tracks, sum(total_duration_sec) AS seconds "
        f"FROM ({_monthly(s)}) AS m GROUP BY month)"
        for s in SOURCES
    ]
    tracks = ", ".join(f"CAST(coalesce({s}.tracks, 0) AS BIGINT) AS {s}_tracks" for s in SOURCES)
    seconds = ", ".join(f"{_r(f'coalesce({s}.seconds, 0)', 2)} AS {s}_duration_sec" for s in SOURCES)
    return f"""
      WITH {', '.join(parts)}
      SELECT {_text('month')} AS month, {tracks}, {seconds}
      FROM audio FULL OUTER JOIN video USING (month) FULL OUTER JOIN livestream USING (month)
      WHERE CAST(month AS VARCHAR) >= '{S.SINCE}'"""


def _grand_totals() -> str:
    parts = [
        f"{s} AS (SELECT CAST(sum(num_tracks) AS BIGINT) AS tracks, "
        f"sum(total_duration_sec) / 3600.0 AS hours FROM ({_monthly(s)}) AS m)"
        for s in SOURCES
    ]
    columns = [f"{s}.tracks AS {s}_tracks" for s in SOURCES]
    columns += [f"{_r(f'{s}.hours', 4)} AS {s}_hours" for s in SOURCES]
    return f"WITH {', '.join(parts)} SELECT {', '.join(columns)} FROM audio, video, livestream"


def _lookup_by_source() -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS source, country, {_text()} AS month, num_tracks, "
        f"{_r('total_duration_sec', 2)} AS total_duration_sec FROM ({_monthly(s)}) AS m "
        f"WHERE month = DATE '{S.LOOKUP_MONTH}' AND country = '{S.LOOKUP_COUNTRY}'"
        for s in SOURCES
    )


def _three_sources() -> str:
    own = [
        f"own_{s} AS (SELECT month, CAST(sum(n) AS BIGINT) AS n FROM ("
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, n_name, "
        "count(DISTINCT o_custkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
        f"LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = '{ORDER_STATUS[s]}' "
        "GROUP BY 1, 2) AS x GROUP BY month)"
        for s in SOURCES
    ]
    sums = ", ".join(f"CAST(sum(active_{s}_users) AS BIGINT) AS {s}" for s in SOURCES)
    columns = ", ".join(
        f"coalesce(own_{s}.n, 0) AS {s}_from_sources, ref.{s} AS {s}_from_reference, "
        f"coalesce(own_{s}.n, 0) - ref.{s} AS {s}_delta"
        for s in SOURCES
    )
    return f"""
      WITH {', '.join(own)}, ref AS (SELECT month, {sums} FROM ({_users()}) AS u GROUP BY month)
      SELECT {_text('month')} AS month, {columns}
      FROM own_audio FULL OUTER JOIN own_video USING (month)
      FULL OUTER JOIN own_livestream USING (month) LEFT JOIN ref USING (month)
      WHERE CAST(month AS VARCHAR) >= '{S.SINCE}'"""


def _lines(flags: tuple[str, str], columns: str) -> str:
    return (
        f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {columns} FROM lineitem "
        f"WHERE l_returnflag = '{flags[0]}' AND l_linestatus = '{flags[1]}' GROUP BY 1"
    )


_IMPORTS = {
    "num_imports": ("count(*)", 0),
    "total_track_duration": ("sum(l_extendedprice)", 4),
    "total_import_duration": ("sum(l_quantity)", 4),
    "num_batch_imports": ("count(*) FILTER (WHERE l_linenumber = 1)", 0),
}
_EXPORTS = {
    "num_exports": ("count(*)", 0),
    "total_duration": ("sum(l_extendedprice)", 4),
    "total_exported_track_duration": ("sum(l_extendedprice * (1 - l_discount))", 4),
    "total_exporting_time": ("sum(l_tax)", 4),
}
_TRANSFERS = {
    "audio_imports": (IMPORT_FLAGS["audio"], _IMPORTS),
    "audio_exports": (EXPORT_FLAGS["audio"], _EXPORTS),
    "video_imports": (IMPORT_FLAGS["video"], _IMPORTS),
    "video_exports": (EXPORT_FLAGS["video"], _EXPORTS),
}


def _transfer(name: str) -> str:
    flags, columns = _TRANSFERS[name]
    return _lines(flags, ", ".join(f"{sql} AS {c}" for c, (sql, _) in columns.items()))


def _transfer_totals(by_month: bool, places: int) -> str:
    parts = []
    for name, (_, columns) in _TRANSFERS.items():
        shown = []
        for column, (_, fraction) in {**_IMPORTS, **_EXPORTS}.items():
            kind = "DOUBLE" if fraction else "BIGINT"
            if column not in columns:
                shown.append(f"CAST(NULL AS {kind}) AS {column}")
            elif fraction:
                shown.append(f"{_r(f'sum({column})', places)} AS {column}")
            else:
                shown.append(f"CAST(sum({column}) AS BIGINT) AS {column}")
        month = "strftime(month, '%Y-%m') AS month, " if by_month else ""
        where = f"WHERE {_RANGE} GROUP BY 2" if by_month else ""
        parts.append(
            f"SELECT '{name}' AS source, {month}{', '.join(shown)} FROM ({_transfer(name)}) AS x {where}"
        )
    return " UNION ALL ".join(parts)


def _recording_totals(places: int = 5) -> str:
    doubles = ("total", "min", "max", "mean", "stddev", "median")
    sums = ", ".join(
        f"{_r(f'sum({d}_duration_sec)', 4 if d == 'stddev' else places)} AS {d}_duration_sec"
        for d in doubles
    )
    return " UNION ALL ".join(
        f"SELECT '{s}_recording' AS source, strftime(month, '%Y-%m') AS month, "
        f"CAST(sum(num_tracks) AS BIGINT) AS num_tracks, {sums}, "
        "CAST(sum(num_lossless) AS BIGINT) AS num_lossless "
        f"FROM ({_monthly(s)}) AS m WHERE {_RANGE} GROUP BY 2"
        for s in ("audio", "video")
    )


def _trend() -> str:
    counts = {name: _transfer(name) for name in _TRANSFERS}
    counts["audio_recording"] = _lines(TRACK_FLAGS["audio"], "count(*) AS num_tracks")
    counts["video_recording"] = _lines(TRACK_FLAGS["video"], "count(*) AS num_tracks")
    column = {"imports": "num_imports", "exports": "num_exports", "recording": "num_tracks"}
    rows = " UNION ALL ".join(
        f"SELECT month, '{name}' AS source, {column[name.split('_')[1]]} AS val FROM ({sql}) AS x"
        for name, sql in counts.items()
    )
    pivot = ", ".join(
        f"CAST(coalesce(sum(val) FILTER (WHERE source = '{name}'), 0) AS BIGINT) AS {name}"
        for name in counts
    )
    return (
        f"SELECT strftime(month, '%Y-%m') AS month, {pivot} FROM ({rows}) AS r WHERE {_RANGE} GROUP BY 1"
    )


def _mean_median(source: str, median: str) -> str:
    return (
        f"SELECT {_text()} AS month, {_r('avg(mean_duration_sec)', 4)} AS mean_duration_sec, "
        f"{_r(median, 4)} AS median_duration_sec FROM ({_monthly(source)}) AS m WHERE {_RANGE} GROUP BY 1"
    )


def _event_stats(source: str, period: str) -> str:
    """Unformatted statistics per period."""
    return (
        f"SELECT date_trunc('{period}', ts) AS period, max(duration_sec) AS max_duration_sec, "
        "max(duration_sec) / 3600.0 AS max_duration_hour, avg(duration_sec) AS mean_duration_sec, "
        f"quantile_cont(duration_sec, 0.5) AS median_duration_sec FROM ({_events(source)}) AS e GROUP BY 1"
    )


_STATS = ("max_duration_sec", "max_duration_hour", "mean_duration_sec", "median_duration_sec")


def _shown_event_stats(source: str, period: str, pattern: str = "%Y-%m-%d") -> str:
    columns = ", ".join(f"{_r(c, 7)} AS {c}" for c in _STATS)
    return (
        f"SELECT strftime(period, '{pattern}') AS period, {columns} "
        f"FROM ({_event_stats(source, period)}) AS s"
    )


def _side_by_side() -> str:
    columns = ", ".join(f"{_r(f'{s}.{c}', 7)} AS {s}_{c}" for s in ("audio", "video") for c in _STATS)
    return f"""
      WITH audio AS ({_event_stats('audio', 'day')}), video AS ({_event_stats('video', 'day')})
      SELECT strftime(coalesce(audio.period, video.period), '%Y-%m-%d') AS period, {columns}
      FROM audio FULL OUTER JOIN video ON audio.period = video.period"""


def _event_hours() -> str:
    return (
        "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, avg(duration_sec) / 3600.0 AS mean_h, "
        "quantile_disc(duration_sec / 3600.0, 0.5) AS median_h "
        f"FROM ({_events('audio')}) AS e GROUP BY 1"
    )


def _events_vs_agg_delta() -> str:
    return f"""
      WITH ev AS ({_event_hours()}),
           agg AS (SELECT month, avg(mean_duration_sec / 3600.0) AS mean_a,
                          avg(median_duration_sec / 3600.0) AS median_a
                   FROM ({_monthly_of_events('audio')}) AS m GROUP BY month)
      SELECT {_text('month')} AS month,
             {_r('mean_h', 8)} AS mean_hour_events, {_r('mean_a', 8)} AS mean_hour_agg,
             {_r('mean_h - mean_a', 8)} AS mean_delta_hours,
             {_r('median_h', 8)} AS median_hour_events, {_r('median_a', 8)} AS median_hour_agg,
             {_r('median_h - median_a', 8)} AS median_delta_hours
      FROM ev FULL OUTER JOIN agg USING (month)"""


def _events_vs_agg_candidates() -> str:
    return f"""
      WITH ev AS ({_event_hours()}),
           agg AS (SELECT month,
                          sum(total_duration_sec) / nullif(sum(num_tracks), 0) / 3600.0 AS mean_weighted,
                          avg(mean_duration_sec) / 3600.0 AS mean_unweighted,
                          avg(median_duration_sec) / 3600.0 AS median_avg,
                          quantile_disc(median_duration_sec / 3600.0, 0.5) AS median_median,
                          max(median_duration_sec) / 3600.0 AS median_max,
                          min(median_duration_sec) / 3600.0 AS median_min
                   FROM ({_monthly_of_events('audio')}) AS m GROUP BY month)
      SELECT {_text('month')} AS month, {_r('mean_h', 8)} AS mean_events,
             {_r('mean_weighted', 8)} AS mean_weighted, {_r('mean_unweighted', 8)} AS mean_unweighted,
             {_r('median_h', 8)} AS median_events, {_r('median_avg', 8)} AS median_avg,
             {_r('median_median', 8)} AS median_median, {_r('median_max', 8)} AS median_max,
             {_r('median_min', 8)} AS median_min
      FROM ev FULL OUTER JOIN agg USING (month)"""


def _unit_ratio() -> str:
    mean = "avg(mean_duration_sec)"
    ratio = (
        f"{S.RATIO_TARGET} / avg(CASE WHEN month = DATE '{S.LOOKUP_MONTH}' THEN mean_duration_sec END)"
    )
    return (
        f"SELECT strftime(month, '%Y-%m') AS month, {_r(mean, 4)} AS avg_sec, "
        f"{_r(f'{mean} / 3600.0', 4)} AS avg_hr, {_r(f'{mean} * 1000.0', 1)} AS avg_ms, "
        f"{_r(f'{mean} / 1000.0', 4)} AS avg_if_ms, {_r(ratio, 4)} AS ratio_to_target "
        f"FROM ({_monthly('video')}) AS m WHERE {_RANGE} GROUP BY month"
    )


def _cutoff_comparison() -> str:
    early = f"SELECT * FROM ({_events('audio')}) AS e WHERE ts < TIMESTAMP '{S.CUTOFF}'"
    return f"""
      WITH {_BIN_NAMES}, base AS ({_histogram(_events('audio'))}), cut AS ({_histogram(early)}),
           all_bins AS (SELECT bin FROM base UNION SELECT bin FROM cut)
      SELECT b.bin, coalesce(base.cnt, 0) AS cnt_all, coalesce(cut.cnt, 0) AS cnt_cutoff,
             {_r('base.pct')} AS pct_all, {_r('cut.pct')} AS pct_cutoff,
             {_r('base.pct - cut.pct', 9)} AS pct_delta
      FROM all_bins AS b LEFT JOIN base ON b.bin = base.bin LEFT JOIN cut ON b.bin = cut.bin"""


def _fine_counts() -> str:
    highs = [*FINE_BINS.lower[1:], FINE_BINS.upper]
    table = ", ".join(
        f"('{label}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))"
        for label, lo, hi in zip(FINE_BINS.labels, FINE_BINS.lower, highs)
    )
    return " UNION ALL ".join(
        f"SELECT '{s}' AS source, v.label, v.lo, v.hi, count(e.duration_sec) AS count "
        f"FROM (VALUES {table}) AS v(label, lo, hi) LEFT JOIN ({_events(s)}) AS e "
        "ON e.duration_sec >= v.lo AND e.duration_sec < v.hi GROUP BY 1, 2, 3, 4"
        for s in ("audio", "video")
    )


_RUNNING_FINE = f"""
  fine AS ({_fine_counts()}),
  run AS (SELECT *, CAST(sum(count) OVER (PARTITION BY source ORDER BY lo) AS BIGINT) AS cumulative,
                 CAST(sum(count) OVER (PARTITION BY source) AS BIGINT) AS total FROM fine)"""


def _interpolated(q: float) -> str:
    return f"""
      WITH {_RUNNING_FINE},
           hit AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lo) AS rn
                   FROM run WHERE cumulative >= {q} * total)
      SELECT source, {_r(f'lo + ({q} * total - (cumulative - count)) / count * (hi - lo)')} AS median,
             label AS bin, count AS bin_count, cumulative, total
      FROM hit WHERE rn = 1"""


def _cumulative() -> str:
    return f"""
      WITH {_RUNNING_FINE}
      SELECT source, label AS bin, count, cumulative,
             {_r('CAST(cumulative AS DOUBLE) / total * 100')} AS cumulative_pct,
             cumulative >= total / 2.0 AND cumulative - count < total / 2.0 AS is_median_bin
      FROM run"""


def _target(cutoff: str = S.CUTOFF) -> str:
    rows = f"SELECT * FROM ({_events('audio')}) AS e WHERE ts < TIMESTAMP '{cutoff}'"
    return f"SELECT bin_ord, bin, pct AS target FROM ({_histogram(rows)}) AS h"


def _scenario_rows() -> str:
    in_range = f"ts >= TIMESTAMP '{S.FIRST_DAY}' AND ts < TIMESTAMP '{S.AFTER_LAST_DAY}'"
    tests = {
        "all": "true",
        "all_ge2": "duration_sec >= 2",
        "range": in_range,
        "range_ge2": f"{in_range} AND duration_sec >= 2",
        "cutoff": f"ts < TIMESTAMP '{S.CUTOFF}'",
    }
    rows = {"events": _events("audio"), "view": _view("video")}
    tagged = " UNION ALL ".join(
        f"SELECT '{source}_{name}' AS scenario, duration_sec FROM ({sql}) AS e WHERE {test}"
        for source, sql in rows.items()
        for name, test in tests.items()
    )
    return f"""
      SELECT c.scenario, n.bin, c.bin_ord, c.cnt,
             CAST(c.cnt AS DOUBLE) / sum(c.cnt) OVER (PARTITION BY c.scenario) AS pct
      FROM (SELECT scenario, {_bin_ord('duration_sec')} AS bin_ord, count(*) AS cnt
            FROM ({tagged}) AS s GROUP BY 1, 2) AS c
      JOIN bin_names AS n ON n.bin_ord = c.bin_ord"""


_SCENARIO_GRID = f"""
  {_BIN_NAMES}, scen AS ({_scenario_rows()}), target AS ({_target()}),
  grid AS (SELECT s.scenario, t.bin, t.target, coalesce(h.pct, 0.0) AS pct,
                  coalesce(h.pct, 0.0) - t.target AS delta
           FROM (SELECT DISTINCT scenario FROM scen) AS s CROSS JOIN target AS t
           LEFT JOIN scen AS h ON h.scenario = s.scenario AND h.bin = t.bin)"""


def _sweep(sources: dict[str, str], period: str, cutoff: str, start: str | None = None,
           end: str | None = None) -> str:
    """CTEs ending in ``scored``: one row per source and period with counts and scores."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS source, * FROM ({sql}) AS e" for name, sql in sources.items())
    until = f"WHERE ts < TIMESTAMP '{end}'" if end else ""
    first = f"WHERE period >= TIMESTAMP '{start}'" if start else ""
    sums = ", ".join(
        f"CAST(sum(count(*) FILTER (WHERE bin_ord = {i})) OVER w AS BIGINT) AS bin_{i}"
        for i in range(1, N_BINS + 1)
    )
    goals = ", ".join(
        f"max(target) FILTER (WHERE bin_ord = {i}) AS goal_{i}" for i in range(1, N_BINS + 1)
    )
    total = " + ".join(f"bin_{i}" for i in range(1, N_BINS + 1))
    deltas = [f"coalesce(CAST(bin_{i} AS DOUBLE) / total_rows - goal_{i}, 0.0)" for i in range(1, N_BINS + 1)]
    squares = " + ".join(f"({d}) * ({d})" for d in deltas)
    largest = ", ".join(f"abs({d})" for d in deltas)
    return f"""
      {_BIN_NAMES}, target AS ({_target(cutoff)}),
      ev AS (SELECT source, date_trunc('{period}', ts) AS period, {_bin_ord('duration_sec')} AS bin_ord
             FROM ({rows}) AS r {until}),
      run AS (SELECT source, period, {sums} FROM ev GROUP BY source, period
              WINDOW w AS (PARTITION BY source ORDER BY period)),
      counted AS (SELECT *, {total} AS total_rows FROM run),
      goals AS (SELECT {goals} FROM target),
      scored AS (SELECT source, period, period + INTERVAL 1 {period} AS cutoff, {squares} AS sse,
                        greatest({largest}) AS max_abs_diff, total_rows,
                        {', '.join(f'bin_{i}' for i in range(1, N_BINS + 1))}
                 FROM counted CROSS JOIN goals {first}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sse, period) AS rn
                 FROM scored)"""


def _shown_sweep(source: str, table: str, where: str = "") -> str:
    stamp = "'%Y-%m-%d %H:%M:%S'"
    bins = ", ".join(f"bin_{i}" for i in range(1, N_BINS + 1))
    return (
        f"SELECT {source} strftime(period, {stamp}) AS include_through, "
        f"strftime(cutoff, {stamp}) AS cutoff_exclusive, {_r('sse', 10)} AS sse, "
        f"{_r('max_abs_diff', 10)} AS max_abs_diff, total_rows, {bins} FROM {table} {where}"
    )


def _sweep_deltas() -> str:
    entries = ", ".join(f"({i}, best.bin_{i})" for i in range(1, N_BINS + 1))
    return f"""
      WITH {_sweep({'video': _events('video')}, 'hour', S.CUTOFF)},
           best AS (SELECT * FROM ranked WHERE rn = 1)
      SELECT t.bin, v.cnt, {_r('CAST(v.cnt AS DOUBLE) / best.total_rows', 9)} AS pct,
             {_r('t.target', 9)} AS target,
             {_r('CAST(v.cnt AS DOUBLE) / best.total_rows - t.target', 9)} AS delta
      FROM best, LATERAL (VALUES {entries}) AS v(bin_ord, cnt)
      JOIN target AS t ON t.bin_ord = v.bin_ord"""


def _series() -> str:
    return f"""
      series AS (SELECT strftime(month, '%Y-%m') AS key, quantile_cont(median_duration_sec, 0.5) AS value
                 FROM ({_monthly('video')}) AS m WHERE {_RANGE} GROUP BY 1),
      target AS (SELECT key, CASE WHEN key = '{S.SHIFTED_KEY}' THEN value + 1.0 ELSE value END AS target
                 FROM series),
      got AS (SELECT key, value AS got FROM series WHERE key <> '{S.MISSING_KEY}'),
      compared AS (SELECT key, got, target, got - target AS delta,
                          got IS NULL OR abs(got - target) > {S.SERIES_TOLERANCE} AS mismatch
                   FROM target LEFT JOIN got USING (key))"""


def _users_of_range() -> str:
    counts = ", ".join(
        f"count(DISTINCT CASE WHEN event_type = '{kind}' THEN user_id END) AS active_{label}"
        for label, kind in EVENT_TYPES.items()
    )
    kinds = ", ".join(f"'{k}'" for k in EVENT_TYPES.values())
    return (
        f"SELECT {counts}, count(DISTINCT user_id) AS total_active FROM events WHERE event_type IN ({kinds}) "
        f"AND value >= 2.0 AND CAST(ts AS DATE) BETWEEN DATE '{S.FIRST_DAY}' AND DATE '{S.AFTER_LAST_DAY}'"
    )


_SOURCE_OF_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for s, k in EVENT_TYPES.items()) + " END"
_SOURCE_OF_ORDER = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{s}'" for s, k in ORDER_STATUS.items()) + " END"


def _rewritten_day() -> str:
    return f"""
      SELECT strftime(ts, '%Y%m%d') AS event_date, source, count(*) AS events,
             {_r('sum(value * value)', 4)} AS total_duration_sec
      FROM (SELECT *, {_SOURCE_OF_EVENT} AS source FROM events) AS e
      WHERE source IS NOT NULL
        AND (strftime(ts, '%Y%m%d') <> '{S.REWRITTEN_DAY}' OR ts < TIMESTAMP '{S.CUTOFF}')
      GROUP BY 1, 2"""


def _shard_countries() -> str:
    return f"""
      SELECT {_SOURCE_OF_EVENT} AS source, coalesce(n_name, '') AS country, count(*) AS num_tracks,
             {_r('sum(value * value)', 4)} AS total_duration_sec, count(DISTINCT CAST(ts AS DATE)) AS days
      FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      WHERE {_SOURCE_OF_EVENT} IS NOT NULL GROUP BY 1, 2"""


def _sketched_medians() -> str:
    rows = f"""
      SELECT {_SOURCE_OF_ORDER} AS source, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
             coalesce(n_name, '') AS country, o_totalprice AS x
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderstatus IN ({', '.join(f"'{k}'" for k in ORDER_STATUS.values())})"""
    keys = {"month": ("source", "month"), "country": ("source", "country"), "source": ("source",), "all": ()}
    parts = []
    for level, kept in keys.items():
        shown = ", ".join(k if k in kept else f"CAST(NULL AS VARCHAR) AS {k}" for k in ("source", "month", "country"))
        grouped = f"GROUP BY {', '.join(kept)}" if kept else ""
        parts.append(
            f"SELECT '{level}' AS level, {shown}, count(x) AS n, {_r('min(x)', 4)} AS lowest, "
            f"{_r('max(x)', 4)} AS highest, true AS within FROM recorded {grouped}"
        )
    return f"WITH recorded AS ({rows}) {' UNION ALL '.join(parts)}"


def _snapshot_labels(day_range: str) -> str:
    short = (
        f"SELECT * FROM ({_events('audio')}) AS e "
        f"WHERE duration_sec < {S.SNAPSHOT_LONGEST} AND ts < TIMESTAMP '{S.CUTOFF}'"
    )
    return f"""
      WITH {_BIN_NAMES}, days AS ({_histogram(day_range)}), short AS ({_histogram(short)}),
           labels AS (SELECT bin FROM days UNION SELECT bin FROM short)
      SELECT l.bin, coalesce(days.cnt, 0) AS cnt_days, coalesce(short.cnt, 0) AS cnt_short,
             {_r('days.pct')} AS pct_days, {_r('short.pct')} AS pct_short,
             {_r('days.pct - short.pct', 9)} AS pct_delta
      FROM labels AS l LEFT JOIN days ON days.bin = l.bin LEFT JOIN short ON short.bin = l.bin"""


def oracle_sql() -> dict[str, str]:
    audio = {"events": _events("audio")}
    two = {"events": _events("audio"), "view": _view("video")}
    day_range = (
        f"SELECT * FROM ({_events('audio')}) AS e WHERE CAST(ts AS DATE) >= DATE '{S.FIRST_DAY}' "
        f"AND CAST(ts AS DATE) < DATE '{S.AFTER_LAST_DAY}'"
    )
    kinds = ", ".join(f"'{k}'" for k in EVENT_TYPES.values())
    user_counts = [f"active_{s}_users" for s in SOURCES] + ["total_active_users"]
    return {
        "active_users_from_events": _active_from_events("month"),
        "active_users_from_events_by_day": _active_from_events("day"),
        "event_parameter_rows": (
            "SELECT event_type AS event_name, count(*) AS parameters, "
            "count(*) FILTER (WHERE event_id % 2 = 0) AS typed_double, "
            "count(*) FILTER (WHERE event_id % 2 <> 0) AS typed_string, "
            f"{_r('max(value) FILTER (WHERE event_id % 2 = 0)')} AS largest_double "
            "FROM events GROUP BY 1"
        ),
        "distinct_user_months": (
            "SELECT DISTINCT strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, "
            f"CAST(user_id AS VARCHAR) AS user FROM events WHERE event_type IN ({kinds}) AND value >= 2.0"
        ),
        "active_users_from_bitmaps": _active_from_events("month"),
        "active_users_of_range": _users_of_range(),
        "active_users_by_month": (
            f"SELECT {_text()} AS month, "
            + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in user_counts)
            + f" FROM ({_users()}) AS u WHERE CAST(month AS VARCHAR) >= '{S.SINCE}' GROUP BY 1"
        ),
        "active_users_lookup": (
            f"SELECT {_text()} AS month, country, {', '.join(user_counts)} FROM ({_users()}) AS u "
            f"WHERE month = DATE '{S.LOOKUP_MONTH}' AND country = '{S.LOOKUP_COUNTRY}'"
        ),
        "recording_totals_by_month": _totals_by_month(),
        "recording_grand_totals": _grand_totals(),
        "recording_lookup_by_source": _lookup_by_source(),
        "three_source_vs_reference_delta": _three_sources(),
        "numeric_totals_by_month": _transfer_totals(True, 4),
        "numeric_totals_of_recordings": _recording_totals(),
        "numeric_grand_totals": _transfer_totals(False, 2),
        "six_source_trend": _trend(),
        "top_countries": (
            f"SELECT {_text()} AS month, country, num_tracks, "
            f"{_r('mean_duration_sec', 4)} AS mean_duration_sec, "
            f"{_r('median_duration_sec', 4)} AS median_duration_sec, "
            f"{_r('total_duration_sec', 4)} AS total_duration_sec FROM ({_monthly('video')}) AS m "
            f"WHERE m.month = DATE '{S.LOOKUP_MONTH}' ORDER BY num_tracks DESC, country LIMIT 5"
        ),
        "ordered_sample": (
            f"SELECT {_text('m.month')} AS month, country, num_tracks, "
            + ", ".join(
                f"{_r(f'{d}_duration_sec', 4)} AS {d}_duration_sec"
                for d in ("total", "min", "max", "mean", "stddev", "median")
            )
            + f", num_lossless FROM ({_monthly('audio')}) AS m ORDER BY m.month, country LIMIT 10"
        ),
        "max_hours_by_month_agg": (
            f"SELECT {_text()} AS month, {_r('max(max_duration_sec) / 3600.0', 8)} AS max_duration_hour "
            f"FROM ({_monthly('audio')}) AS m GROUP BY 1"
        ),
        "max_hours_by_month_agg_filtered": (
            f"SELECT {_text()} AS month, {_r('max(max_duration_sec) / 3600.0', 8)} AS max_duration_hour "
            f"FROM ({_monthly('video')}) AS m WHERE {_RANGE} GROUP BY 1"
        ),
        "max_hours_by_month_events": (
            "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, "
            f"{_r('max(duration_sec) / 3600.0', 8)} AS max_duration_hour FROM ({_events('audio')}) AS e GROUP BY 1"
        ),
        "max_hours_by_day_events": (
            "SELECT strftime(ts, '%Y-%m-%d') AS period, "
            f"{_r('max(duration_sec) / 3600.0', 8)} AS max_duration_hour FROM ({_events('audio')}) AS e GROUP BY 1"
        ),
        "mean_approx_median_by_month": _mean_median("audio", "quantile_disc(median_duration_sec, 0.5)"),
        "mean_exact_median_by_month": _mean_median("audio", "quantile_cont(median_duration_sec, 0.5)"),
        "mean_median_aggregate_form": _mean_median("video", "median(median_duration_sec)"),
        "mean_weighted_vs_unweighted": (
            f"SELECT strftime(month, '%Y-%m') AS month, {_r('avg(mean_duration_sec)', 6)} AS mean_avg, "
            f"{_r('sum(total_duration_sec) / sum(num_tracks)', 6)} AS mean_weighted, "
            f"{_r('quantile_cont(median_duration_sec, 0.5)', 6)} AS median_p50 "
            f"FROM ({_monthly('video')}) AS m WHERE {_RANGE} GROUP BY 1"
        ),
        "weighted_mean_two_sources": " UNION ALL ".join(
            f"SELECT '{s}' AS source, strftime(month, '%Y-%m') AS month, "
            f"{_r('sum(total_duration_sec) / sum(num_tracks)', 6)} AS mean_duration_sec "
            f"FROM ({_monthly(s)}) AS m GROUP BY 2"
            for s in ("audio", "video")
        ),
        "event_stats_by_month": _shown_event_stats("video", "month"),
        "event_stats_by_day": _shown_event_stats("video", "day"),
        "event_stats_by_hour": _shown_event_stats("audio", "hour", "%Y-%m-%d %H:%M:%S"),
        "event_stats_side_by_side": _side_by_side(),
        "events_vs_agg_delta": _events_vs_agg_delta(),
        "events_vs_agg_candidates": _events_vs_agg_candidates(),
        "bare_limit": (
            f"SELECT least(count(*), {S.SAMPLE_ROWS}) AS rows, 3 AS columns, least(count(*), {S.SAMPLE_ROWS}) AS complete "
            "FROM events HAVING count(*) = count(event_id) AND count(*) = count(event_type) AND count(*) = count(value)"
        ),
        "rewritten_day": _rewritten_day(),
        "sketched_medians": _sketched_medians(),
        "shard_histogram_date_range": _shown_histogram(day_range),
        "shard_histogram_cutoff": _shown_histogram(
            f"SELECT * FROM ({_events('audio')}) AS e WHERE ts < TIMESTAMP '{S.CUTOFF}'"
        ),
        "shard_event_stats_by_day": _shown_event_stats("audio", "day"),
        "shard_cutoff_sweep_hourly": (
            f"WITH {_sweep(audio, 'hour', S.CUTOFF)} {_shown_sweep('', 'ranked', 'WHERE rn = 1')}"
        ),
        "shard_countries": _shard_countries(),
        "histogram_snapshot_labels": _snapshot_labels(day_range),
        "unit_ratio_check": _unit_ratio(),
        "duration_histogram": _shown_histogram(_events("audio")),
        "duration_histogram_view": _shown_histogram(_view("video")),
        "duration_histogram_date_range": _shown_histogram(day_range),
        "duration_histogram_cutoff": _shown_histogram(
            f"SELECT * FROM ({_events('audio')}) AS e WHERE ts < TIMESTAMP '{S.CUTOFF}'"
        ),
        "duration_histogram_cutoff_view": _shown_histogram(
            f"SELECT * FROM ({_view('video')}) AS e WHERE ts < TIMESTAMP '{S.CUTOFF}'"
        ),
        "histogram_from_aggregate": _shown_histogram(
            _monthly("video"), "mean_duration_sec", "sum(num_tracks)"
        ),
        "histogram_cutoff_comparison": _cutoff_comparison(),
        "fine_bin_counts": _fine_counts(),
        "interpolated_median": _interpolated(0.5),
        "interpolated_quartile": _interpolated(0.25),
        "cumulative_distribution": _cumulative(),
        "histogram_scenarios": (
            f"WITH {_BIN_NAMES} SELECT scenario, bin, bin_ord, cnt, {_r('pct')} AS pct "
            f"FROM ({_scenario_rows()}) AS s"
        ),
        "scenario_scores": (
            f"WITH {_SCENARIO_GRID} SELECT scenario, {_r('sum(delta * delta)', 10)} AS sse, "
            f"{_r('max(abs(delta))', 10)} AS max_abs_diff FROM grid GROUP BY scenario"
        ),
        "scenario_deltas": (
            f"WITH {_SCENARIO_GRID} SELECT scenario, bin, {_r('pct', 9)} AS pct, "
            f"{_r('delta', 9)} AS delta FROM grid"
        ),
        "cutoff_sweep_hourly": (
            f"WITH {_sweep(audio, 'hour', S.CUTOFF)} {_shown_sweep('', 'ranked', 'WHERE rn = 1')}"
        ),
        "cutoff_sweep_hourly_deltas": _sweep_deltas(),
        "cutoff_sweep_detail": (
            f"WITH {_sweep({'audio': _events('audio')}, 'day', S.CUTOFF)} "
            f"{_shown_sweep('source,', 'scored')}"
        ),
        "cutoff_sweep_sources": (
            f"WITH {_sweep(two, 'hour', S.CUTOFF)} {_shown_sweep('source,', 'ranked', 'WHERE rn = 1')}"
        ),
        "cutoff_refine_seconds": (
            f"WITH {_sweep(audio, 'second', S.SECOND_CUTOFF, S.REFINE_START, S.REFINE_END)} "
            f"{_shown_sweep('', 'ranked', 'WHERE rn = 1')}"
        ),
        "series_compare": (
            f"WITH {_series()} SELECT key, {_r('got', 4)} AS got, {_r('target', 4)} AS target, "
            f"{_r('delta', 4)} AS delta, mismatch FROM compared"
        ),
        "series_compare_summary": (
            f"WITH {_series()} SELECT bool_and(NOT mismatch) AS overall_match, count(*) AS compared, "
            "count(*) FILTER (WHERE mismatch) AS mismatches, "
            f"{_r('max(abs(delta))', 4)} AS max_abs_delta FROM compared"
        ),
        "histogram_compare": (
            f"WITH {_BIN_NAMES}, got AS ({_histogram(_view('audio'))}), target AS ({_target()}) "
            f"SELECT t.bin, {_r('got.pct', 9)} AS got, {_r('t.target', 9)} AS target, "
            f"{_r('got.pct - t.target', 9)} AS delta, "
            "got.pct IS NULL OR abs(got.pct - t.target) > 0.001 AS mismatch "
            "FROM target AS t LEFT JOIN got ON got.bin = t.bin"
        ),
    }
