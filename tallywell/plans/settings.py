"""Parameters of the registered queries, shared with the SQL they are checked against."""

SINCE = "1996-01"
SINCE_DAY = "1996-01-01"
FIRST_MONTH = "1996-01-01"  # month ranges include both ends
LAST_MONTH = "1999-12-01"
AFTER_LAST_MONTH = "2000-01-01"
LOOKUP_MONTH = "1997-05-01"
LOOKUP_NEXT = "1997-06-01"
LOOKUP_COUNTRY = "NATION_3"
RATIO_TARGET = 6_250_000.0

FIRST_DAY = "2024-01-08"
AFTER_LAST_DAY = "2024-01-22"
CUTOFF = "2024-01-20 07:00:00"
SECOND_CUTOFF = "2024-01-20 12:34:56"
REFINE_START = "2024-01-20 00:00:00"
REFINE_END = "2024-01-21 00:00:00"

SHIFTED_KEY = "1997-03"
MISSING_KEY = "1998-02"
SERIES_TOLERANCE = 1e-6

FIRST_SHARD = "20240108"
LAST_SHARD = "20240121"
REWRITTEN_DAY = "20240120"  # the day of CUTOFF
#: Rows of the events per file of a day's shard.
SHARD_ROWS = 20_000_000
SNAPSHOT_LONGEST = 28_800.0
SAMPLE_ROWS = 7

# Results are rounded to ``places`` decimals for comparison. Exact halves would go
# either way on the last bit, so both sides first add this part of the last place.
HALF_GUARD = 0.0137


def guard(places: int) -> str:
    return f"{HALF_GUARD * 10 ** -places:.3e}"
