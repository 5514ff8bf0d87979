"""Build-id and date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

BUILD_FMT = "%Y%m%d"
#: Partition column of a ping table written by ``sinks.write_pings``.
BUILD_DAY = "build_day"


def window_bounds(final_date: dt.date, num_days: int) -> tuple[str, str]:
    """(start, end) of the build window as 'yyyyMMdd' strings; start = final - num_days."""
    start = final_date - dt.timedelta(days=num_days)
    return start.strftime(BUILD_FMT), final_date.strftime(BUILD_FMT)


def next_day(day: str) -> str:
    d = dt.datetime.strptime(day, BUILD_FMT).date() + dt.timedelta(days=1)
    return d.strftime(BUILD_FMT)


def build_day(col: str | Column = "app_build_id") -> Column:
    """A build id truncated to its day (first 8 characters)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, 8)


def build_date(col: str | Column = "app_build_id") -> Column:
    """P9: 'yyyyMMdd…' build id to a DATE (NULL when it does not parse)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(F.substring(c, 1, 8), "yyyyMMdd")


def window_predicate(final_date: dt.date, num_days: int, inclusive_end: bool = False,
                     col: str = "app_build_id") -> Column:
    """The build window on the raw (untruncated) id, so parquet min/max stats apply.

    As written the upper bound 'yyyyMMdd' is compared with the full id, so ids longer
    than 8 characters of the final day fall out (quirk Q3). ``inclusive_end`` keeps the
    final day with an exclusive bound on the next day, which is still a plain range
    predicate that pushes down to the scan.
    """
    start, end = window_bounds(final_date, num_days)
    c = F.col(col)
    if inclusive_end:
        return (c >= F.lit(start)) & (c < F.lit(next_day(end)))
    return (c >= F.lit(start)) & (c <= F.lit(end))


def day_predicate(final_date: dt.date, num_days: int, col: str = BUILD_DAY) -> Column:
    """The build window on the build day (first 8 characters of the id). Every id in the window
    of ``window_predicate`` meets it, whichever end it uses: a prefix sorts before the whole."""
    start, end = window_bounds(final_date, num_days)
    return (F.col(col) >= F.lit(start)) & (F.col(col) <= F.lit(end))
