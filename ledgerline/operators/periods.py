"""Named periods: tables of starts turned into ranges, and events placed in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_month(at: Column, zone: str) -> Column:
    """YYYY-MM of a UTC time in a named zone."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM")


def lead_periods(starts: DataFrame, start: str, end: str) -> DataFrame:
    """A table of starts, a few rows entered by hand, with the start after each (null for the last)."""
    return starts.withColumn(end, F.lead(start).over(W.orderBy(start)))


def place(events: DataFrame, periods: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    """events with the period that holds `at`: start <= at < end. Periods don't overlap, so each event stays one row.

    Period tables are entered by hand; more than 10,000 rows are refused rather than broadcast.
    """
    if periods.limit(10_001).count() > 10_000:
        raise ValueError("too many periods for a hand-entered table")
    return events.join(F.broadcast(periods), (at >= F.col(start)) & (F.col(end).isNull() | (at < F.col(end))), "left")
