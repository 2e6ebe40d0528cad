"""Snapshots from ordinary event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def day_number(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def month_number(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def snapshots_from_events(events: DataFrame, root: Column, key: Column, period: Column,
                          **attrs: Column) -> DataFrame:
    """One observation per (root, key, period); the aggregates combine before the shuffle."""
    return events.groupBy(root.alias("root"), key.alias("key"), period.alias("period")).agg(
        *[c.alias(n) for n, c in attrs.items()])
