"""Scan lookups, calendars, trends and overviews."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.filters import date_bounds
from tempora.functions.paths import natural_key
from tempora.operators.domains import page
from tempora.operators.review import has_hash_issue, has_val_issue, with_suspects
from tempora.plans.windows import with_running
from tempora.schemas import COMPLETED, State

AXIS_SPAN = 2 * 86_400
TREND_COUNTERS = ("file_count", "folder_count", "total_size", "add_count", "modify_count", "delete_count",
                  "new_val_invalid_count", "val_invalid_count", "new_hash_suspect_count", "hash_suspect_count")


def completed(scans: DataFrame) -> DataFrame:
    return scans.where(F.col("state") == COMPLETED)


def latest_scans(scans: DataFrame) -> DataFrame:
    """Newest scan of each root in whatever state."""
    cols = [c for c in scans.columns if c != "root_id"]
    return scans.groupBy("root_id").agg(F.max_by(F.struct(*cols), "scan_id").alias("_s")) \
        .select("root_id", "_s.*")


def scan_or_latest(scans: DataFrame, scan_id: int | None = None) -> DataFrame:
    """The given scan, else the newest of all, as one row."""
    if scan_id is not None:
        return scans.where(F.col("scan_id") == scan_id)
    return scans.agg(F.max_by(F.struct(*scans.columns), "scan_id").alias("_s")).select("_s.*")


def resolve_scan(scans: DataFrame, root_id: int, day: str | None = None, zone: str = "UTC") -> DataFrame:
    """Latest completed scan started by the end of a day (by start time); without one, by scan id."""
    rows = completed(scans).where(F.col("root_id") == root_id)
    if day is None:
        return rows.agg(F.max("scan_id").alias("scan_id"))
    _, end = date_bounds(day, zone)
    return rows.where(F.col("started_at") <= end).agg(F.max_by("scan_id", "started_at").alias("scan_id"))


def resolve_scans(scans: DataFrame, asked: DataFrame) -> DataFrame:
    """``resolve_scan`` for a table of (root_id, until): the last completed scan started by then.

    Requests and scans are merged on one time axis per root and the last scan is carried forward,
    so no request is paired with more than one scan.
    """
    marks = completed(scans).select("root_id", (F.col("started_at") * 2).alias("_at"), "scan_id")
    asks = asked.select("root_id", (F.col("until") * 2 + 1).alias("_at")).distinct().withColumn(
        "scan_id", F.lit(None).cast("long"))
    merged = with_running(marks.unionByName(asks), ["root_id"], "_at", AXIS_SPAN,
                          lasts={"_found": F.col("scan_id")})
    found = merged.where(F.col("_at") % 2 == 1).select(
        "root_id", F.floor(F.col("_at") / 2).alias("until"), F.col("_found").alias("scan_id"))
    return asked.join(found, ["root_id", "until"], "left")


def scan_dates_in_month(scans: DataFrame, root_id: int, year: int, month: int, zone: str = "UTC") -> DataFrame:
    """Distinct local days of a month with a completed scan."""
    first = date(year, month, 1)
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    lo, hi = date_bounds((first.isoformat(), last.isoformat()), zone)
    day = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc(F.col("started_at"))), "yyyy-MM-dd")
    return completed(scans).where(
        (F.col("root_id") == root_id) & F.col("started_at").between(lo, hi)
    ).select(day.alias("day")).distinct()


def _utc(epoch: Column) -> Column:
    """Wall-clock time in UTC of an epoch second, whatever the session time zone."""
    return F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def scans_on_date(scans: DataFrame, root_id: int, day: str, zone: str = "UTC") -> DataFrame:
    lo, hi = date_bounds(day, zone)
    return completed(scans).where(
        (F.col("root_id") == root_id) & F.col("started_at").between(lo, hi)
    ).select("scan_id", "started_at", "add_count", "modify_count", "delete_count").orderBy(F.desc("started_at"))


def scan_history(scans: DataFrame, root_id: int) -> DataFrame:
    """Completed scans newest first, missing counters as 0."""
    rows = completed(scans).where(F.col("root_id") == root_id)
    counters = [c for c in rows.columns if c.endswith("_count") or c == "total_size"]
    return rows.fillna(0, counters).orderBy(F.desc("started_at"))


def trend(scans: DataFrame, root_id: int, first_day: str | None = None, last_day: str | None = None,
          zone: str = "UTC") -> DataFrame:
    """Completed scans of a window, oldest first, with derived unchanged counts."""
    rows = completed(scans).where(F.col("root_id") == root_id)
    if first_day and last_day:
        date_bounds((first_day, last_day), zone)  # a window that ends before it starts is an error
    if first_day:
        rows = rows.where(F.col("started_at") >= date_bounds(first_day, zone)[0])
    if last_day:
        rows = rows.where(F.col("started_at") <= date_bounds(last_day, zone)[1])
    rows = rows.fillna(0, list(TREND_COUNTERS))
    unchanged = F.col("file_count") + F.col("folder_count") - F.col("add_count") - F.col("modify_count")
    return rows.select("scan_id", "root_id", "started_at", *TREND_COUNTERS,
                       unchanged.alias("unchanged_count")).orderBy("started_at")


PRESETS = ("7d", "30d", "3m", "6m", "1y")  # fixed values: trend windows


def preset_window(preset: str, today: Column) -> tuple[Column, Column]:
    """(from, to) dates of a window that ends on the given day; months clamp to their last day."""
    starts = {
        "7d": F.date_sub(today, 7), "30d": F.date_sub(today, 30),
        "3m": F.add_months(today, -3), "6m": F.add_months(today, -6), "1y": F.add_months(today, -12),
    }
    return starts[preset], today


def without_first_scan(series: DataFrame, scans: DataFrame) -> DataFrame:
    """Drop each root's first completed scan, whose adds dwarf everything else."""
    first = completed(scans).groupBy("root_id").agg(F.min("scan_id").alias("scan_id"))
    return series.join(first, ["root_id", "scan_id"], "left_anti")


def with_visible_values(series: DataFrame, shown: Sequence[str]) -> DataFrame:
    """Keep scans where at least one of the shown counters is above zero."""
    return series.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in shown], F.lit(False)))


def scan_changes_list(state: State, scan_id: int, change: str = "all") -> DataFrame:
    """Versions created by a scan, all or only added / deleted / modified ones by their flags."""
    # a scan is of one root: its row prunes the partitions of versions and items
    root = F.broadcast(state.scans.where(F.col("scan_id") == scan_id).select("root_id"))
    rows = state.versions.where(F.col("first_scan_id") == scan_id).join(root, "root_id", "left_semi")
    kinds = {
        "all": F.lit(True), "added": F.col("is_added"), "deleted": F.col("is_deleted"),
        "modified": ~F.col("is_added") & ~F.col("is_deleted"),
    }
    return rows.where(kinds[change]).join(
        state.items.select("root_id", "item_id", "item_path", "item_type"), ["root_id", "item_id"]
    ).select("item_id", "item_path", "item_type", "is_added", "is_deleted", "size")


def count_scan_changes(state: State, scan_id: int, change: str = "all") -> DataFrame:
    """How many rows ``scan_changes_list`` has."""
    return scan_changes_list(state, scan_id, change).agg(F.count(F.lit(1)).alias("count"))


def scan_changes_page(state: State, scan_id: int, limit: int, offset: int = 0, change: str = "all") -> DataFrame:
    """A page of ``scan_changes_list`` by path."""
    return page(scan_changes_list(state, scan_id, change).orderBy("item_path", "item_id"), limit, offset)


def root_overview(state: State) -> DataFrame:
    """Every root with its newest scan, whatever its state."""
    newest = latest_scans(state.scans).select(
        "root_id", "scan_id", "started_at", "state", "file_count", "folder_count", "total_size")
    return state.roots.join(newest, "root_id", "left")


def root_overview_page(state: State, limit: int, offset: int = 0) -> DataFrame:
    """A page of ``root_overview`` in natural order of the root paths."""
    return page(root_overview(state).orderBy(natural_key(F.col("root_path")), "root_id"), limit, offset)


def open_issue_counts(state: State) -> DataFrame:
    """Distinct items with unreviewed hash and validation issues."""
    rows = with_suspects(state.versions, state.hashes)
    return rows.agg(
        F.count_distinct(F.when(has_hash_issue() & F.col("hash_reviewed_at").isNull(), F.col("item_id")))
        .alias("hash_issues"),
        F.count_distinct(F.when(has_val_issue() & F.col("val_reviewed_at").isNull(), F.col("item_id")))
        .alias("val_issues"))


def roots_with_schedules(state: State) -> DataFrame:
    """Roots with their newest scan and the number of enabled, live schedules."""
    live = state.schedules.where(F.col("enabled") & F.col("deleted_at").isNull()).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("schedule_count"))
    return root_overview(state).join(live, "root_id", "left").fillna(0, ["schedule_count"])

