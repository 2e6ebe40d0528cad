"""As-of and temporal lookups over versions and hash observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.history import current_versions, sized_calendar
from tempora.plans.windows import with_neighbours
from tempora.schemas import DIRECTORY

__all__ = ["current_versions"]


def with_is_current(versions: DataFrame) -> DataFrame:
    """Flag the newest version of each item (deleted ones included), before any filter."""
    # an item has at most one version per scan of its root
    key = [c for c in ("root_id", "item_id") if c in versions.columns]
    newest = F.max("first_scan_id").over(Window.partitionBy(*key))
    return versions.withColumn("is_current", F.col("first_scan_id") == newest)


def version_in_force(versions: DataFrame, scan_id: int) -> DataFrame:
    """Per item the version with the greatest first_scan_id not after ``scan_id``."""
    cols = [c for c in versions.columns if c != "item_id"]
    return (
        versions.where(F.col("first_scan_id") <= scan_id)
        .groupBy("item_id").agg(F.max_by(F.struct(*cols), "first_scan_id").alias("_v"))
        .select("item_id", "_v.*")
    )


def snapshot_at(versions: DataFrame, scan_id: int) -> DataFrame:
    """What a scan showed: everything alive, and what that very scan deleted."""
    return version_in_force(versions, scan_id).where(
        ~F.col("is_deleted") | (F.col("first_scan_id") == scan_id))


def snapshots_at(
    versions: DataFrame, wanted: DataFrame, scans: DataFrame, span: int | None = None
) -> DataFrame:
    """``snapshot_at`` for many completed scans at once (``wanted``: root_id, scan_id).

    Every version is in force from its first ordinal to the one before the next version's, so it is
    laid out over exactly the scans that show it; no version is paired with scans it cannot serve.
    """
    cal, bound = sized_calendar(scans)
    cal, span = cal.select("root_id", "scan_id", "ord"), span or bound
    placed = versions.join(
        cal.withColumnRenamed("scan_id", "first_scan_id"), ["root_id", "first_scan_id"])
    placed = with_neighbours(placed, ["item_id"], "ord", ["ord"], span, prev=None)
    until = (
        F.when(F.col("is_deleted"), F.col("ord"))
        .when(F.col("next").isNotNull(), F.col("next")["ord"] - 1).otherwise(F.col("_end"))
    )
    ends = cal.groupBy("root_id").agg(F.max("ord").alias("_end"))
    laid = placed.join(ends, "root_id").withColumn(
        "ord", F.explode(F.sequence(F.col("ord"), until))).drop("next", "_end")
    # at most one wanted row per completed scan: as small as the calendar
    return laid.join(wanted.join(cal, ["root_id", "scan_id"]), ["root_id", "ord"]) \
        .select("root_id", "scan_id", *[c for c in versions.columns if c != "root_id"])


def containing(versions: DataFrame, scan_id: int) -> DataFrame:
    """Versions whose interval contains the scan."""
    return versions.where((F.col("first_scan_id") <= scan_id) & (F.col("last_scan_id") >= scan_id))


def alive_at_latest(versions: DataFrame, scan_id: int) -> DataFrame:
    """Shortcut valid for a root's newest scan only: one pushed-down equality filter."""
    return versions.where((F.col("last_scan_id") == scan_id) & ~F.col("is_deleted"))


def latest_hashes(hashes: DataFrame, as_of: int | None = None) -> DataFrame:
    """Newest hash observation of each version, optionally not after a scan."""
    rows = hashes if as_of is None else hashes.where(F.col("first_scan_id") <= as_of)
    return rows.groupBy("item_id", "item_version").agg(
        F.max_by(F.struct(F.col("first_scan_id").alias("hash_first_scan_id"),
                          F.col("last_scan_id").alias("hash_last_scan_id"),
                          "file_hash", "hash_state"), "first_scan_id").alias("_h")
    ).select("item_id", "item_version", "_h.*")


def with_latest_hash(versions: DataFrame, hashes: DataFrame, as_of: int | None = None) -> DataFrame:
    return versions.join(latest_hashes(hashes, as_of), ["item_id", "item_version"], "left")


def with_previous(versions: DataFrame, cols: Sequence[str], span: int | None = None) -> DataFrame:
    """Add ``prev``, the struct of ``cols`` of the version before, per item."""
    return with_neighbours(versions, ["item_id"], "first_scan_id", cols, span, next=None)


def change_kind(scan_id: int):
    """deleted / added / modified / unchanged as seen at a scan."""
    here = F.col("first_scan_id") == scan_id
    return (
        F.when(F.col("is_deleted"), "deleted").when(here & F.col("is_added"), "added")
        .when(here, "modified").otherwise("unchanged")
    )


def with_change_view(snapshot: DataFrame, scan_id: int) -> DataFrame:
    """Add ``change_kind`` and the folder counters as that scan saw them."""
    kind = change_kind(scan_id)
    quiet = (kind == "unchanged") & (F.col("item_type") == DIRECTORY)
    total = sum((F.coalesce(F.col(c), F.lit(0))
                 for c in ("add_count", "modify_count", "unchanged_count")), F.lit(0))
    out = {"change_kind": kind}
    for c in ("add_count", "modify_count", "delete_count"):
        out[c] = F.when(quiet, 0).otherwise(F.col(c))
    out["unchanged_count"] = F.when(quiet, total).otherwise(F.col("unchanged_count"))
    return snapshot.withColumns(out)


def visible(hidden: Sequence[str]):
    """Own kind not hidden, or a folder holding descendants of a kind not hidden."""
    own = ~F.col("change_kind").isin(*hidden) if hidden else F.lit(True)
    counters = {"added": "add_count", "modified": "modify_count", "deleted": "delete_count",
                "unchanged": "unchanged_count"}
    inside = F.lit(False)
    for kind, c in counters.items():
        if kind not in hidden:
            inside = inside | (F.coalesce(F.col(c), F.lit(0)) > 0)
    return own | ((F.col("item_type") == DIRECTORY) & inside)
