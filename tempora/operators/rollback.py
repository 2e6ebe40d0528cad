"""Undoing a scan and removing a root: filters and conditional updates over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.changefeed import undo_changes
from tempora.operators.history import previous_completed_scan
from tempora.schemas import ERRORED, STOPPED, State


def roll_back(state: State, scan_id: int, error: str | None = None,
              before: State | None = None) -> State:
    """The store without everything one scan did.

    With ``before`` (the published store the scan started from) the earlier ``last_scan_id`` values
    are taken from it.  Otherwise the completed scan before is used, which is the same wherever
    every scan that saw a row extended it; hashes are only extended by hashing scans, so theirs fall
    back to the previous completed hashing scan.
    """
    undone_versions = state.versions.where(F.col("first_scan_id") != scan_id)
    undone_hashes = state.hashes.where(F.col("first_scan_id") != scan_id)
    if before is not None:
        versions = _restore(undone_versions, before.versions, ["item_id", "item_version"])
        hashes = _restore(undone_hashes, before.hashes, ["item_id", "item_version", "first_scan_id"])
    else:
        prev = previous_completed_scan(state.scans).where(F.col("scan_id") == scan_id)
        hashing = state.scans.withColumn("state", F.when(
            F.col("is_hash") | (F.col("scan_id") == scan_id), F.col("state")).otherwise(0))
        prev_hash = previous_completed_scan(hashing).where(F.col("scan_id") == scan_id)
        versions = _fall_back(undone_versions, prev, scan_id)
        hashes = _fall_back(undone_hashes, prev_hash, scan_id)
    late = F.coalesce(F.col("val_scan_id") > F.col("last_scan_id"), F.lit(False))
    versions = versions.withColumns({
        c: F.when(~late, F.col(c)) for c in ("val_state", "val_error", "val_scan_id")
    }).select(*state.versions.columns)
    items = state.items.join(versions.select("item_id"), "item_id", "left_semi")
    return state.with_(versions=versions, hashes=hashes, items=items, scans=_ended(state.scans, scan_id, error))


def undo_scan(state: State, changes: dict[str, DataFrame], scan_id: int, error: str | None = None) -> State:
    """The store without one scan, from the changes recorded when its version was published.

    Exact for every column of items, versions and hashes: each changed row gets its earlier self.  The
    scan itself stays as a stopped or failed one.  ``changefeed.overtaken`` tells beforehand whether
    later scans have changed the same rows.
    """
    kept = {n: c for n, c in changes.items() if n in ("items", "versions", "hashes")}
    return undo_changes(state, kept).with_(scans=_ended(state.scans, scan_id, error))


def _ended(scans: DataFrame, scan_id: int, error: str | None) -> DataFrame:
    hit = F.col("scan_id") == scan_id
    return scans.withColumns({
        "state": F.when(hit, F.lit(STOPPED if error is None else ERRORED)).otherwise(F.col("state")),
        "total_size": F.when(~hit, F.col("total_size")),
        "error": F.when(hit, F.lit(error)).otherwise(F.col("error")),
    })


def _fall_back(rows: DataFrame, prev: DataFrame, scan_id: int) -> DataFrame:
    """Rows that end at the scan end at the one before it; ``prev`` is a single row."""
    last = F.col("last_scan_id")
    back = F.broadcast(prev.select("root_id", F.col("prev_scan_id").alias("_prev")))
    return rows.join(back, "root_id", "left").withColumn(
        "last_scan_id", F.when(last == scan_id, F.col("_prev")).otherwise(last)).select(*rows.columns)


def _restore(rows: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    past = old.select(*key, F.col("last_scan_id").alias("_past"))
    return rows.join(past, key, "left").withColumn(
        "last_scan_id", F.coalesce("_past", "last_scan_id")).drop("_past").select(*rows.columns)


def delete_root(state: State, root_id: int) -> State:
    """The store without a root and all that hangs on it; tasks and schedules included.

    Refuse first where ``has_running_task`` finds one.
    """
    return State(**{n: df.where(F.col("root_id") != root_id)
                    if n != "tasks" else df.where(~F.col("root_id").eqNullSafe(F.lit(root_id)))
                    for n, df in state.tables().items()})


def running_tasks(tasks: DataFrame, root_id: int) -> DataFrame:
    return tasks.where((F.col("root_id") == root_id) & (F.col("status") == 1))


def has_running_task(tasks: DataFrame, root_id: int) -> bool:
    return not running_tasks(tasks, root_id).isEmpty()
