"""Row-level changes between two versions of the store, with the rows before and after.

A change has its table's key, ``before`` and ``after`` (structs of the other columns, null where the
row did not exist).  What a version changed is recorded when it is published; undoing it puts the
recorded rows back, so nothing about earlier scans has to be guessed.

Each table costs one full outer join on its key, which is unique, so no key is hot; a store kept per
root passes only the roots a version touched.  Nulls compare as equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.schemas import State

KEYS = {
    "roots": ["root_id"],
    "scans": ["scan_id"],
    "items": ["item_id"],
    "versions": ["item_id", "item_version"],
    "hashes": ["item_id", "item_version", "first_scan_id"],
    "schedules": ["schedule_id"],
    "tasks": ["task_id"],
}


def _images(rows: DataFrame, key: list[str], out: str) -> DataFrame:
    return rows.select(*key, F.struct(*[c for c in rows.columns if c not in key]).alias(out))


def table_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Inserted, deleted and updated rows (key, before, after); both sides have the same columns."""
    met = _images(before, key, "before").join(
        _images(after.select(*before.columns), key, "after"), key, "full_outer")
    return met.where(~F.col("before").eqNullSafe(F.col("after")))


def change_kind() -> Column:
    return F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")


def store_changes(before: State, after: State) -> dict[str, DataFrame]:
    """Changes of every table that both versions have."""
    old, new = before.tables(), after.tables()
    return {name: table_changes(old[name], new[name], KEYS[name]) for name in old if name in new}


def _with_images(rows: DataFrame, changes: DataFrame, key: list[str], side: str) -> DataFrame:
    hits = changes.select(*key, F.col(side).alias("_image"), F.lit(True).alias("_hit"))
    met = _images(rows, key, "_row").join(hits, key, "full_outer")
    met = met.withColumn("_row", F.when(F.col("_hit"), F.col("_image")).otherwise(F.col("_row")))
    rest = [F.col("_row")[c].alias(c) for c in rows.columns if c not in key]
    return met.where(F.col("_row").isNotNull()).select(*key, *rest).select(*rows.columns)


def undo_table(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The rows as they were before the changes; rows the changes do not name stay as they are."""
    return _with_images(rows, changes, key, "before")


def redo_table(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The rows with the changes made."""
    return _with_images(rows, changes, key, "after")


def undo_changes(state: State, changes: dict[str, DataFrame]) -> State:
    return state.with_(**{n: undo_table(df, changes[n], KEYS[n])
                          for n, df in state.tables().items() if n in changes})


def overtaken(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Changes whose row has moved on since: undoing them would lose what came later."""
    now = _images(rows, key, "now")
    return changes.join(now, key, "left").where(~F.col("now").eqNullSafe(F.col("after")))
