"""Time-travel browsing of the tree, item histories and item state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.filters import date_bounds, text_match
from tempora.functions.paths import natural_key
from tempora.operators.asof import snapshot_at, version_in_force, with_latest_hash
from tempora.operators.domains import page
from tempora.schemas import DIRECTORY, FILE, State

IDENTITY = ("item_id", "item_path", "item_name", "item_type", "has_validator")


def _snapshot_of(state: State, items: DataFrame, root_id: int, scan_id: int) -> DataFrame:
    """As-of rows of the given items of a root; only their versions enter the aggregate."""
    versions = state.versions.where(F.col("root_id") == root_id).join(items.select("item_id"), "item_id", "left_semi")
    return snapshot_at(versions, scan_id).join(items.select(*IDENTITY), "item_id")


def _with_states(state: State, rows: DataFrame, root_id: int) -> DataFrame:
    hashes = state.hashes.where(F.col("root_id") == root_id).join(rows.select("item_id"), "item_id", "left_semi")
    return with_latest_hash(rows, hashes).select(
        *IDENTITY, "item_version", "first_scan_id", "is_added", "is_deleted", "mod_date", "size",
        "add_count", "modify_count", "delete_count", "unchanged_count", "val_state", "hash_state")


def natural_order(df: DataFrame) -> DataFrame:
    return df.orderBy(natural_key(F.col("item_path")), "item_id")


def children_at(state: State, root_id: int, parent: str, scan_id: int) -> DataFrame:
    """Immediate children of a folder as a scan showed them: equality on the stored parent path."""
    items = state.items.where((F.col("root_id") == root_id) & (F.col("parent_path") == parent))
    return _with_states(state, _snapshot_of(state, items, root_id, scan_id), root_id)


def children_page(state: State, root_id: int, parent: str, scan_id: int,
                  limit: int, offset: int = 0) -> DataFrame:
    return page(natural_order(children_at(state, root_id, parent, scan_id)), limit, offset)


def count_children(state: State, root_id: int, parent: str, scan_id: int) -> DataFrame:
    items = state.items.where((F.col("root_id") == root_id) & (F.col("parent_path") == parent))
    return _snapshot_of(state, items, root_id, scan_id).agg(F.count(F.lit(1)).alias("count"))


def descendant_counts(state: State, root_id: int, folder: str, scan_id: int) -> DataFrame:
    """Alive files and folders anywhere below a folder."""
    items = state.items.where(
        (F.col("root_id") == root_id) & F.col("item_path").startswith(folder.rstrip("/") + "/"))
    versions = state.versions.where(F.col("root_id") == root_id).join(items.select("item_id"), "item_id", "left_semi")
    alive = version_in_force(versions, scan_id).where(~F.col("is_deleted"))
    typed = alive.join(items.select("item_id", "item_type"), "item_id")
    return typed.agg(
        F.count_if(F.col("item_type") == FILE).alias("file_count"),
        F.count_if(F.col("item_type") == DIRECTORY).alias("directory_count"))


def search_at(state: State, root_id: int, text: str, scan_id: int) -> DataFrame:
    """Items whose name contains the text, as a scan showed them."""
    items = state.items.where((F.col("root_id") == root_id) & text_match(F.col("item_name"), text))
    return _with_states(state, _snapshot_of(state, items, root_id, scan_id), root_id)


def count_matches(state: State, root_id: int, text: str, scan_id: int) -> DataFrame:
    """How many items ``search_at`` finds."""
    items = state.items.where((F.col("root_id") == root_id) & text_match(F.col("item_name"), text))
    return _snapshot_of(state, items, root_id, scan_id).agg(F.count(F.lit(1)).alias("count"))


def search_page(state: State, root_id: int, text: str, scan_id: int, limit: int, offset: int = 0) -> DataFrame:
    """A page of ``search_at`` in natural order of the paths."""
    return page(natural_order(search_at(state, root_id, text, scan_id)), limit, offset)


def version_history(state: State, item_id: int, newest_first: bool = True) -> DataFrame:
    """Versions of an item with the dates of their first and last scan and the latest hash."""
    mine = state.versions.where(F.col("item_id") == item_id)
    dates = state.scans.select("scan_id", "started_at")
    rows = (
        with_latest_hash(mine, state.hashes.where(F.col("item_id") == item_id))
        .join(dates.toDF("first_scan_id", "first_scan_date"), "first_scan_id")
        .join(dates.toDF("last_scan_id", "last_scan_date"), "last_scan_id")
    )
    order = F.col("item_version")
    return rows.orderBy(order.desc() if newest_first else order.asc())


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("item_id").agg(F.count(F.lit(1)).alias("version_count"))


def hash_history(state: State, item_id: int, item_version: int) -> DataFrame:
    """Hash observations of one version with their scan dates, oldest first."""
    mine = state.hashes.where((F.col("item_id") == item_id) & (F.col("item_version") == item_version))
    dates = state.scans.select("scan_id", "started_at")
    return (
        mine.join(dates.toDF("first_scan_id", "first_scan_date"), "first_scan_id")
        .join(dates.toDF("last_scan_id", "last_scan_date"), "last_scan_id")
        .orderBy("first_scan_id")
    )


def size_history(state: State, item_id: int, from_date: str, to_scan_id: int,
                 zone: str = "UTC") -> DataFrame:
    """Sizes of an item's versions created between a day and the start of a scan."""
    start, _ = date_bounds(from_date, zone)
    until = state.scans.where(F.col("scan_id") == to_scan_id).select("started_at").first()[0]  # one row
    mine = state.versions.where((F.col("item_id") == item_id) & F.col("size").isNotNull())
    dated = mine.join(state.scans.select(F.col("scan_id").alias("first_scan_id"), "started_at"),
                      "first_scan_id")
    return (
        dated.where(F.col("started_at").between(start, until))
        .select(F.col("first_scan_id").alias("scan_id"), "started_at", "size").orderBy("started_at")
    )


def integrity_state_at(state: State, item_ids: DataFrame, scan_id: int, root_id: int | None = None) -> DataFrame:
    """Validation and hash state of items at a scan; unknown items get false flags and nulls.

    Only the items' own versions and hashes enter the aggregates; ``root_id`` says that all items lie
    below one root, so that only its partitions are read.
    """
    items, versions, hashes = (
        df if root_id is None else df.where(F.col("root_id") == root_id)
        for df in (state.items, state.versions, state.hashes))
    asked = item_ids.select("item_id")
    known = items.select("item_id", "has_validator", "do_not_validate")
    force = version_in_force(versions.join(asked, "item_id", "left_semi"), scan_id).select(
        "item_id", "item_version", "val_state", "val_error")
    hashed = with_latest_hash(force, hashes.join(asked, "item_id", "left_semi")).select(
        "item_id", "val_state", "val_error", "hash_state", "file_hash")
    return item_ids.join(known, "item_id", "left").join(hashed, "item_id", "left") \
        .fillna(False, ["has_validator", "do_not_validate"])


def directories_first(df: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Folders always before files; then name (case-blind), size or mod_date."""
    keys: dict[str, Column] = {
        "name": F.lower("item_name"),
        "size": F.coalesce("size", F.lit(-1)),
        "mod_date": F.coalesce("mod_date", F.lit(0)),
    }
    second = keys[by].desc() if descending else keys[by].asc()
    return df.orderBy((F.col("item_type") == DIRECTORY).desc(), second, "item_id")


def item_detail(state: State, item_id: int) -> DataFrame:
    """Identity, version count and the newest version of an item."""
    one = state.items.where(F.col("item_id") == item_id)
    mine = state.versions.where(F.col("item_id") == item_id)
    newest = version_history(state, item_id).limit(1).select(
        "item_id", "item_version", "first_scan_date", "last_scan_date", "is_deleted", "size",
        "val_state", "hash_state")
    return one.select(*IDENTITY, "file_extension", "do_not_validate") \
        .join(version_counts(mine), "item_id").join(newest, "item_id")
