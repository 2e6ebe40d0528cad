"""Snapshots to versioned history: batch builder and one-snapshot merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import paths as P
from tempora.plans.sizing import BROADCAST_ROWS, number_rows
from tempora.plans.windows import choose_span, with_neighbours, with_running
from tempora.schemas import ACCESS_OK, COMPLETED, DIRECTORY, META, META_ERROR, READ_ERROR

KEY = ("root_id", "item_id")


def calendar(scans: DataFrame) -> DataFrame:
    """Completed scans with their ordinal per root and the neighbouring completed scans.

    One row per scan: the windows here are over the scans table, never over observations.
    """
    w = Window.partitionBy("root_id").orderBy("scan_id")
    return scans.where(F.col("state") == COMPLETED).select(
        "root_id", "scan_id",
        F.row_number().over(w).cast("long").alias("ord"),
        F.lag("scan_id").over(w).alias("prev_scan_id"),
        F.lead("scan_id").over(w).alias("next_scan_id"),
    )


def sized_calendar(scans: DataFrame) -> tuple[DataFrame, int | None]:
    """The calendar, broadcast if a count proves it small, and the segment width for its histories.

    One look at the scans table settles both: a key has at most one row per completed scan of its
    root, so the longest calendar bounds every ordered group.
    """
    sizes = scans.where(F.col("state") == COMPLETED).groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))
    total, longest = sizes.agg(F.sum("n"), F.max("n")).first()
    cal = calendar(scans)
    return (F.broadcast(cal) if (total or 0) <= BROADCAST_ROWS else cal), choose_span(longest or 0)


def previous_completed_scan(scans: DataFrame) -> DataFrame:
    """For every scan, whatever its state, the latest completed scan of its root before it."""
    w = Window.partitionBy("root_id").orderBy("scan_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col("state") == COMPLETED, F.col("scan_id"))
    return scans.select("root_id", "scan_id", F.max(done).over(w).alias("prev_scan_id"))


def _differs(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(False)
    for x, y in zip(a, b):
        out = out | ~x.eqNullSafe(y)
    return out


def build_history(
    observations: DataFrame,
    scans: DataFrame,
    key: Sequence[str] = KEY,
    carry: Sequence[str] = (),
    attrs: Sequence[str] = META,
    span: int | None = None,
) -> DataFrame:
    """All versions of all items from many full snapshots in one pass.

    ``observations`` has at most one row per key and completed scan; ``key`` contains ``root_id``.
    A version starts at the first sighting, after a gap, or when an attribute changes; a gap or a
    missing tail adds a deletion row at the next completed scan.  Unless calendars are so long that
    ordered groups must be segmented (or ``span`` demands it), everything after the first exchange on
    the key runs on one sort: only the first and last sighting of a version are kept, which stand next
    to each other, so no task builds a table of versions.
    """
    cal, bound = sized_calendar(scans)
    span = span or bound
    obs = observations.join(cal, ["root_id", "scan_id"])
    seen = with_neighbours(obs, key, "ord", ["ord", *attrs], span)
    prev, after = F.col("prev"), F.col("next")
    here = [F.col(a) for a in attrs]
    gap = prev.isNull() | (prev["ord"] != F.col("ord") - 1)
    lost = after.isNull() | (after["ord"] != F.col("ord") + 1)
    last = F.struct(F.col("scan_id").alias("scan"), F.when(lost, F.col("next_scan_id")).alias("gone"))
    edges = seen.select(
        *key, *carry, *attrs, "ord", F.col("scan_id").alias("first_scan_id"), gap.alias("is_added"),
        (gap | _differs(here, [prev[a] for a in attrs])).alias("_starts"),
        F.when(lost | _differs(here, [after[a] for a in attrs]), last).alias("_last"),
    ).where(F.col("_starts") | F.col("_last").isNotNull())
    edges = with_neighbours(edges, key, "ord", ["_last"], span, prev=None)
    made = edges.where("_starts").withColumn("_last", F.coalesce("_last", F.col("next")["_last"])).drop("next")
    made = with_running(
        made, key, "ord", span, sums={"_n": F.lit(1) + F.col("_last.gone").isNotNull().cast("long")})
    gone = F.col("_last.gone")
    alive = F.struct(
        (F.col("_n") - gone.isNotNull().cast("long")).alias("item_version"),
        F.col("first_scan_id"), F.col("_last.scan").alias("last_scan_id"), F.col("is_added"),
        F.lit(False).alias("is_deleted"),
    )
    tomb = F.struct(
        F.col("_n").alias("item_version"), gone.alias("first_scan_id"), gone.alias("last_scan_id"),
        F.lit(False).alias("is_added"), F.lit(True).alias("is_deleted"),
    )
    rows = F.explode(F.when(gone.isNotNull(), F.array(alive, tomb)).otherwise(F.array(alive)))
    return made.select(*key, *carry, *attrs, rows.alias("_v")).select(
        *key, *carry, "_v.item_version", "_v.first_scan_id", "_v.last_scan_id",
        "_v.is_added", "_v.is_deleted", *attrs,
    )


def extend_history(
    current: DataFrame,
    observations: DataFrame,
    scans: DataFrame,
    key: Sequence[str] = KEY,
    attrs: Sequence[str] = META,
    span: int | None = None,
) -> DataFrame:
    """Continue a history over any number of new scans in one pass.

    ``current`` holds the newest version of every item; ``scans`` all scans up to now.  The alive
    rows of ``current`` enter ``build_history`` as one more observation at their last scan.  Returns
    the new and the extended versions of every item that was alive or is observed; the newest
    version of any other item stays as it is.
    """
    alive = current.where(~F.col("is_deleted"))
    seeds = alive.select(*key, F.col("last_scan_id").alias("scan_id"), *attrs)
    rows = build_history(
        seeds.unionByName(observations.select(*key, "scan_id", *attrs)), scans, key, (), attrs, span)
    old = current.select(
        *key, F.col("item_version").alias("_v"), F.col("is_deleted").alias("_dead"),
        F.col("first_scan_id").alias("_first"), F.col("is_added").alias("_added"))
    seeded = (F.col("item_version") == 1) & ~F.coalesce(F.col("_dead"), F.lit(True))
    base = F.coalesce(F.col("_v") - (~F.col("_dead")).cast("int"), F.lit(0))
    return rows.join(old, list(key), "left").withColumns({
        "first_scan_id": F.when(seeded, F.col("_first")).otherwise(F.col("first_scan_id")),
        "is_added": F.when(seeded, F.col("_added")).otherwise(F.col("is_added")),
        "item_version": F.col("item_version") + base,
    }).select(*rows.columns)


# ---- one snapshot at a time -------------------------------------------------------------------


def current_versions(versions: DataFrame) -> DataFrame:
    """Highest version per item; the aggregate combines before its shuffle."""
    cols = [c for c in versions.columns if c != "item_id"]
    return versions.groupBy("item_id").agg(
        F.max_by(F.struct(*cols), "item_version").alias("_v")
    ).select("item_id", "_v.*")


def next_access(item_type: Column, old: Column, dir_unreadable: Column, unreadable: Column) -> Column:
    """Access after a listing: a failed stat, then a failed folder read, then what is cleared."""
    return (
        F.when(unreadable, META_ERROR)
        .when(item_type == DIRECTORY, F.when(dir_unreadable, READ_ERROR).otherwise(ACCESS_OK))
        .when(old == READ_ERROR, READ_ERROR)
        .otherwise(ACCESS_OK)
    )


def match_snapshot(snapshot: DataFrame, items: DataFrame, versions: DataFrame) -> DataFrame:
    """Full outer match of one snapshot with the current versions on (root, path, type)."""
    natural = ["root_id", "item_path", "item_type"]
    cur = current_versions(versions).select(
        "item_id", "item_version", "first_scan_id", "last_scan_id", "is_deleted",
        *[F.col(c).alias(f"cur_{c}") for c in META],
        *[F.col(c).alias(f"cur_{c}") for c in ("add_count", "modify_count", "unchanged_count")],
    )
    known = items.select("item_id", *natural).join(cur, "item_id")
    return known.join(snapshot.select(*natural, *META, F.lit(True).alias("seen")), natural, "full")


def classify(matched: DataFrame, scan_id: int) -> DataFrame:
    """Add ``change``: new, rehydrated, modified, unchanged, repeated, swept or absent."""
    seen = F.coalesce(F.col("seen"), F.lit(False))
    differs = _differs([F.col(c) for c in META], [F.col(f"cur_{c}") for c in META])
    change = (
        F.when(F.col("item_id").isNull(), "new")
        .when(seen & (F.col("last_scan_id") == scan_id), "repeated")
        .when(seen & F.col("is_deleted"), "rehydrated")
        .when(seen & differs, "modified")
        .when(seen, "unchanged")
        .when(~F.col("is_deleted") & (F.col("last_scan_id") < scan_id), "swept")
        .otherwise("absent")
    )
    return matched.withColumn("change", change)


def new_items(natural: DataFrame, start: int | Column) -> DataFrame:
    """Identity rows for unseen (root_id, item_path, item_type), numbered after ``start``."""
    rows = number_rows(natural, ["root_id", "item_path", "item_type"], "item_id", start)
    name = P.path_name(F.col("item_path"))
    ext = P.file_extension(name, F.col("item_type"))
    return rows.select(
        "item_id", "root_id", "item_path", name.alias("item_name"),
        P.parent_path(F.col("item_path")).alias("parent_path"), ext.alias("file_extension"),
        "item_type", P.has_validator(ext).alias("has_validator"),
        F.lit(False).alias("do_not_validate"),
    )


def initial_versions(rows: DataFrame, scan_id: int) -> DataFrame:
    """First (or returning) version: added, and zero counters for folders."""
    zero = F.when(F.col("item_type") == DIRECTORY, F.lit(0))
    return rows.select(
        "item_id", (F.coalesce(F.col("item_version"), F.lit(0)) + 1).alias("item_version"),
        "root_id", F.lit(scan_id).alias("first_scan_id"), F.lit(scan_id).alias("last_scan_id"),
        F.lit(True).alias("is_added"), F.lit(False).alias("is_deleted"), *META,
        *[zero.alias(c) for c in ("add_count", "modify_count", "delete_count", "unchanged_count")],
    )


def modified_versions(rows: DataFrame, scan_id: int) -> DataFrame:
    """Changed item: a folder starts from (0, 0, 0, previously alive); validation is not carried."""
    folder = F.col("item_type") == DIRECTORY
    alive = sum((F.coalesce(F.col(f"cur_{c}"), F.lit(0))
                 for c in ("add_count", "modify_count", "unchanged_count")), F.lit(0))
    return rows.select(
        "item_id", (F.col("item_version") + 1).alias("item_version"), "root_id",
        F.lit(scan_id).alias("first_scan_id"), F.lit(scan_id).alias("last_scan_id"),
        F.lit(False).alias("is_added"), F.lit(False).alias("is_deleted"), *META,
        *[F.when(folder, 0).alias(c) for c in ("add_count", "modify_count", "delete_count")],
        F.when(folder, alive).alias("unchanged_count"),
    )


def deletion_versions(rows: DataFrame, scan_id: int) -> DataFrame:
    """Tombstones carrying the last seen attributes."""
    zero = F.when(F.col("item_type") == DIRECTORY, F.lit(0))
    return rows.select(
        "item_id", (F.col("item_version") + 1).alias("item_version"), "root_id",
        F.lit(scan_id).alias("first_scan_id"), F.lit(scan_id).alias("last_scan_id"),
        F.lit(False).alias("is_added"), F.lit(True).alias("is_deleted"),
        *[F.col(f"cur_{c}").alias(c) for c in META],
        *[zero.alias(c) for c in ("add_count", "modify_count", "delete_count", "unchanged_count")],
    )


def touch_unchanged(versions: DataFrame, touched: DataFrame, scan_id: int) -> DataFrame:
    """Extend the given (item_id, item_version) rows to ``scan_id``."""
    marks = touched.select("item_id", "item_version", F.lit(True).alias("_hit"))
    return versions.join(marks, ["item_id", "item_version"], "left").withColumn(
        "last_scan_id", F.when(F.col("_hit"), F.lit(scan_id)).otherwise(F.col("last_scan_id"))
    ).drop("_hit").select(*versions.columns)


def sweep(items: DataFrame, versions: DataFrame, root_id: int, scan_id: int) -> DataFrame:
    """Tombstones for everything alive in the root that the scan did not see."""
    cur = current_versions(versions.where(F.col("root_id") == root_id))
    stale = cur.where(~F.col("is_deleted") & (F.col("last_scan_id") < scan_id))
    rows = stale.join(items.select("item_id", "item_type"), "item_id")
    return deletion_versions(
        rows.withColumns({f"cur_{c}": F.col(c) for c in META}), scan_id)


def merge_snapshot(items: DataFrame, versions: DataFrame, snapshot: DataFrame, root_id: int,
                   scan_id: int) -> tuple[DataFrame, DataFrame]:
    """Apply one full snapshot of a root; returns the new items and versions.

    Folder counters are the initial ones here; ``tree.with_folder_counters`` completes them.
    """
    natural = ["root_id", "item_path", "item_type"]
    rows = classify(match_snapshot(
        snapshot, items.where(F.col("root_id") == root_id), versions.where(F.col("root_id") == root_id)), scan_id)
    top = items.agg(F.max("item_id")).first()[0] or 0
    born = new_items(rows.where(F.col("change") == "new").select(*natural), top)
    all_items = items.unionByName(born.select(*items.columns))
    first = rows.where(F.col("change") == "new").drop("item_id").join(born.select("item_id", *natural), natural)
    made = (
        initial_versions(first, scan_id)
        .unionByName(initial_versions(rows.where(F.col("change") == "rehydrated"), scan_id))
        .unionByName(modified_versions(rows.where(F.col("change") == "modified"), scan_id))
        .unionByName(deletion_versions(rows.where(F.col("change") == "swept"), scan_id))
    )
    kept = touch_unchanged(versions, rows.where(F.col("change") == "unchanged"), scan_id)
    return all_items, kept.unionByName(made.select(*[c for c in made.columns]), allowMissingColumns=True) \
        .select(*versions.columns)
