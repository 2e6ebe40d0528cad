"""Hierarchy work: folder synthesis, recursive sizes and descendant change counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import paths as P
from tempora.operators.history import sized_calendar
from tempora.plans.sizing import broadcast_if_small
from tempora.plans.windows import with_neighbours, with_running
from tempora.schemas import ACCESS_OK, DIRECTORY, FOLDER_COUNTERS

MAIN_COUNTS = ("adds", "mods", "dels")


def roll_up(direct: DataFrame, by: list[str], sums: list[str], maxes: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate rows keyed by ``parent_path`` into every ancestor folder below the root.

    ``direct`` has ``root_path``, ``parent_path`` and the columns of ``by``.  Rows of one folder are
    combined before they fan out to the ancestors, so the top folder, which everything reaches,
    receives one partial row per map task.
    """
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxes]
    folded = direct.groupBy(*by, "root_path", "parent_path").agg(*aggs)
    below = F.concat(F.col("parent_path"), F.lit("/x"))
    chain = P.ancestor_chain(F.col("root_path"), below)
    return (
        folded.withColumn("folder_path", F.explode(chain))
        .groupBy(*by, "folder_path").agg(*aggs)
    )


def synthesize_directories(files: DataFrame) -> DataFrame:
    """Folder observations of every snapshot: size is the sum over all descendant files.

    ``files`` has root_id, root_path, scan_id, item_path, mod_date and size (null counts as 0).
    """
    direct = files.select(
        "root_id", "root_path", "scan_id", P.parent_path(F.col("item_path")).alias("parent_path"),
        F.coalesce(F.col("size"), F.lit(0)).alias("size"), "mod_date",
    )
    dirs = roll_up(direct, ["root_id", "scan_id"], ["size"], ("mod_date",))
    return dirs.select(
        "root_id", "scan_id", F.col("folder_path").alias("item_path"),
        F.lit(DIRECTORY).alias("item_type"), F.lit(ACCESS_OK).alias("access"), "mod_date", "size",
    )


def change_flags(versions: DataFrame) -> DataFrame:
    """adds / mods / dels of a version row against the previous one (needs ``prev``)."""
    new = F.col("prev").isNull()
    was_dead = F.col("prev")["is_deleted"]
    alive = ~F.col("is_deleted")
    return versions.withColumns({
        "adds": (alive & (new | was_dead)).cast("long"),
        "mods": (alive & ~new & ~was_dead).cast("long"),
        "dels": (~alive & ~new & ~was_dead).cast("long"),
    })


def own_flags(versions: DataFrame) -> DataFrame:
    """The same from a row's own marks; equal on any history this engine built, and no shuffle."""
    gone = F.col("is_deleted")
    return versions.withColumns({
        "adds": (~gone & F.col("is_added")).cast("long"),
        "mods": (~gone & ~F.col("is_added")).cast("long"),
        "dels": gone.cast("long"),
    })


def folder_changes(flagged: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Descendant adds/mods/dels per (root_id, scan_id, folder_path) over all scans at once.

    ``flagged`` are version rows with adds/mods/dels; ``paths`` gives item_id -> root_path, parent_path.
    Without ``paths`` the rows bring those columns themselves.
    """
    own = [] if paths is not None else ["root_path", "parent_path"]
    direct = flagged.select(
        "item_id", "root_id", F.col("first_scan_id").alias("scan_id"), *MAIN_COUNTS, *own)
    if paths is not None:
        direct = direct.join(paths.select("item_id", "root_path", "parent_path"), "item_id")
    out = roll_up(direct, ["root_id", "scan_id"], list(MAIN_COUNTS))
    return out.where((F.col("adds") > 0) | (F.col("mods") > 0) | (F.col("dels") > 0))


def apply_folder_changes(
    folders: DataFrame, changes: DataFrame, scans: DataFrame, span: int | None = None
) -> DataFrame:
    """Rewrite folder versions with counters, splitting a version where only descendants changed.

    ``folders``: folder versions with root_id, item_id, item_path.  ``changes``: output of
    ``folder_changes``.  Alive totals chain from version to version, which a running sum of
    adds minus dels gives without a loop.  Where a history is continued, the folder row it
    continues from brings that total in ``alive_seed`` and its own counters in ``changes``.
    """
    cal, bound = sized_calendar(scans)
    span = span or bound
    starts = folders.withColumn("scan_id", F.col("first_scan_id"))
    rows = starts.join(
        changes.withColumnRenamed("folder_path", "item_path"),
        ["root_id", "item_path", "scan_id"], "full",
    )
    # descendant-only rows take identity and attributes from the version in force
    fill = ["item_id", "is_deleted", "access", "mod_date", "size", "last_scan_id"]
    rows = rows.withColumn("_own", F.col("first_scan_id").isNotNull())
    key = ["root_id", "item_path"]
    delta = F.coalesce(F.col("adds"), F.lit(0)) - F.coalesce(F.col("dels"), F.lit(0))
    if "alive_seed" in folders.columns:
        delta = F.coalesce(F.col("alive_seed"), delta)
    rows = with_running(
        rows.withColumn("_row", F.when(F.col("_own"), F.struct(*fill))), key, "scan_id", span,
        sums={"_alive": delta, "_no": F.lit(1)},
        lasts={"_base": F.col("_row")},
    ).where(F.col("_base").isNotNull())
    rows = with_neighbours(rows, key, "scan_id", ["scan_id", "_own"], span, prev=None)
    split = F.col("next").isNotNull() & ~F.col("next")["_own"]
    closes = cal.select(
        "root_id", F.col("scan_id").alias("_split"), F.col("prev_scan_id").alias("_close"))
    rows = rows.withColumn("_split", F.when(split, F.col("next")["scan_id"])).join(
        closes, ["root_id", "_split"], "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in MAIN_COUNTS}
    return rows.select(
        "root_id", F.col("_base.item_id").alias("item_id"), "item_path",
        F.col("_no").alias("item_version"), F.col("scan_id").alias("first_scan_id"),
        F.coalesce("_close", F.col("_base.last_scan_id")).alias("last_scan_id"),
        F.coalesce("is_added", F.lit(False)).alias("is_added"),
        F.col("_base.is_deleted").alias("is_deleted"), F.col("_base.access").alias("access"),
        F.col("_base.mod_date").alias("mod_date"), F.col("_base.size").alias("size"),
        n["adds"].alias("add_count"), n["mods"].alias("modify_count"),
        n["dels"].alias("delete_count"),
        (F.col("_alive") - n["adds"] - n["mods"]).alias("unchanged_count"),
    )


def with_folder_counters(
    versions: DataFrame, items: DataFrame, roots: DataFrame, scans: DataFrame, span: int | None = None
) -> DataFrame:
    """Full history with folder counters: files pass through, folder versions are rebuilt.

    Versions that carry item_path and item_type are not joined with the items, and keep both columns.
    """
    carried = [c for c in ("item_path", "item_type") if c in versions.columns]
    is_dir = F.col("item_type") == DIRECTORY
    if len(carried) == 2:
        typed = versions.where(F.col("item_id").isNotNull())
        changes = folder_changes(own_flags(typed).withColumn("parent_path", P.parent_path(F.col("item_path")))
                                 .join(broadcast_if_small(roots.select("root_id", "root_path")), "root_id"))
    else:
        carried = []
        paths = items.join(roots, "root_id").select(
            "item_id", "root_path", "parent_path", "item_path", "item_type")
        changes = folder_changes(own_flags(versions), paths)
        typed = versions.join(paths.select("item_id", "item_path", "item_type"), "item_id")
    done = apply_folder_changes(typed.where(is_dir), changes, scans, span).withColumn("item_type", F.lit(DIRECTORY))
    files = typed.where(~is_dir).withColumns({c: F.lit(None).cast("long") for c in FOLDER_COUNTERS})
    cols = ["root_id", "item_id", "item_version", "first_scan_id", "last_scan_id", "is_added",
            "is_deleted", "access", "mod_date", "size", *FOLDER_COUNTERS, *carried]
    return files.select(*cols).unionByName(done.select(*cols))
