"""History repair and backfill jobs; every one is a pass of windows or joins, none loops.

Unless a caller gives ``span`` (None: plain windows), the jobs count how many scans a history can have and
cut long ones into segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import paths as P
from tempora.operators.history import calendar
from tempora.operators.asof import with_previous
from tempora.operators.tree import change_flags, folder_changes, roll_up
from tempora.operators.scanstats import new_issues
from tempora.plans.sizing import broadcast_if_small
from tempora.plans.windows import MEASURE, sized, with_neighbours, with_running
from tempora.schemas import BASELINE, COMPLETED, DIRECTORY, FILE, SUSPECT, State

ITEM = ["item_id"]
FOLDER_FIELDS = ("is_added", "is_deleted", "access", "mod_date", "size", "add_count", "modify_count",
                 "delete_count", "unchanged_count")
ADD, MODIFY, DELETE = 1, 2, 3
VAL_UNKNOWN_OLD = 3  # fixed value: "unknown" of the old change log


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b)], F.lit(True))


def _equals(struct: str, fields: Sequence[str]) -> Column:
    return F.col(struct).isNotNull() & _same([F.col(f) for f in fields], [F.col(struct)[f] for f in fields])


def _merge_islands(rows: DataFrame, start: Column, span: int | None) -> DataFrame:
    """Fold each run of rows to its first one, extended to the greatest last_scan_id of the run."""
    rows = with_running(rows.withColumn("_start", start.cast("long")), ITEM, "first_scan_id", span,
                        sums={"_island": F.col("_start")})
    keep = [c for c in rows.columns if c not in {"item_id", "last_scan_id", "_start", "_island"}]
    return rows.groupBy("item_id", "_island").agg(
        F.min_by(F.struct(*keep), "first_scan_id").alias("_k"), F.max("last_scan_id").alias("last_scan_id"),
    ).select("item_id", "_k.*", "last_scan_id")


def collapse_identical(versions: DataFrame, fields: Sequence[str] = FOLDER_FIELDS,
                       span: int | None = MEASURE) -> DataFrame:
    """Merge consecutive versions that agree in all ``fields`` into the first of them.

    A merged row equals the one it was merged into, so comparing with the row just before is the
    same as comparing with the kept one, and one pass reaches the fixpoint.
    """
    span = sized(span, versions, "first_scan_id")
    rows = with_neighbours(versions, ITEM, "first_scan_id", fields, span, next=None)
    start = ~_equals("prev", fields)
    return _merge_islands(rows.withColumn("_new", start).drop("prev"), F.col("_new"), span) \
        .select(*versions.columns)


def collapse_noop_folders(versions: DataFrame, fields: Sequence[str] = FOLDER_FIELDS,
                          meta: Sequence[str] = ("access", "mod_date", "size", "val_scan_id", "val_state", "val_error"),
                          span: int | None = MEASURE) -> DataFrame:
    """As ``collapse_identical``, also absorbing versions that record no change at all.

    Such a version is neither added nor deleted, has counters 0/0/0 and the metadata of the kept
    row.  Absorbed rows share that metadata, so the row before decides this; what remains is
    compared with the last row that was not absorbed that way.
    """
    span = sized(span, versions, "first_scan_id")
    rows = with_neighbours(versions, ITEM, "first_scan_id", meta, span, next=None)
    quiet = ~F.col("is_added") & ~F.col("is_deleted")
    for c in ("add_count", "modify_count", "delete_count"):
        quiet = quiet & (F.coalesce(F.col(c), F.lit(1)) == 0)
    rows = rows.withColumn("_noop", quiet & _equals("prev", meta)).drop("prev")
    every = list(dict.fromkeys([*fields, *meta]))
    rows = with_running(rows, ITEM, "first_scan_id", span,
                        lasts={"_real": F.when(~F.col("_noop"), F.struct(*every))})
    rows = with_neighbours(rows, ITEM, "first_scan_id", ["_real"], span, next=None)
    before = F.col("prev._real")
    same = before.isNotNull() & _same([F.col(f) for f in every], [before[f] for f in every])
    rows = rows.withColumn("_new", ~F.col("_noop") & ~F.coalesce(same, F.lit(False))).drop("prev", "_real", "_noop")
    return _merge_islands(rows, F.col("_new"), span).select(*versions.columns)


def group_phantoms(old: DataFrame, span: int | None = MEASURE) -> DataFrame:
    """Fold metadata-equal followers into the real version before them.

    ``old`` rows carry one hash and one validation each (file_hash, hash_state, last_hash_scan,
    val_state, val_error, last_val_scan).  The group keeps its earliest hash, the latest hash state,
    the latest meaningful validation (valid or invalid) and the greatest last_scan_id.
    """
    span = sized(span, old, "first_scan_id")
    meta = ("access", "mod_date", "size")
    rows = with_neighbours(old, ITEM, "first_scan_id", ["is_deleted", *meta], span, next=None)
    phantom = (~F.col("is_added") & ~F.col("is_deleted") & F.coalesce(~F.col("prev")["is_deleted"], F.lit(False))
               & _equals("prev", meta))
    rows = rows.withColumn("_real", (~phantom).cast("long")).drop("prev")
    rows = with_running(rows, ITEM, "first_scan_id", span, sums={"_island": F.col("_real")})
    hashed = F.col("file_hash").isNotNull() & F.col("last_hash_scan").isNotNull()
    judged = F.col("val_state").isin(1, 2) & F.col("last_val_scan").isNotNull()
    at_hash = F.when(hashed, F.struct("last_hash_scan", "first_scan_id"))
    at_val = F.when(judged, F.struct("last_val_scan", "first_scan_id"))
    out = rows.groupBy("item_id", "_island").agg(
        F.min_by(F.struct("root_id", "item_version", "first_scan_id", "is_added", "is_deleted", *meta),
                 "first_scan_id").alias("_v"),
        F.max("last_scan_id").alias("last_scan_id"),
        F.min_by("file_hash", at_hash).alias("file_hash"),
        F.min(F.when(hashed, F.col("last_hash_scan"))).alias("hash_first_scan_id"),
        F.max_by(F.coalesce("hash_state", F.lit(BASELINE)), at_hash).alias("hash_state"),
        F.max_by(F.struct(F.col("last_val_scan").alias("val_scan_id"), "val_state", "val_error"), at_val)
        .alias("_val"),
    )
    return out.select("item_id", "_v.*", "last_scan_id", "file_hash", "hash_first_scan_id", "hash_state", "_val.*")


def overlapping(versions: DataFrame, span: int | None = MEASURE) -> DataFrame:
    """Versions that begin before some earlier version of their item has ended.

    A running maximum finds them without pairing the versions of an item.
    """
    span = sized(span, versions, "first_scan_id")
    rows = with_running(versions, ITEM, "first_scan_id", span, maxes={"_reach": F.col("last_scan_id")})
    rows = with_neighbours(rows, ITEM, "first_scan_id", ["_reach"], span, next=None)
    return rows.where(F.col("prev")["_reach"] >= F.col("first_scan_id")).select(*versions.columns)


def rechain_overlaps(versions: DataFrame, items: DataFrame, span: int | None = MEASURE) -> DataFrame:
    """Close every version of an overlapping item right before the next one begins.

    The last version keeps the greatest end of the item; folder versions left with an end before
    their start are dropped, whichever item they belong to.
    """
    span = sized(span, versions, "first_scan_id")
    rows = with_running(versions, ITEM, "first_scan_id", span, maxes={"_reach": F.col("last_scan_id")})
    rows = with_neighbours(rows, ITEM, "first_scan_id", ["first_scan_id"], span, prev=None)
    next_first = F.col("next")["first_scan_id"]
    bad = rows.where(next_first <= F.col("_reach")).select("item_id").distinct().withColumn("_bad", F.lit(True))
    rows = rows.join(bad, "item_id", "left").join(items.select("item_id", "item_type"), "item_id")
    rows = rows.withColumn("last_scan_id", F.when(
        F.col("_bad"), F.coalesce(next_first - 1, F.col("_reach"))).otherwise(F.col("last_scan_id")))
    inverted = (F.col("item_type") == DIRECTORY) & (F.col("first_scan_id") > F.col("last_scan_id"))
    return rows.where(~inverted).select(*versions.columns)


def wrongly_deleted_folders(versions: DataFrame, items: DataFrame, roots: DataFrame,
                            span: int | None = MEASURE) -> DataFrame:
    """Deleted folder versions during which some file below was alive.

    Per folder and start scan only the furthest end of the files below matters; the running maximum
    of those ends at the folder version's own end says whether one reaches into it.
    """
    span = sized(span, versions, "first_scan_id")
    files = versions.where(~F.col("is_deleted")).join(
        items.where(F.col("item_type") == FILE).select("item_id", "parent_path"), "item_id")
    direct = files.select("root_id", "first_scan_id", "last_scan_id", "parent_path").join(roots, "root_id")
    reach = roll_up(direct.withColumn("zero", F.lit(0)), ["root_id", "first_scan_id"], ["zero"],
                    maxes=("last_scan_id",))
    folders = versions.where(F.col("is_deleted")).join(
        items.where(F.col("item_type") == DIRECTORY).select("item_id", F.col("item_path").alias("folder_path")),
        "item_id")
    axis = reach.select("root_id", "folder_path", (F.col("first_scan_id") * 2).alias("_at"),
                        F.col("last_scan_id").alias("_reach"),
                        *[F.lit(None).cast("long").alias(c) for c in ("item_id", "item_version", "first_scan_id", "last_scan_id")])
    asks = folders.select("root_id", "folder_path", (F.col("last_scan_id") * 2 + 1).alias("_at"),
                          F.lit(None).cast("long").alias("_reach"),
                          "item_id", "item_version", "first_scan_id", "last_scan_id")
    merged = with_running(axis.unionByName(asks), ["root_id", "folder_path"], "_at", span,
                          maxes={"_until": F.col("_reach")})
    return merged.where(F.col("item_id").isNotNull() & (F.col("_until") >= F.col("first_scan_id"))).select(
        "item_id", "item_version", "root_id", "first_scan_id", "last_scan_id")


def repair_deletion_flags(versions: DataFrame, wrong: DataFrame) -> DataFrame:
    hits = wrong.select("item_id", "item_version", F.lit(True).alias("_hit"))
    return versions.join(hits, ["item_id", "item_version"], "left").withColumn(
        "is_deleted", F.col("is_deleted") & F.col("_hit").isNull()).select(*versions.columns)


def affected_scans(wrong: DataFrame, scans: DataFrame) -> DataFrame:
    """Completed scans inside the interval of any repaired version."""
    spans = wrong.select("root_id", "first_scan_id", "last_scan_id").distinct()
    done = scans.where(F.col("state") == COMPLETED).select("root_id", "scan_id")
    cal = broadcast_if_small(calendar(scans).select("root_id", "scan_id", "ord"))
    lo = cal.select("root_id", F.col("scan_id").alias("first_scan_id"), F.col("ord").alias("_lo"))
    hi = cal.select("root_id", F.col("scan_id").alias("last_scan_id"), F.col("ord").alias("_hi"))
    laid = spans.join(lo, ["root_id", "first_scan_id"]).join(hi, ["root_id", "last_scan_id"]).select(
        "root_id", F.explode(F.sequence("_lo", "_hi")).alias("ord")).distinct()
    return laid.join(cal, ["root_id", "ord"]).join(done, ["root_id", "scan_id"]).select("root_id", "scan_id")


def backfill_new_issues(scans: DataFrame, versions: DataFrame, hashes: DataFrame) -> DataFrame:
    """Recompute the new-issue counters of completed scans."""
    fresh = new_issues(versions, hashes)
    done = F.col("state") == COMPLETED
    rows = scans.drop("new_hash_suspect_count", "new_val_invalid_count").join(fresh, "scan_id", "left")
    return rows.withColumns({
        c: F.when(done, F.coalesce(F.col(c), F.lit(0))) for c in ("new_hash_suspect_count", "new_val_invalid_count")
    }).select(*scans.columns)


def backfill_folder_counters(versions: DataFrame, items: DataFrame, roots: DataFrame,
                             span: int | None = MEASURE) -> DataFrame:
    """Counters of every folder at every scan that changed something below it.

    The number of things alive below a folder before a scan is the running sum of adds minus
    deletes, so no scan waits for the one before it.
    """
    span = sized(span, versions, "first_scan_id")
    paths = items.join(roots, "root_id").select("item_id", "root_path", "parent_path")
    flagged = change_flags(with_previous(versions, ["is_deleted"], span))
    rows = folder_changes(flagged, paths)
    rows = with_running(rows, ["root_id", "folder_path"], "scan_id", span,
                        sums={"_alive": F.col("adds") - F.col("dels")})
    return rows.withColumn("unchanged", F.col("_alive") - F.col("adds") - F.col("mods")).drop("_alive")


def backfill_item_fields(items: DataFrame) -> DataFrame:
    """Extension and validator flag recomputed from the name and type."""
    ext = P.file_extension(F.col("item_name"), F.col("item_type"))
    return items.withColumns({"file_extension": ext, "has_validator": P.has_validator(ext)})


def text_hashes_to_binary(rows: DataFrame, column: str = "file_hash") -> DataFrame:
    return rows.withColumn(column, F.unhex(column))


# ---- change log to versions -------------------------------------------------------------------


def fold_same_scan(changes: DataFrame) -> DataFrame:
    """One change per item and scan: the first kind, and the latest value of every field set."""
    fields = [c for c in changes.columns if c not in ("item_id", "root_id", "scan_id", "seq", "change_type")]
    pick = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return changes.groupBy("item_id", "root_id", "scan_id").agg(
        F.min_by("change_type", "seq").alias("change_type"), *pick)


def versions_from_changes(changes: DataFrame, current: DataFrame, scans: DataFrame,
                          span: int | None = MEASURE) -> DataFrame:
    """Versions out of add / modify / delete records, one per item and scan.

    Fields a record does not set are carried forward since the last add or return.  A version closes
    at the completed scan before the next record; the last one takes its state and end from
    ``current``, and an item without records becomes one version there.
    """
    span = sized(span, changes, "scan_id")
    kind, scan = F.col("change_type"), F.col("scan_id")
    rows = with_neighbours(changes, ITEM, "scan_id", ["scan_id"], span)
    first = F.col("prev").isNull()
    add = kind == ADD
    opening = first & (kind == MODIFY)
    rows = rows.withColumns({"_reset": (add | first).cast("long"), "_next": F.col("next")["scan_id"],
                             "_add": add, "_open": opening}).drop("prev", "next")
    rows = with_running(rows, ITEM, "scan_id", span, sums={"_life": F.col("_reset")})
    fresh = F.col("_add") | F.col("_open")
    hash_set, val_set = F.coalesce("hash_change", F.lit(False)), F.coalesce("val_change", F.lit(False))
    changed = kind == MODIFY

    def put(when_fresh: Column, when_set: Column, value: Column, name: str) -> Column:
        return F.when(fresh, F.struct(when_fresh.alias(name))).when(changed & when_set, F.struct(value.alias(name)))

    opened_hash = F.when(F.col("_open") | hash_set, F.col("hash_new"))
    hash_scan = F.when(F.when(F.col("_open"), F.col("hash_new").isNotNull()).otherwise(hash_set), scan)
    val_scan = F.when(F.when(F.col("_open"), F.col("val_new").isNotNull()).otherwise(val_set), scan)
    opened_val = F.coalesce(F.when(F.col("_open") | val_set, F.col("val_new")), F.lit(VAL_UNKNOWN_OLD))
    opened_error = F.when(F.col("_open") | val_set, F.col("val_error_new"))
    rows = with_running(rows, ["item_id", "_life"], "scan_id", span, lasts={
        "_access": F.when(fresh, F.coalesce("access_new", F.lit(0)))
        .when(changed, F.col("access_new")),
        "_meta": F.when(fresh | (changed & F.coalesce("meta_change", F.lit(False))),
                        F.struct(F.col("mod_date_new").alias("mod_date"), F.col("size_new").alias("size"))),
        "_hash": put(opened_hash, hash_set, F.col("hash_new"), "v"),
        "_hash_scan": put(hash_scan, F.col("hash_change").isNotNull(), scan, "v"),
        "_val": put(opened_val, val_set & F.col("val_new").isNotNull(), F.col("val_new"), "v"),
        "_error": put(opened_error, val_set, F.col("val_error_new"), "v"),
        "_val_scan": put(val_scan, F.col("val_change").isNotNull(), scan, "v"),
    })
    built = rows.select(
        "item_id", "root_id", scan.alias("first_scan_id"), "_next",
        (kind == DELETE).alias("is_deleted"), F.coalesce("_access", F.lit(0)).alias("access"),
        F.col("_meta.mod_date").alias("mod_date"), F.col("_meta.size").alias("size"),
        F.col("_hash.v").alias("file_hash"), F.coalesce(F.col("_val.v"), F.lit(VAL_UNKNOWN_OLD)).alias("val"),
        F.col("_error.v").alias("val_error"), F.col("_hash_scan.v").alias("last_hash_scan"),
        F.col("_val_scan.v").alias("last_val_scan"),
    )
    state = ["is_deleted", "access", "mod_date", "size", "file_hash", "val", "val_error", "last_hash_scan",
             "last_val_scan"]
    cal = broadcast_if_small(calendar(scans).select(
        "root_id", F.col("scan_id").alias("_next"), F.col("prev_scan_id").alias("_close")))
    closed = built.where(F.col("_next").isNotNull()).join(cal, ["root_id", "_next"], "left").select(
        "item_id", "root_id", "first_scan_id",
        F.coalesce("_close", "first_scan_id").alias("last_scan_id"), *state)
    newest = built.where(F.col("_next").isNull()).select("item_id", "first_scan_id")
    final = current.join(newest, "item_id", "left").select(
        "item_id", "root_id", F.coalesce("first_scan_id", "last_scan").alias("first_scan_id"),
        F.col("last_scan").alias("last_scan_id"), *state)
    return closed.unionByName(final)


# ---- reports ----------------------------------------------------------------------------------


def _report(parts: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("check"), "violations")
              for n, df in parts.items()]
    return reduce(DataFrame.unionByName, counts)


def consistency_report(old_items: DataFrame, state: State) -> DataFrame:
    """Compare a current-row table (item_id, is_deleted) with the versioned tables."""
    versions, items = state.versions, state.items
    newest = versions.groupBy("item_id").agg(F.max_by("is_deleted", "last_scan_id").alias("_gone"))
    sizes = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        for name, df in (("old", old_items), ("items", items), ("versions", versions))])
    count = {t: F.sum(F.when(F.col("table") == t, F.col("n"))) for t in ("old", "items", "versions")}
    sizes = sizes.agg(*[c.alias(t) for t, c in count.items()])
    return _report({
        "old item without identity": old_items.join(items, "item_id", "left_anti"),
        "item without version": items.join(versions, "item_id", "left_anti"),
        "deleted state differs": old_items.join(newest, "item_id").where(F.col("is_deleted") != F.col("_gone")),
        "item counts differ": sizes.where("old <> items"),
        "fewer versions than items": sizes.where("versions < items"),
    })


def invariant_report(state: State, deep: int = 40, span: int | None = MEASURE) -> DataFrame:
    """Counts of broken history rules, and of the special cases a test history should contain."""
    chain = with_neighbours(state.hashes, ["item_id", "item_version"], "first_scan_id", ["hash_state"],
                            sized(span, state.hashes, "first_scan_id"), next=None)
    firsts = chain.where(F.col("prev").isNull())
    per_item = state.versions.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("item_version").alias("top"))
    counted = state.versions.join(state.items.select("item_id", "item_type"), "item_id").where(
        (F.col("item_type") == DIRECTORY) & ~F.col("is_deleted"))
    return _report({
        "first hash is not baseline": firsts.where(F.col("hash_state") != BASELINE),
        "baseline after suspect": chain.where(
            (F.col("prev")["hash_state"] == SUSPECT) & (F.col("hash_state") == BASELINE)),
        "version numbers with gaps": per_item.where(F.col("n") != F.col("top")),
        "interval ends before it starts": state.versions.where(F.col("last_scan_id") < F.col("first_scan_id")),
        "overlapping versions": overlapping(state.versions, span),
        "negative folder counters": counted.where(F.col("unchanged_count") < 0),
        "items with deep histories": per_item.where(F.col("n") >= deep),
        "returned items": state.versions.where(F.col("is_added") & (F.col("item_version") > 1)).select("item_id").distinct(),
    })
