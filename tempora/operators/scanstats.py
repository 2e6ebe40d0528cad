"""Statistics of every scan from interval ends: no version is laid out over its scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.asof import with_previous
from tempora.operators.history import calendar, sized_calendar
from tempora.operators.tree import change_flags, roll_up
from tempora.plans.windows import with_neighbours, with_running
from tempora.schemas import BASELINE, DIRECTORY, FILE, INVALID, SUSPECT, VALID

POPULATION = ("file_count", "folder_count", "total_size")
INTEGRITY = (
    "val_unknown_count", "val_valid_count", "val_invalid_count", "val_no_validator_count",
    "hash_unknown_count", "hash_baseline_count", "hash_suspect_count",
)
CHANGES = ("add_count", "modify_count", "delete_count")
NEW_ISSUES = ("new_hash_suspect_count", "new_val_invalid_count")
LEVELS = POPULATION + INTEGRITY


def _deltas(df: DataFrame, by: Sequence[str],
            *entries: tuple[Column, Column, Column, dict[str, Column]]) -> DataFrame:
    """Signed rows out of each row in one pass: (condition, scan, whether after it, level changes)."""
    made = F.array(*[
        F.struct(keep.alias("keep"), scan.alias("scan_id"), after.alias("after"),
                 *[values.get(c, F.lit(0)).cast("long").alias(c) for c in LEVELS])
        for keep, scan, after, values in entries])
    rows = df.select(*by, F.explode(F.filter(made, lambda e: e.keep)).alias("_e"))
    return rows.select(*by, "_e.scan_id", "_e.after", *[f"_e.{c}" for c in LEVELS])


def _minus(values: dict[str, Column]) -> dict[str, Column]:
    return {k: -v for k, v in values.items()}


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("long")


def level_deltas(versions: DataFrame, items: DataFrame, hashes: DataFrame, by: Sequence[str],
                 span: int | None = None, recount: bool = False) -> DataFrame:
    """Signed rows (``by`` columns, scan_id, after, levels...): one adds, one takes away.

    A version counts from its first to its last scan.  Versions with the same interval are summed
    before they become signed rows, so what fans out is the number of distinct intervals.
    ``recount`` serves histories whose versions may overlap: a version then ends where the next one
    begins, and its validation counts from its first scan on.
    """
    extra = [c for c in by if c != "root_id"]
    if recount:
        versions = with_neighbours(versions, ["item_id"], "first_scan_id", ["first_scan_id"], span, prev=None)
        cut = F.col("next")["first_scan_id"]
        versions = versions.withColumn("_cut", F.when(cut <= F.col("last_scan_id"), cut))
    else:
        versions = versions.withColumn("_cut", F.lit(None).cast("long"))
    alive = versions.where(~F.col("is_deleted")).select(
        "item_id", "item_version", "root_id", "first_scan_id", "_cut", "size", "val_state",
        F.coalesce("_cut", "last_scan_id").alias("_end"), F.col("_cut").isNull().alias("_after"),
        F.col("first_scan_id" if recount else "val_scan_id").alias("_val_from"),
    ).join(items.select("item_id", "item_type", "has_validator", *extra), "item_id")
    is_file = F.col("item_type") == FILE
    checked = is_file & F.col("val_state").isNotNull()
    first, end, after = F.col("first_scan_id"), F.col("_end"), F.col("_after")
    always, before = F.lit(True), F.lit(False)
    alive = alive.withColumn("_val_from", F.when(checked, F.col("_val_from")))
    intervals = alive.groupBy(*by, "first_scan_id", "_end", "_after", "_val_from").agg(
        F.sum(_flag(is_file)).alias("files"),
        F.sum(_flag(F.col("item_type") == DIRECTORY)).alias("folders"),
        F.sum(F.when(is_file, F.coalesce("size", F.lit(0))).otherwise(0)).alias("bytes"),
        F.sum(_flag(is_file & F.col("has_validator"))).alias("checkable"),
        F.sum(_flag(checked & F.col("has_validator"))).alias("checked"),
        F.sum(_flag(checked & (F.col("val_state") == VALID))).alias("valid"),
        F.sum(_flag(checked & (F.col("val_state") == INVALID))).alias("invalid"),
    )
    counted = {
        "file_count": F.col("files"), "folder_count": F.col("folders"), "total_size": F.col("bytes"),
        "val_unknown_count": F.col("checkable"), "val_no_validator_count": F.col("files") - F.col("checkable"),
        "hash_unknown_count": F.col("files"),
    }
    judged = {
        "val_unknown_count": -F.col("checked"), "val_valid_count": F.col("valid"),
        "val_invalid_count": F.col("invalid"),
    }
    has_val = F.col("_val_from").isNotNull()
    ends = _deltas(
        intervals, by, (always, first, before, counted), (always, end, after, _minus(counted)),
        (has_val, F.col("_val_from"), before, judged), (has_val, end, after, _minus(judged)))
    seen = with_neighbours(hashes, ["item_id", "item_version"], "first_scan_id", ["first_scan_id"], span)
    seen = seen.select(
        "item_id", "item_version", F.col("first_scan_id").alias("_from"), "hash_state",
        F.col("prev").isNull().alias("_is_first"), F.col("next")["first_scan_id"].alias("_to"),
    ).join(alive.where(is_file), ["item_id", "item_version"])
    if recount:  # observations after the cut never show; the last one before it lasts until there
        shown = F.col("_cut").isNull() | (F.col("_from") < F.col("_cut"))
        seen = seen.where(shown).withColumn("_to", F.when(
            F.col("_cut").isNull() | (F.col("_to") < F.col("_cut")), F.col("_to")))
    is_last = F.col("_to").isNull()
    runs = seen.withColumns({"_until": F.coalesce("_to", end), "_past": is_last & after, "_is_last": is_last})
    runs = runs.groupBy(*by, "_from", "_until", "_past", "_is_first", "_is_last").agg(
        F.sum(_flag(F.col("hash_state") == BASELINE)).alias("baseline"),
        F.sum(_flag(F.col("hash_state") == SUSPECT)).alias("suspect"), F.count(F.lit(1)).alias("n"))
    states = {"hash_baseline_count": F.col("baseline"), "hash_suspect_count": F.col("suspect")}
    observed = _deltas(
        runs, by,
        (always, F.col("_from"), before,
         {**states, "hash_unknown_count": F.when(F.col("_is_first"), -F.col("n")).otherwise(0)}),
        (always, F.col("_until"), F.col("_past"),
         {**_minus(states), "hash_unknown_count": F.when(F.col("_is_last"), F.col("n")).otherwise(0)}))
    return ends.unionByName(observed)


def scan_levels(versions: DataFrame, items: DataFrame, hashes: DataFrame, scans: DataFrame,
                span: int | None = None, recount: bool = False) -> DataFrame:
    """Population, size and integrity-state counts of every completed scan.

    The signed rows are summed per scan (map-side first) and only that scan-sized table is
    accumulated in order.
    """
    rows = level_deltas(versions, items, hashes, ["root_id"], span, recount)
    per_scan = rows.groupBy("root_id", "scan_id", "after").agg(*[F.sum(c).alias(c) for c in LEVELS])
    cal = calendar(scans).select("root_id", "scan_id", "ord")
    placed = per_scan.join(cal, ["root_id", "scan_id"]).select(
        "root_id", (F.col("ord") + F.col("after").cast("long")).alias("ord"), *LEVELS)
    summed = placed.groupBy("root_id", "ord").agg(*[F.sum(c).alias(c) for c in LEVELS])
    w = Window.partitionBy("root_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return cal.join(summed, ["root_id", "ord"], "left").select(
        "root_id", "scan_id", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in LEVELS])


def folder_levels(versions: DataFrame, items: DataFrame, hashes: DataFrame, roots: DataFrame,
                  scans: DataFrame, span: int | None = None) -> DataFrame:
    """Integrity-state counts of the files below each folder, for every scan that shows any.

    The signed rows roll up to all ancestors, are accumulated per folder, and each step is laid out
    over the scans until the next step: the result has one row per folder and scan by nature.
    """
    cols = ["file_count", *INTEGRITY]
    files = items.where(F.col("item_type") == FILE)
    rows = level_deltas(versions, files, hashes, ["root_id", "parent_path"], span)
    folded = roll_up(rows.join(roots, "root_id"), ["root_id", "scan_id", "after"], cols)
    cal, bound = sized_calendar(scans)
    cal, span = cal.select("root_id", "scan_id", "ord"), span or bound
    steps = folded.join(cal, ["root_id", "scan_id"]).groupBy(
        "root_id", "folder_path", (F.col("ord") + F.col("after").cast("long")).alias("ord")
    ).agg(*[F.sum(c).alias(c) for c in cols])
    key = ["root_id", "folder_path"]
    steps = with_running(steps, key, "ord", span, sums={c: F.col(c) for c in cols})
    steps = with_neighbours(steps, key, "ord", ["ord"], span, prev=None)
    ends = cal.groupBy("root_id").agg(F.max("ord").alias("_end"))
    until = F.coalesce(F.col("next")["ord"] - 1, F.col("_end"))
    laid = steps.where(F.col("file_count") > 0).join(ends, "root_id").withColumn(
        "ord", F.explode(F.sequence(F.col("ord"), until)))
    return laid.join(cal, ["root_id", "ord"]).select("root_id", "scan_id", "folder_path", *cols)


def scan_changes(versions: DataFrame, span: int | None = None) -> DataFrame:
    """Adds, modifications and deletions of every scan, against each row's previous version."""
    flagged = change_flags(with_previous(versions.select(
        "item_id", "root_id", "first_scan_id", "is_deleted"), ["is_deleted"], span))
    return flagged.groupBy("root_id", F.col("first_scan_id").alias("scan_id")).agg(
        F.sum("adds").alias("add_count"), F.sum("mods").alias("modify_count"),
        F.sum("dels").alias("delete_count"))


def new_issues(versions: DataFrame, hashes: DataFrame) -> DataFrame:
    """New suspect hashes and new invalid validations per scan."""
    suspects = hashes.where(F.col("hash_state") == SUSPECT).groupBy(
        F.col("first_scan_id").alias("scan_id")).agg(F.count(F.lit(1)).alias("new_hash_suspect_count"))
    invalid = versions.where(F.col("val_state") == INVALID).groupBy(
        F.col("val_scan_id").alias("scan_id")).agg(F.count(F.lit(1)).alias("new_val_invalid_count"))
    return suspects.join(invalid, "scan_id", "full")


def scan_statistics(versions: DataFrame, items: DataFrame, hashes: DataFrame, scans: DataFrame,
                    span: int | None = None, recount: bool = False) -> DataFrame:
    """All counters of every completed scan."""
    out = (
        scan_levels(versions, items, hashes, scans, span, recount)
        .join(scan_changes(versions, span).drop("root_id"), "scan_id", "left")
        .join(new_issues(versions, hashes), "scan_id", "left")
    )
    return out.fillna(0, [*CHANGES, *NEW_ISSUES])


def with_statistics(scans: DataFrame, stats: DataFrame) -> DataFrame:
    """Scans with their counters replaced by freshly computed ones."""
    counters = [c for c in stats.columns if c not in ("scan_id", "root_id")]
    return scans.drop(*counters).join(stats.drop("root_id"), "scan_id", "left").select(*scans.columns)
