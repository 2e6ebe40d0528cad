"""Integrity issues of versions and their review state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.filters import text_match
from tempora.operators.browse import natural_order
from tempora.operators.domains import page
from tempora.schemas import FILE, INVALID, SUSPECT, State

# Extension groups offered as filters.
EXTENSION_GROUPS = {
    "images": ("jpg", "jpeg", "png", "gif", "tiff", "bmp"),
    "pdf": ("pdf",),
    "flac": ("flac",),
}
VERSION = ("item_id", "item_version")


@dataclass(frozen=True)
class IssueFilter:
    issue_type: str = "all"        # all, val, hash
    status: str = "unreviewed"     # unreviewed, reviewed, all
    root_id: int | None = None
    path_text: str | None = None
    extensions: Sequence[str] = ()
    show_deleted: bool = False


def with_suspects(versions: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add hash and suspect-hash counts per version, aggregated before the join."""
    counts = hashes.groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("hash_count"),
        F.count_if(F.col("hash_state") == SUSPECT).alias("suspect_count"))
    return versions.join(counts, list(VERSION), "left").fillna(0, ["hash_count", "suspect_count"])


def has_val_issue() -> Column:
    return F.col("val_state").eqNullSafe(F.lit(INVALID))


def has_hash_issue() -> Column:
    return F.col("suspect_count") > 0


def issue_predicate(issue_type: str, status: str, three_valued: bool = False) -> Column:
    """Which versions count; "reviewed" over both kinds means an issue and nothing left open.

    ``three_valued`` compares a missing validation as unknown, as plain SQL does: a version that was
    never validated then drops out of "reviewed" even when its hash issue is reviewed.
    """
    val = F.col("val_state") == INVALID if three_valued else has_val_issue()
    val_open = val & F.col("val_reviewed_at").isNull()
    hash_open = has_hash_issue() & F.col("hash_reviewed_at").isNull()
    forms = {
        "val": (val, val_open),
        "hash": (has_hash_issue(), hash_open),
        "all": (val | has_hash_issue(), val_open | hash_open),
    }
    any_issue, is_open = forms[issue_type]
    return {"all": any_issue, "unreviewed": is_open, "reviewed": any_issue & ~is_open}[status]


def issue_versions(state: State, f: IssueFilter) -> DataFrame:
    """Versions of files matching the whole filter, with their item's columns."""
    items, versions, hashes = state.items.where(F.col("item_type") == FILE), state.versions, state.hashes
    if f.root_id is not None:
        items, versions, hashes = (df.where(F.col("root_id") == f.root_id) for df in (items, versions, hashes))
    if f.path_text:
        items = items.where(text_match(F.col("item_path"), f.path_text, wildcards=True))
    if f.extensions:
        items = items.where(F.col("file_extension").isin(*f.extensions))
    if not f.show_deleted:
        versions = versions.where(~F.col("is_deleted"))
    rows = with_suspects(versions, hashes).where(issue_predicate(f.issue_type, f.status))
    return rows.join(items.drop("root_id", "parent_path"), "item_id")


def count_issue_items(state: State, f: IssueFilter) -> DataFrame:
    return issue_versions(state, f).agg(F.count_distinct("item_id").alias("count"))


def issue_items(state: State, f: IssueFilter) -> DataFrame:
    """Per item the reviewed and unreviewed matching versions of each kind, and its latest scan."""
    def count(kind: str, has: Column, reviewed: bool) -> Column:
        if f.issue_type not in ("all", kind):
            return F.lit(0).cast("long")
        at = F.col(f"{kind}_reviewed_at")
        return F.count_if(has & (at.isNotNull() if reviewed else at.isNull()))

    return issue_versions(state, f).groupBy(
        "item_id", "item_path", "item_name", "file_extension", "do_not_validate"
    ).agg(
        count("hash", has_hash_issue(), False).alias("hash_unreviewed"),
        count("hash", has_hash_issue(), True).alias("hash_reviewed"),
        count("val", has_val_issue(), False).alias("val_unreviewed"),
        count("val", has_val_issue(), True).alias("val_reviewed"),
        F.max("last_scan_id").alias("latest_scan_id"),
    )


def issue_items_page(state: State, f: IssueFilter, limit: int, offset: int = 0) -> DataFrame:
    """A page of ``issue_items`` in natural order of their paths.

    Ties go to the smaller item.
    """
    return page(natural_order(issue_items(state, f)), limit, offset)


def _of_root(df: DataFrame, root_id: int | None) -> DataFrame:
    return df if root_id is None else df.where(F.col("root_id") == root_id)


def _suspects_of(state: State, chosen: DataFrame, root_id: int | None) -> DataFrame:
    """``with_suspects`` of the versions that ``chosen`` names by its columns; no other hashes are counted."""
    key = chosen.columns
    versions, hashes = (_of_root(df, root_id).join(chosen, key, "left_semi") for df in (state.versions, state.hashes))
    return with_suspects(versions, hashes)


def issue_versions_of(state: State, item_ids: DataFrame, f: IssueFilter, root_id: int | None = None) -> DataFrame:
    """Matching versions of the given items with scan date and hash counts.

    Only the issue type and status of the filter apply here, deleted versions included.  ``root_id`` says
    that all the items lie below one root, so that only its partitions are read.
    """
    rows = _suspects_of(state, item_ids.select("item_id"), root_id).where(issue_predicate(f.issue_type, f.status))
    return rows.join(state.scans.select(F.col("scan_id").alias("first_scan_id"), "started_at"), "first_scan_id") \
        .select("item_id", "item_version", F.col("first_scan_id").alias("scan_id"), "started_at",
                "hash_count", "suspect_count", "val_state", "val_error", "val_reviewed_at", "hash_reviewed_at")


def count_issue_versions_of(state: State, item_ids: DataFrame, f: IssueFilter, root_id: int | None = None) -> DataFrame:
    """How many versions ``issue_versions_of`` finds."""
    return issue_versions_of(state, item_ids, f, root_id).agg(F.count(F.lit(1)).alias("count"))


def issue_versions_page(state: State, item_ids: DataFrame, f: IssueFilter, limit: int, offset: int = 0,
                        root_id: int | None = None) -> DataFrame:
    """A page of ``issue_versions_of``, newest versions first."""
    rows = issue_versions_of(state, item_ids, f, root_id)
    return page(rows.orderBy(F.desc("item_version"), "item_id"), limit, offset)


# ---- changing the review state ----------------------------------------------------------------


def review_changes(state: State, target: DataFrame, at: int | None, kinds: Sequence[str] = ("val", "hash"),
                   root_id: int | None = None) -> DataFrame:
    """The versions whose marks a review changes, with a flag for each kind (``val_hit``, ``hash_hit``).

    Only versions and hashes of the target rows are read beyond their keys.
    """
    rows = _suspects_of(state, target.select(*[c for c in VERSION if c in target.columns]).distinct(), root_id)
    has = {"val": has_val_issue(), "hash": has_hash_issue()}
    hits = {}
    for kind in ("val", "hash"):
        mark = F.col(f"{kind}_reviewed_at")
        due = mark.isNull() if at is not None else mark.isNotNull()
        hits[f"{kind}_hit"] = has[kind] & due if kind in kinds else F.lit(False)
    return rows.select(*VERSION, *[h.alias(n) for n, h in hits.items()]).where(F.col("val_hit") | F.col("hash_hit"))


def review(state: State, target: DataFrame, at: int | None, kinds: Sequence[str] = ("val", "hash"),
           root_id: int | None = None, whole: bool = True):
    """Set (``at``) or clear (None) the review of issue versions of the target rows.

    ``target`` has item_id, and item_version where single versions are meant.  Marks are set only
    where absent and cleared only where present.  Returns (versions, affected): the number of
    changed marks, validation and hash counted apart and added.  ``root_id`` says that the targets lie
    below one root; what they hold is then looked for there alone, and without ``whole`` only that
    root's versions come back, which is what a commit of the root writes.
    """
    changes = review_changes(state, target, at, kinds, root_id)
    affected = changes.agg((F.count_if("val_hit") + F.count_if("hash_hit")).alias("affected"))
    versions = state.versions if whole else _of_root(state.versions, root_id)
    done = versions.join(changes, list(VERSION), "left").withColumns({
        f"{k}_reviewed_at": F.when(F.col(f"{k}_hit"), F.lit(at).cast("long")).otherwise(F.col(f"{k}_reviewed_at"))
        for k in ("val", "hash")})
    return done.select(*state.versions.columns), affected


def review_by_filter(state: State, f: IssueFilter, at: int | None, kinds: Sequence[str] = ("val", "hash"),
                     whole: bool = True):
    """Review all issue versions of every item that has at least one match of the filter."""
    return review(state, issue_versions(state, f).select("item_id"), at, kinds, f.root_id, whole)


def set_do_not_validate(items: DataFrame, chosen: DataFrame, value: bool = True) -> DataFrame:
    hits = chosen.select("item_id").distinct().withColumn("_hit", F.lit(True))
    return items.join(hits, "item_id", "left").withColumn(
        "do_not_validate", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("do_not_validate"))
    ).select(*items.columns)
