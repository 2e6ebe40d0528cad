"""Content analysis: what needs hashing or validating, and merging the results back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.containers import FAULTS, content_fault
from tempora.operators.asof import with_latest_hash
from tempora.schemas import ACCESS_OK, FILE, INVALID, META_ERROR, READ_ERROR, VALID, State

VERSION = ("item_id", "item_version")


def work_candidates(state: State, root_id: int, scan_id: int, hash_mode: str = "none",
                    validate: bool = False, disabled_extensions: Sequence[str] = ()) -> DataFrame:
    """Readable files alive at the scan with ``needs_hash`` and ``needs_val``.

    ``hash_mode``: "none", "new" (never hashed) or "all" (not yet hashed by this scan).
    """
    if hash_mode not in ("none", "new", "all"):
        raise ValueError(f"unknown hash mode {hash_mode!r}")
    alive = state.versions.where(
        (F.col("root_id") == root_id) & (F.col("last_scan_id") == scan_id)
        & ~F.col("is_deleted") & (F.col("access") != META_ERROR))
    files = state.items.where((F.col("root_id") == root_id) & (F.col("item_type") == FILE)).select(
        "item_id", "item_path", "file_extension", "has_validator", "do_not_validate")
    rows = with_latest_hash(alive, state.hashes.where(F.col("root_id") == root_id)).join(files, "item_id")
    unhashed = F.col("file_hash").isNull()
    needs_hash = {
        "none": F.lit(False),
        "new": unhashed,
        "all": unhashed | (F.col("hash_last_scan_id") < scan_id),
    }[hash_mode]
    needs_val = F.lit(validate) & F.col("has_validator") & ~F.col("do_not_validate") & F.col("val_state").isNull()
    if disabled_extensions:
        needs_val = needs_val & ~F.coalesce(F.col("file_extension").isin(*disabled_extensions), F.lit(False))
    return rows.withColumns({"needs_hash": needs_hash, "needs_val": needs_val})


def work_list(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("needs_hash") | F.col("needs_val"))


def work_totals(candidates: DataFrame, scan_id: int) -> DataFrame:
    """How many items need work, and how many of those this scan has already done."""
    done = (F.col("needs_hash") & (F.col("hash_last_scan_id") == scan_id)) | (
        F.col("needs_val") & (F.col("val_scan_id") == scan_id))
    return candidates.agg(
        F.count_if(F.col("needs_hash") | F.col("needs_val")).alias("total_needed"),
        F.count_if(done).alias("total_done"))


def remaining_work(work: DataFrame, results: DataFrame) -> DataFrame:
    """Resume: what has no result written yet, whatever order the tasks finished in."""
    return work.join(results, list(VERSION), "left_anti")


def merge_validation(versions: DataFrame, results: DataFrame, scan_id: int) -> DataFrame:
    """Write (val_state, val_error) once per version; only valid and invalid are kept."""
    new = results.where(F.col("val_state").isin(VALID, INVALID)).select(
        *VERSION, F.col("val_state").alias("_state"), F.col("val_error").alias("_error"))
    fresh = F.col("val_state").isNull() & F.col("_state").isNotNull()
    return versions.join(new, list(VERSION), "left").withColumns({
        "val_scan_id": F.when(fresh, F.lit(scan_id)).otherwise(F.col("val_scan_id")),
        "val_error": F.when(fresh, F.col("_error")).otherwise(F.col("val_error")),
        "val_state": F.when(fresh, F.col("_state")).otherwise(F.col("val_state")),
    }).select(*versions.columns)


def access_after_read(outcome: Column) -> Column:
    """Access from a read attempt: "missing", "denied" or "read"."""
    return F.when(outcome == "missing", META_ERROR).when(outcome == "denied", READ_ERROR) \
        .when(outcome == "read", ACCESS_OK)


def reconcile_access(versions: DataFrame, outcomes: DataFrame, scan_id: int,
                     prev_scan_id: int | None) -> DataFrame:
    """Apply changed access: in place where the version began at this scan, else as a new version.

    ``outcomes`` holds item_id, item_version, outcome.  Hash and validation results stay with the
    version they were made for, so a split file starts without them.
    """
    met = versions.join(outcomes.select(*VERSION, "outcome"), list(VERSION), "left").withColumn(
        "_access", F.coalesce(access_after_read(F.col("outcome")), F.col("access")))
    changed = F.col("_access") != F.col("access")
    here = F.col("first_scan_id") == scan_id
    close = F.lit(prev_scan_id) if prev_scan_id is not None else F.col("last_scan_id")
    kept = met.withColumns({
        "access": F.when(changed & here, F.col("_access")).otherwise(F.col("access")),
        "last_scan_id": F.when(changed & ~here, close).otherwise(F.col("last_scan_id")),
    })
    fresh = {
        "item_version": F.col("item_version") + 1, "first_scan_id": F.lit(scan_id),
        "last_scan_id": F.lit(scan_id), "is_added": F.lit(False), "is_deleted": F.lit(False),
        "access": F.col("_access"),
    }
    keep = {"item_id", "root_id", "mod_date", "size"}
    types = {f.name: f.dataType for f in versions.schema.fields}
    added = met.where(changed & ~here).select(*[
        (fresh[c] if c in fresh else F.col(c) if c in keep else F.lit(None)).cast(types[c]).alias(c)
        for c in versions.columns])
    return kept.select(*versions.columns).unionByName(added)


def drop_stale(results: DataFrame, expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Keep results only of files whose size and mod_date did not move since they were listed.

    An expected null is not checked; a file that the new listing lacks is dropped.
    """
    old = expected.select("item_path", F.col("mod_date").alias("_m"), F.col("size").alias("_s"))
    now = listing.select("item_path", F.col("mod_date").alias("_nm"), F.col("size").alias("_ns"))
    same = (F.col("_m").isNull() | (F.col("_m") == F.col("_nm"))) & (
        F.col("_s").isNull() | (F.col("_s") == F.col("_ns")))
    return results.join(old, "item_path").join(now, "item_path").where(same).select(*results.columns)


# ---- content checks ---------------------------------------------------------------------------

# Leading bytes of known file kinds, in hex.
MAGIC = {"pdf": ("25504446",), "png": ("89504E47",), "gif": ("47494638",), "jpg": ("FFD8FF",),
         "jpeg": ("FFD8FF",), "flac": ("664C6143",), "bmp": ("424D",), "tiff": ("49492A00", "4D4D002A")}


def has_magic(content: Column, extension: Column) -> Column:
    """Whether binary content starts as its extension promises; null for other extensions."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for ext, heads in MAGIC.items():
        hit = reduce(or_, [head.startswith(h) for h in heads])
        out = F.when(extension == ext, hit) if out is None else out.when(extension == ext, hit)
    return out


def is_whole_html(text: Column) -> Column:
    return F.endswith(F.rtrim(F.lower(text)), F.lit("</html>"))


def check_content(files: DataFrame) -> DataFrame:
    """Validation results of files (content, file_extension): the container's structure decides.

    Kinds without a check get no result (null state); null content counts as unreadable.
    """
    known = F.coalesce(F.lower("file_extension").isin(*FAULTS), F.lit(False))
    rows = files.withColumn("val_error", content_fault(F.col("content"), F.col("file_extension")))
    return rows.withColumn("val_state", F.when(F.col("val_error").isNotNull(), INVALID).when(known, VALID))


def run_checks(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Evaluate named rules (true = passed); the first failed one becomes the error text."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.withColumns({
        "val_error": error,
        "val_state": F.when(error.isNull(), VALID).otherwise(INVALID),
    })
