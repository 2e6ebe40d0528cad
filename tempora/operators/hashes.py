"""Content hashing and drift: baseline and suspect observations of each version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.asof import latest_hashes
from tempora.plans.windows import MEASURE, sized, with_neighbours
from tempora.schemas import BASELINE, SUSPECT

VERSION = ("item_id", "item_version")


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of text or bytes."""
    return F.sha2(content.cast("binary"), 256)


def drift_history(observed: DataFrame, span: int | None = MEASURE) -> DataFrame:
    """Hash intervals of each version from all its observations (file_hash, scan_id).

    The first hash is the baseline; every later change opens a suspect interval, also when an
    earlier value returns.  Null hashes are not observations.  Of each interval only the first and last
    observation are kept, which then stand next to each other in the one order that everything uses.
    """
    span = sized(span, observed, "scan_id")
    rows = with_neighbours(observed.where(F.col("file_hash").isNotNull()), VERSION, "scan_id",
                           ["file_hash"], span)
    prev, after = F.col("prev"), F.col("next")
    starts = prev.isNull() | (prev["file_hash"] != F.col("file_hash"))
    ends = after.isNull() | (after["file_hash"] != F.col("file_hash"))
    edges = rows.select(
        *VERSION, "root_id", "scan_id", "file_hash", prev.isNull().alias("_first"), starts.alias("_starts"),
        F.when(ends, F.col("scan_id")).alias("_last")).where(F.col("_starts") | F.col("_last").isNotNull())
    edges = with_neighbours(edges, VERSION, "scan_id", ["_last"], span, prev=None)
    return edges.where("_starts").select(
        *VERSION, "root_id", F.col("scan_id").alias("first_scan_id"),
        F.coalesce("_last", F.col("next")["_last"]).alias("last_scan_id"), "file_hash",
        F.when(F.col("_first"), BASELINE).otherwise(SUSPECT).alias("hash_state"))


def merge_hashes(hashes: DataFrame, observed: DataFrame, scan_id: int) -> DataFrame:
    """Apply one scan's observations (item_id, item_version, root_id, file_hash) to the table."""
    seen = observed.where(F.col("file_hash").isNotNull()).select(
        *VERSION, "root_id", F.col("file_hash").alias("new_hash"))
    latest = latest_hashes(hashes).select(*VERSION, "hash_first_scan_id", F.col("file_hash").alias("old_hash"))
    met = seen.join(latest, list(VERSION), "left")
    same = F.col("old_hash").isNotNull() & (F.col("old_hash") == F.col("new_hash"))
    extend = met.where(same).select(
        *VERSION, F.col("hash_first_scan_id").alias("first_scan_id"), F.lit(True).alias("_hit"))
    kept = hashes.join(extend, [*VERSION, "first_scan_id"], "left").withColumn(
        "last_scan_id", F.when(F.col("_hit"), F.lit(scan_id)).otherwise(F.col("last_scan_id")))
    added = met.where(~same).select(
        *VERSION, "root_id", F.lit(scan_id).alias("first_scan_id"), F.lit(scan_id).alias("last_scan_id"),
        F.col("new_hash").alias("file_hash"),
        F.when(F.col("old_hash").isNull(), BASELINE).otherwise(SUSPECT).alias("hash_state"))
    cols = [*VERSION, "root_id", "first_scan_id", "last_scan_id", "file_hash", "hash_state"]
    return kept.select(*cols).unionByName(added.select(*cols))


def duplicate_content(hashes: DataFrame, at_least: int = 2) -> DataFrame:
    """Content shared by several observations; counts combine map-side, so one hot hash is cheap."""
    return hashes.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def purge_suspects(versions: DataFrame, hashes: DataFrame, scans: DataFrame):
    """Drop suspect observations, clear hash reviews and count former suspects as baseline."""
    cleared = versions.withColumn("hash_reviewed_at", F.lit(None).cast("long"))
    had = F.col("hash_suspect_count") > 0
    counted = scans.withColumns({
        "hash_baseline_count": F.when(had, F.col("hash_baseline_count") + F.col("hash_suspect_count"))
        .otherwise(F.col("hash_baseline_count")),
        "hash_suspect_count": F.when(F.col("hash_suspect_count").isNotNull(), 0).cast("long"),
        "new_hash_suspect_count": F.when(F.col("new_hash_suspect_count").isNotNull(), 0).cast("long"),
    })
    return cleared, hashes.where(F.col("hash_state") != SUSPECT), counted
