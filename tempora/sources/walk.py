"""Listing a mounted tree level by level, with everything a file source leaves out.

Each level is one Spark job over the folders of the level before, spread over tasks by folder, so
neither a deep nor a wide tree passes through the driver.  Names that begin with a dot or an
underscore, empty folders, links (never followed) and entries that cannot be read are all rows.  The
folder must be mounted under the same path on every executor, such as a network share.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.tree import synthesize_directories
from tempora.plans.sizing import scratch_path, write_and_read
from tempora.schemas import ACCESS_OK, DIRECTORY, FILE, META_ERROR, READ_ERROR
from tempora.sources.tables import qualified_path

SYMLINK, UNKNOWN = 2, 3
ENTRY = "item_path string, item_type int, access int, mod_date long, size long"
BATCH = 4_096  # entries handed on at once, so that one folder of any size needs little memory


def _entry(path: str) -> tuple:
    """One entry as it stands, links themselves and not what they point at."""
    try:
        s = os.lstat(path)
    except OSError:
        return path, UNKNOWN, META_ERROR, None, None
    kind = (DIRECTORY if stat.S_ISDIR(s.st_mode) else SYMLINK if stat.S_ISLNK(s.st_mode)
            else FILE if stat.S_ISREG(s.st_mode) else UNKNOWN)
    access = READ_ERROR if kind in (DIRECTORY, FILE) and not os.access(path, os.R_OK) else ACCESS_OK
    return path, kind, access, int(s.st_mtime // 1), s.st_size if kind == FILE else None


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"item_type": "int32", "access": "int32", "mod_date": "Int64", "size": "Int64"})

    for batch in batches:
        rows: list[tuple] = []
        for folder in batch["item_path"]:
            try:
                with os.scandir(folder) as found:
                    for entry in found:
                        rows.append(_entry(entry.path))
                        if len(rows) >= BATCH:
                            yield frame(rows)
                            rows = []
            except OSError:  # gone or closed since it was listed: its own row says so
                rows.append((folder, DIRECTORY, READ_ERROR, None, None))
        if rows:
            yield frame(rows)


def list_folders(folders: DataFrame) -> DataFrame:
    """Entries directly in the given folders (item_path); a folder that fails comes back itself."""
    return folders.select("item_path").mapInPandas(_list_folders, ENTRY)


def walk(spark: SparkSession, path: str, folders_per_task: int = 256) -> DataFrame:
    """Every entry below a mounted folder; the folder itself is no row.

    A folder that cannot be listed is one row with a read error.  A missing root gives one such row.
    Each level is written to the shared folder, so lost executors repeat one level only.
    """
    at = scratch_path(spark, "walk")
    folders = spark.createDataFrame([(qualified_path(spark, path).rstrip("/") or "/",)], "item_path string")
    todo, levels = 1, []
    while todo:
        tasks = max(1, -(-todo // folders_per_task))
        place = f"{at}/level={len(levels)}"
        level = write_and_read(list_folders(folders.repartition(tasks, "item_path")), place)
        levels.append(place)
        inner = (F.col("item_type") == DIRECTORY) & (F.col("access") == ACCESS_OK)
        folders = level.where(inner).select("item_path")
        todo = folders.count()
    rows = spark.read.schema(ENTRY).parquet(*levels)
    # a folder that its parent listed and that then failed has two rows: its times and the fault count
    return rows.groupBy("item_path").agg(*[F.max(c).alias(c) for c in ("item_type", "access", "mod_date", "size")])


def walk_tree(spark: SparkSession, path: str, root_id: int, scan_id: int) -> DataFrame:
    """Observations of a walk; folders carry the size of all files below them, empty ones zero."""
    found = walk(spark, path).withColumns({
        "root_id": F.lit(root_id).cast("long"), "scan_id": F.lit(scan_id).cast("long")})
    root = qualified_path(spark, path).rstrip("/")
    files = found.where(F.col("item_type") == FILE).withColumn("root_path", F.lit(root))
    sizes = synthesize_directories(files).select("item_path", F.col("size").alias("_below"))
    cols = ["root_id", "scan_id", "item_path", "item_type", "access", "mod_date", "size"]
    folder = F.col("item_type") == DIRECTORY
    return found.join(sizes, "item_path", "left").withColumn(
        "size", F.when(folder, F.coalesce("_below", F.lit(0))).otherwise(F.col("size"))).select(*cols)
