"""File listings and content hashes through Spark's binary file source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.hashes import content_hash
from tempora.operators.tree import synthesize_directories
from tempora.schemas import ACCESS_OK, FILE
from tempora.sources.tables import qualified_path


def _plain(path: Column) -> Column:
    """A listed path without scheme and authority."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def list_files(spark: SparkSession, path: str, root_id: int, scan_id: int) -> DataFrame:
    """One observation per file; contents are never read because the column is pruned."""
    return _binary(spark, path).select(
        F.lit(root_id).cast("long").alias("root_id"), F.lit(scan_id).cast("long").alias("scan_id"),
        _plain(F.col("path")).alias("item_path"), F.lit(FILE).alias("item_type"), F.lit(ACCESS_OK).alias("access"),
        F.unix_seconds("modificationTime").alias("mod_date"), F.col("length").alias("size"),
    )


def list_tree(spark: SparkSession, path: str, root_id: int, scan_id: int) -> DataFrame:
    """File observations plus folders with recursive sizes; any spelling of the path will do."""
    files = list_files(spark, path, root_id, scan_id)
    root = qualified_path(spark, path).rstrip("/")
    dirs = synthesize_directories(files.withColumn("root_path", F.lit(root)))
    return files.unionByName(dirs.select(*files.columns))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path).select(
        _plain(F.col("path")).alias("item_path"),
        content_hash(F.col("content")).alias("file_hash"))
