"""State tables on storage: read one version, publish the next one atomically.

Each version of the store lives in its own folder ``v=<n>``; a version counts only once its marker
in ``published`` exists, so a job that dies half-way leaves nothing visible, and writing the same
version again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.schemas import TABLES, State, conform

PARTITIONED = {"versions", "items", "hashes"}


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def _paths(spark: SparkSession, text: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(text)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified_path(spark: SparkSession, text: str) -> str:
    """The absolute path a text names, without scheme and authority, dots and doubled slashes resolved."""
    path, fs = _paths(spark, text)
    return fs.makeQualified(path).toUri().normalize().getPath()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _paths(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    folder, fs = _paths(spark, path)
    fs.delete(folder, True)


def published_versions(spark: SparkSession, base: str) -> list[int]:
    folder, fs = _paths(spark, f"{base}/published")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder))


def write_table(df: DataFrame, name: str, base: str, version: int) -> DataFrame:
    """Write one table of an unpublished version and return it as read back.

    Large tables are partitioned by root.  A rebalance lets AQE cut a large root into several files
    and put small ones together; rows are sorted by item so that scans can skip row groups.
    """
    spark, path = df.sparkSession, f"{base}/v={version}/{name}"
    out = conform(df, name)
    if name in PARTITIONED:
        out.hint("rebalance", "root_id").sortWithinPartitions("root_id", "item_id") \
            .write.mode("overwrite").partitionBy("root_id").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return read_table(spark, path, name)


def publish(spark: SparkSession, base: str, version: int) -> None:
    """Make a completely written version visible with one atomic file creation."""
    marker, fs = _paths(spark, f"{base}/published/{version}")
    fs.create(marker, True).close()


def write_state(state: State, base: str, version: int) -> None:
    """Write every table of a new version, then publish it."""
    for name, df in state.tables().items():
        write_table(df, name, base, version)
    publish(state.versions.sparkSession, base, version)


def read_state(spark: SparkSession, base: str, version: int | None = None) -> State:
    """The given or newest published version."""
    known = published_versions(spark, base)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no published version {version or ''} under {base}")
    at = f"{base}/v={known[-1] if version is None else version}"

    def load(name: str):
        folder, fs = _paths(spark, f"{at}/{name}")
        return read_table(spark, f"{at}/{name}", name) if fs.exists(folder) else None

    return State(**{name: load(name) for name in TABLES})
