"""Size-checked broadcasts, shared scratch space and distributed id allocation."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
RANGE_ROWS = 1_000_000  # rows of a range, beyond a thousand ranges
RANGE_FANOUT = 32  # ranges are found in two steps of at least this many comparisons
RANGE_SAMPLE = 16  # sampled keys per range


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that at most ``max_rows`` rows exist.

    The check stops after ``max_rows + 1`` rows.  Larger inputs are returned without a hint, so the
    join is planned as a shuffle join that AQE may split on skew.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


_local_scratch: str | None = None


def name_local_scratch(path: str) -> None:
    """The folder for sessions on a local master that name none themselves."""
    global _local_scratch
    _local_scratch = path


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = _local_scratch
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "tempora", uuid.uuid4().hex, name)


def write_and_read(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int | None = None) -> DataFrame:
    """Cut lineage through a written table, which survives the loss of executors.

    Readers lay all rows of a file out at once, up to some thousands: ``rows_per_file`` keeps very large rows apart.
    """
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _struct_ddl(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">"


def number_rows(df: DataFrame, order: Sequence[str], out: str, start: Column | int = 0) -> DataFrame:
    """Dense numbers ``start+1 ..`` in ``order`` without one global window.

    Range splitters are taken from a small hash sample of the (unique) order keys; rows are numbered
    inside their range and shifted by the size of the ranges before it.  The numbers depend only on
    the order, never on the splitters, so recomputed tasks agree.
    """
    keys = df.select(*order)
    total = keys.count()
    key = F.struct(*order)
    fanout = max(RANGE_FANOUT, math.ceil(math.sqrt(total / RANGE_ROWS)))
    stride = max(1, total // (RANGE_SAMPLE * fanout * fanout))
    sample = keys.where(F.pmod(F.xxhash64(*order), F.lit(stride)) == 0)
    # a bounded number of keys: RANGE_SAMPLE for each range
    picked = [r[0] for r in sample.select(key.alias("k")).orderBy("k").select(F.to_json("k")).collect()]
    edges = picked[:: max(1, len(picked) // (fanout * fanout))]
    groups = [edges[i:i + fanout] for i in range(0, len(edges), fanout)]
    ddl = f"array<array<{_struct_ddl(keys)}>>"
    nested = F.from_json(F.lit("[" + ",".join(f"[{','.join(g)}]" for g in groups) + "]"), ddl)
    heads = F.transform(nested, lambda g: F.element_at(g, 1))
    group = F.size(F.filter(heads, lambda e: e <= key))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(group, F.lit(1))), lambda e: e <= key))
    bucket = F.when(group == 0, 0).otherwise((group - 1) * fanout + inside)
    # never null: else Spark would test each bucket for null, far below, on every row the keys are made from
    bucket = F.coalesce(bucket, F.lit(0))
    df = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        df.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (base + F.col("_before") + F.col("_place")).cast("long"))
        .drop("_bucket", "_place", "_before")
    )
