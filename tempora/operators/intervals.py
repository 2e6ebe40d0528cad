"""The path tree as nested intervals: below a folder means between two numbers.

Items are laid out in pre-order (paths compared folder by folder), each folder followed by a mark after
its last descendant, and numbered densely.  An item's ``lo`` is its own number, its ``hi`` the number of its
mark (files: ``lo``).  Everything below a folder lies in an integer range, so a table stored in that
order skips row groups, and what folders hold is the difference of two running sums: no path is
compared and no row is multiplied by its ancestors, however deep the tree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.plans.sizing import number_rows, scratch_path, write_and_read
from tempora.plans.windows import with_running
from tempora.schemas import DIRECTORY

SPAN = 100_000  # numbers that one task sums up
LAST = "\U0010ffff"  # sorts after any name


def numbered(items: DataFrame) -> DataFrame:
    """``root_id, item_id, item_type, item_path, n, mark``: items and the marks of folders in pre-order."""
    parts = F.split("item_path", "/")
    rows = items.select("root_id", "item_id", "item_type", "item_path", parts.alias("at"), F.lit(False).alias("mark"))
    marks = rows.where(F.col("item_type") == DIRECTORY).withColumns({"at": F.concat("at", F.array(F.lit(LAST))), "mark": F.lit(True)})
    laid = write_and_read(rows.unionByName(marks), scratch_path(items.sparkSession, "pre-order"))
    # the type parts a file from a folder of the same path
    return number_rows(laid, ["root_id", "at", "item_type", "item_id", "mark"], "n").drop("at")


def intervals(items: DataFrame) -> DataFrame:
    """``items`` with their ``lo`` and ``hi``."""
    ends = numbered(items).groupBy("root_id", "item_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return items.join(ends, ["root_id", "item_id"])


def write_intervals(items: DataFrame, path: str) -> DataFrame:
    """Store items by root in pre-order, with statistics on ``lo`` that let a range skip row groups."""
    made = intervals(items).repartitionByRange("root_id", "lo").sortWithinPartitions("root_id", "lo")
    made.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("root_id").parquet(path)
    return items.sparkSession.read.parquet(path)


def below(laid: DataFrame, root_id: int, folder: str) -> DataFrame:
    """All items below a folder; its ends are looked up first, so the range is a filter of the scan."""
    of_root = laid.where(F.col("root_id") == root_id)
    ends = of_root.where((F.col("item_path") == folder) & (F.col("item_type") == DIRECTORY)).select("lo", "hi").first()
    if ends is None:
        return of_root.limit(0)
    return of_root.where((F.col("lo") > ends["lo"]) & (F.col("lo") < ends["hi"]))


def totals(items: DataFrame, values: DataFrame, sums: Mapping[str, Column], by: tuple[str, ...] = (), span: int | None = SPAN) -> DataFrame:
    """``root_id, item_id, item_path`` and the sums of every folder over all that lies below it.

    ``values`` has root_id, item_id, the columns of ``by`` and whatever ``sums`` are made of; items
    without a row there count as nothing.  With ``by`` each of its values has its own sums; folders
    appear under those values that occur below them.
    """
    laid = write_and_read(numbered(items), scratch_path(items.sparkSession, "numbered"))
    parts = {f"_{i}": c for i, c in enumerate(sums.values())}
    worth = values.groupBy("root_id", "item_id", *by).agg(*[F.sum(c).alias(p) for p, c in parts.items()])
    worth = laid.where(~F.col("mark")).select("root_id", "item_id", "n").join(worth, ["root_id", "item_id"]).drop("item_id")
    folders = laid.where(F.col("item_type") == DIRECTORY).groupBy("root_id", "item_id", "item_path").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    kinds = worth.select("root_id", *by).distinct()  # by each value of ``by``, as it is used by whole snapshots
    ends = folders.join(kinds, "root_id") if by else folders
    asked = ends.select("root_id", "item_id", "item_path", *by, F.explode(F.array("lo", "hi")).alias("n"), F.lit(0).alias("_end"))
    blank = {p: F.lit(None).cast(t) for p, t in ((p, worth.schema[p].dataType) for p in parts)}
    rows = worth.withColumns({"item_id": F.lit(None).cast("long"), "item_path": F.lit(None).cast("string"), "_end": F.lit(1)}) \
        .unionByName(asked.withColumns(blank))
    # a folder's own row lies on its lo: it counts before the lower end and is left out of the difference
    rows = rows.withColumn("_at", F.col("n") * 2 - F.col("_end") + 1)
    run = with_running(rows, ["root_id", *by], "_at", None if span is None else 2 * span, sums={f"r{p}": F.coalesce(F.col(p), F.lit(0)) for p in parts})
    found = run.where("_end = 0").groupBy("root_id", "item_id", "item_path", *by).agg(
        *[(F.max_by(f"r{p}", "n") - F.min_by(f"r{p}", "n")).alias(name) for p, name in zip(parts, sums, strict=True)])
    return found


def dyadic_pieces(first: Column, last: Column, levels: int) -> Column:
    """The interval as at most two aligned blocks (level, number) for each of ``levels`` sizes 2**level."""
    def one(k: Column) -> Column:
        lo = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        hi = F.call_function("shiftright", last + 1, k)
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("block")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), one)))


def containing_many(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``versions`` with ``scan_id`` for every wanted scan (root_id, scan_id; ids are not negative) inside
    their interval.

    Each interval becomes at most two blocks a size, each scan names the one block of every size that
    holds it, and the two meet in an equality join: blocks of an interval do not overlap, so every
    pair that meets is one of the result, once.
    """
    longest = versions.agg(F.max(F.col("last_scan_id") - F.col("first_scan_id") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    pieces = versions.withColumn("_p", F.explode(dyadic_pieces(F.col("first_scan_id"), F.col("last_scan_id"), levels)))
    pieces = pieces.select(*versions.columns, F.col("_p.level").alias("_level"), F.col("_p.block").alias("_block"))
    scans = wanted.select("root_id", "scan_id").distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    scans = scans.withColumn("_block", F.call_function("shiftright", F.col("scan_id"), F.col("_level")))
    return pieces.join(scans, ["root_id", "_level", "_block"]).drop("_level", "_block")
