"""Substring search over names and paths by gram postings.

Every distinct run of one, two or three characters of a value (ASCII letters folded) is a gram.  The
index keeps, for each gram and each block of ``BLOCK`` consecutive item ids, the sorted ids of the items
that hold it: a gram that nearly every name holds is many short rows, none of which grows with the table.
Rows are stored by root and sorted by gram, so a search reads only the row groups of its grams.

A needle is cut at its wildcards into literal pieces; an item can match only if it holds all grams of
all pieces.  The postings of these are counted per item, and what has them all is verified on the
value itself, read by its id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.filters import text_match
from tempora.functions.paths import ascii_lower

GRAM = 3
BLOCK = 1 << 16


def grams_of(value: Column) -> Column:
    """The distinct runs of one to ``GRAM`` code points."""
    folded = ascii_lower(value)

    def runs(n: int) -> Column:
        all_runs = F.transform(F.sequence(F.lit(1), F.length(folded) - (n - 1)), lambda i: F.substring(folded, i, F.lit(n)))
        return F.when(F.length(folded) >= n, all_runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))


def postings(items: DataFrame, column: str) -> DataFrame:
    """``root_id, gram, block, ids``"""
    held = items.where(F.col(column) != "").select("root_id", "item_id", F.explode(grams_of(F.col(column))).alias("gram"))
    block = F.floor(F.col("item_id") / BLOCK).alias("block")
    return held.groupBy("root_id", "gram", block).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))


def write_index(items: DataFrame, column: str, path: str) -> DataFrame:
    """Store the postings, by root and sorted by gram, and read them back."""
    made = postings(items, column)
    made.repartitionByRange("root_id", "gram", "block").sortWithinPartitions("root_id", "gram", "block") \
        .write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("root_id").parquet(path)
    return read_index(items.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, block bigint, ids array<bigint>, root_id bigint").parquet(path)


def pieces(needle: str, wildcards: bool) -> list[str]:
    folded = "".join(c.lower() if c.isascii() else c for c in needle)
    return [p for p in (re.split("[%_]", folded) if wildcards else [folded]) if p]


def needed(needle: str, wildcards: bool = False) -> list[str]:
    """Grams that every match holds: of each piece those of the largest size that fits."""
    out = set()
    for piece in pieces(needle, wildcards):
        n = min(GRAM, len(piece))
        out |= {piece[i:i + n] for i in range(len(piece) - n + 1)}
    return sorted(out)


def candidates(index: DataFrame, needle: str, wildcards: bool = False, root_id: int | None = None) -> DataFrame:
    """``root_id, item_id`` of the items that hold all grams of the needle."""
    grams = needed(needle, wildcards)
    rows = index.where(F.col("gram").isin(grams))
    if root_id is not None:
        rows = rows.where(F.col("root_id") == root_id)
    # lists of one block meet first, so only ids that are in all of them are laid out
    whole = rows.groupBy("root_id", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return whole.select("root_id", F.explode(common).alias("item_id"))


def search(index: DataFrame, items: DataFrame, column: str, needle: str, wildcards: bool = False,
           root_id: int | None = None) -> DataFrame:
    """The rows of ``items`` whose ``column`` matches, as ``filters.text_match`` over all of them finds them.

    A needle without any literal character matches by the value alone and reads all items.
    """
    if root_id is not None:
        items = items.where(F.col("root_id") == root_id)
    match = text_match(F.col(column), needle, wildcards)
    if not needed(needle, wildcards):
        return items.where(match)
    found = candidates(index, needle, wildcards, root_id)
    return items.join(found, ["root_id", "item_id"], "left_semi").where(match)
