"""Ordered per-key computations whose work never piles up on one hot key.

A history key (an item, a version) is ordered by an integer such as a scan ordinal and has at most
one row per ordinal.  While the number of ordinals is known to be modest a plain window is the best
plan.  Beyond that, ``span`` cuts the order axis into segments: windows run inside
(key, segment), each segment is folded to one small edge row, only the edge rows are ordered per
key, and the carry is joined back on (key, segment).  Both forms give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN_WINDOW_LIMIT = 100_000
SEGMENT_SPAN = 16_384
MEASURE = 0  # as a span: look how long a key can get


def choose_span(ordinals_per_key: int) -> int | None:
    """None (plain windows) while a key cannot exceed the limit, else the segment width."""
    return None if ordinals_per_key <= PLAIN_WINDOW_LIMIT else SEGMENT_SPAN


def sized(span: int | None, rows: DataFrame, order: str) -> int | None:
    """``span`` itself, or for ``MEASURE`` the one that the items of ``rows`` need along ``order``.

    An item has one row per ordinal and one root, so it cannot have more rows than its root has distinct
    ordinals (rows without root_id: than there are at all).  Counting those reads two columns and
    combines map-side; what is exchanged has the size of the scans table, whatever the histories hold.
    Several rows of an item at one ordinal stay in one segment.
    """
    if span != MEASURE:
        return span
    by = [c for c in ("root_id",) if c in rows.columns]
    each = rows.select(*by, order).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return choose_span(each.agg(F.max("n")).first()[0] or 0)


def _segment(order: str, span: int) -> Column:
    return F.floor(F.col(order) / F.lit(span)).cast("long")


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_seg"]]
    extra = [c for c in carry.columns if c not in {*keys, "_seg"}]
    return df.alias("l").join(carry.alias("r"), cond, "left").select("l.*", *[f"r.{c}" for c in extra])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    span: int | None = None,
    prev: str | None = "prev",
    next: str | None = "next",
) -> DataFrame:
    """Add the struct of ``cols`` of the previous and/or next row of the same key."""
    row = F.struct(*cols)
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order)
        if prev:
            df = df.withColumn(prev, F.lag(row).over(w))
        return df.withColumn(next, F.lead(row).over(w)) if next else df

    df = df.withColumn("_seg", _segment(order, span))
    local = Window.partitionBy(*keys, "_seg").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_seg")
    edges = df.groupBy(*keys, "_seg").agg(
        F.min_by(row, order).alias("_head"), F.max_by(row, order).alias("_tail")
    )
    carry = edges.select(
        *keys, "_seg",
        F.lag("_tail").over(across).alias("_before"),
        F.lead("_head").over(across).alias("_after"),
    )
    out = _join_carry(
        df.withColumn("_lag", F.lag(row).over(local)).withColumn("_lead", F.lead(row).over(local)),
        carry, keys,
    )
    if prev:
        out = out.withColumn(prev, F.coalesce("_lag", "_before"))
    if next:
        out = out.withColumn(next, F.coalesce("_lead", "_after"))
    return out.drop("_seg", "_lag", "_lead", "_before", "_after")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    span: int | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, running maxima and last-non-null values along each key."""
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}

    def running(w):
        return {
            **{n: F.sum(c).over(w) for n, c in sums.items()},
            **{n: F.max(c).over(w) for n, c in maxes.items()},
            **{n: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()},
        }

    if span is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(running(w))

    df = df.withColumn("_seg", _segment(order, span))
    local = Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys, "_seg").agg(
        *[F.sum(c).alias(f"_e_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_e_{n}") for n, c in maxes.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_e_{n}") for n, c in lasts.items()],
    )
    carry = edges.select(
        *keys, "_seg",
        *[F.sum(f"_e_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_e_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    out = _join_carry(df.withColumns(running(local)), carry, keys)
    merged = {
        **{n: F.when(F.col(f"_c_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_c_{n}"))
           .otherwise(F.col(n) + F.col(f"_c_{n}")) for n in sums},
        **{n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxes},
        **{n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in lasts},
    }
    return out.withColumns(merged).drop("_seg", *[f"_c_{n}" for n in merged])
