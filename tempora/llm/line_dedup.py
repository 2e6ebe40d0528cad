"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (trimmed of blanks) is boilerplate of a site if it stands on more than ``ratio`` of the site's
pages, and on two pages at least (a line of one page repeats nothing).  Such lines are dropped from
every page of the site; the other lines stay as they are, in their order.

Scale: pages are reduced to distinct line hashes before anything moves, and the counts are combined
before the shuffle, so a hot site or a hot line reaches the reducers as one partial row per task.
The lines of a site that exceed the ratio number less than (mean distinct lines of its pages) /
``ratio``, however many pages it has, so a site's list is small by proof.  Where all lists together
hold at most ``BROADCAST_LINES`` lines, which is counted, they go to the pages and no text moves.
Otherwise lists and pages meet in a join on a spread key: a site's list is laid out once for every
``SPREAD_PAGES`` of its pages, and its pages are dealt to these by the hash of their text.  (A page
text that repeats very often still shares one key; those rows are alike and need no more than the list.)

Defined results: a null site has no boilerplate, its pages stay whole; a null text stays null and
counts as a page without lines; an empty text stays empty; blank lines are never boilerplate;
repeated rows count as pages of their own; a page whose lines all go keeps its row with an empty text.
Lines are compared by 64-bit hashes within their site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common
from tempora.plans.sizing import broadcast_if_small

RATIO = 0.10
MIN_PAGES = 2
BROADCAST_LINES = 500_000  # 8 bytes each
SPREAD_PAGES = 20_000


def host_of(url: Column) -> Column:
    """The lower-cased host of a url, null if there is none; for tables that carry urls."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def line_hashes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """``site, total, lines``: each site's pages and boilerplate lines; sites without any are left out."""
    named = pages.select(F.col(f"`{site}`").alias("_site"), F.col(f"`{text}`").alias("_text")).where("_site is not null")
    # one pass gives both counts: a null line hash stands for the page itself
    seen = named.select("_site", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(line_hashes(F.col("_text")), F.array().cast("array<long>")))).alias("_line"))
    counted = seen.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_line").isNull() | (F.col("_pages") >= min_pages))
    total = counted.where("_line is null").select("_site", F.col("_pages").alias("_total"))
    lines = counted.where("_line is not null")
    over = lines.join(total, "_site").where(F.col("_pages") > F.lit(ratio) * F.col("_total"))
    return over.groupBy("_site", "_total").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def with_lines(rows: DataFrame, bad: DataFrame, page: Column, broadcast_lines: int, spread_pages: int) -> DataFrame:
    """``rows`` with the ``_lines`` of their ``_site``, null where there are none."""
    if (bad.agg(F.sum(F.size("_lines"))).first()[0] or 0) <= broadcast_lines:
        return rows.join(F.broadcast(bad.select("_site", "_lines")), "_site", "left")
    # only sites of many pages are dealt out; each accounts for that many rows
    large = bad.where(F.col("_total") > spread_pages).select("_site", F.ceil(F.col("_total") / spread_pages).alias("_parts"))
    dealt = rows.join(broadcast_if_small(large), "_site", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(page), F.col("_parts")), F.lit(0)))
    laid = bad.select("_site", "_lines", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_total") / spread_pages) - 1)).alias("_part"))
    return dealt.join(laid, ["_site", "_part"], "left")


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, count: str | None = None, broadcast_lines: int = BROADCAST_LINES,
                     spread_pages: int = SPREAD_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines of each site taken out of ``text``.

    With ``count``, a column of that name tells how many lines went.
    """
    names = pages.columns
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_p")).select("_p", F.col(f"_p.`{site}`").alias("_site"))
    bad = common.stored(boilerplate(pages, site, text, ratio, min_pages), "boilerplate")
    joined = with_lines(rows, bad, F.col(f"_p.`{text}`"), broadcast_lines, spread_pages)
    lines = F.split(F.col(f"_p.`{text}`"), "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_lines"), F.xxhash64(F.trim(x))))
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(kept)
    out = joined.select("_p", F.array_join(kept, "\n").alias("_text"), (F.size(lines) - F.size(kept)).alias("_gone"))
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_p.`{c}`").alias(c) for c in names if c != count]
    if count:
        columns.append(F.when(F.col("_text").isNull(), 0).otherwise(F.col("_gone")).cast("long").alias(count))
    return out.select(*columns)
