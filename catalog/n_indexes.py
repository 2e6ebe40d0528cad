"""Searches and roll-ups that go over an index instead of all rows."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.operators import intervals, search
from tempora.operators.history import current_versions
from tempora.plans.sizing import scratch_path
from tempora.schemas import DIRECTORY, FILE
from tempora.sources import feeds

store = feeds.activity_store
NEEDLES = ("u", "U7", "u12", "_1", "b3/d1", "Click/b%u3_", "%.pdf", "u1%t", "missing", "/b4/d2/u14.jp")


@query("c6_gram_search", on_store(f"""
SELECT needle, item_id FROM items, (SELECT unnest([{', '.join(repr(n) for n in NEEDLES)}]) AS needle)
WHERE lower(item_path) LIKE '%' || lower(needle) || '%'"""))
def c6_grams(spark, sf):
    """Every needle, wildcards included, over the paths of all roots."""
    st = store(spark, sf)
    index = search.write_index(st.items, "item_path", scratch_path(spark, "grams"))
    found = [search.search(index, st.items, "item_path", n, wildcards=True).select(F.lit(n).alias("needle"), "item_id") for n in NEEDLES]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("g4_containing_every_scan", on_store("""
SELECT s.root_id, s.scan_id, v.item_id, v.item_version FROM versions v
JOIN scans s ON s.root_id = v.root_id AND s.scan_id BETWEEN v.first_scan_id AND v.last_scan_id"""))
def g4_many(spark, sf):
    st = store(spark, sf)
    return intervals.containing_many(st.versions, st.scans).select("root_id", "scan_id", "item_id", "item_version")


@query("g11_below_every_folder", on_store("""
SELECT f.item_id, count(*) FILTER (v.item_type = 0) AS file_count, count(*) FILTER (v.item_type = 1) AS directory_count,
       CAST(coalesce(sum(v.size) FILTER (v.item_type = 0), 0) AS BIGINT) AS size
FROM items f LEFT JOIN (
  SELECT i.root_id, i.item_path, i.item_type, w.size FROM items i JOIN versions w USING (item_id)
  WHERE NOT w.is_deleted AND w.first_scan_id = (SELECT max(first_scan_id) FROM versions x WHERE x.item_id = i.item_id)) v
  ON v.root_id = f.root_id AND starts_with(v.item_path, f.item_path || '/')
WHERE f.item_type = 1 GROUP BY f.item_id"""))
def g11_every(spark, sf):
    """What every folder holds now, at any depth."""
    st = store(spark, sf)
    kind = F.col("item_type")
    alive = current_versions(st.versions).where(~F.col("is_deleted")).select("root_id", "item_id", "size") \
        .join(st.items.select("root_id", "item_id", "item_type"), ["root_id", "item_id"])
    found = intervals.totals(st.items, alive, {
        "file_count": (kind == FILE).cast("long"), "directory_count": (kind == DIRECTORY).cast("long"),
        "size": F.when(kind == FILE, F.coalesce("size", F.lit(0))).otherwise(0)})
    return found.select("item_id", "file_count", "directory_count", "size")
