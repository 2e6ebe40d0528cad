"""Snapshot ingest, trees, scan statistics, rollback."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import STORE, on_store, query
from catalog.bf_domains import PAGE
from tempora.operators import history as H
from tempora.operators import changefeed, rollback, scanstats, tree
from tempora.operators.asof import with_previous
from tempora.sources import feeds

store = feeds.activity_store
N, ROOT = 303, 3  # the scan that the one-snapshot queries apply: day 3 of root 3
META = "access, mod_date, size"
BASE = ["item_id", "item_version", "root_id", "first_scan_id", "last_scan_id", "is_added", "is_deleted",
        "access", "mod_date", "size"]
OLD = f"""
, old AS (SELECT * FROM versions WHERE root_id = {ROOT} AND first_scan_id < {N}),
cur AS (SELECT o.item_id, o.item_version, o.is_deleted, o.access, o.mod_date, o.size, o.add_count,
    o.modify_count, o.unchanged_count, o.first_scan_id, least(o.last_scan_id, {N - 100}) AS last_scan_id
  FROM old o WHERE item_version = (SELECT max(item_version) FROM old w WHERE w.item_id = o.item_id)),
snap AS (SELECT * FROM obs WHERE root_id = {ROOT} AND d = {N // 100}),
known AS (SELECT i.item_id, i.item_path, i.item_type FROM items i JOIN cur USING (item_id)),
matched AS (
  SELECT coalesce(s.item_path, k.item_path) AS item_path, coalesce(s.item_type, k.item_type) AS item_type,
    k.item_id, s.item_id IS NOT NULL AS seen, s.access, s.mod_date, s.size,
    c.item_version, c.is_deleted, c.last_scan_id, c.access AS ca, c.mod_date AS cm, c.size AS cs,
    c.add_count, c.modify_count, c.unchanged_count,
    CASE WHEN k.item_id IS NULL THEN 'new' WHEN s.item_id IS NOT NULL AND c.is_deleted THEN 'rehydrated'
      WHEN s.item_id IS NOT NULL AND (s.access <> c.access OR s.mod_date <> c.mod_date OR s.size <> c.size)
        THEN 'modified'
      WHEN s.item_id IS NOT NULL THEN 'unchanged' WHEN NOT c.is_deleted THEN 'swept' ELSE 'absent' END AS change
  FROM snap s FULL JOIN known k ON k.item_path = s.item_path AND k.item_type = s.item_type
  LEFT JOIN cur c ON c.item_id = k.item_id)
"""


def before(spark, sf):
    """The root's tables as they stood before scan N, and the snapshot that scan brings."""
    st = store(spark, sf)
    prev = N - feeds.SCAN_STRIDE
    versions = st.versions.where((F.col("root_id") == ROOT) & (F.col("first_scan_id") < N)).withColumn(
        "last_scan_id", F.least("last_scan_id", F.lit(prev)))
    items = st.items.join(versions.select("item_id"), "item_id", "left_semi")
    snap = feeds.stored_observations(spark, sf).where(
        (F.col("root_id") == ROOT) & (F.col("scan_id") == N))
    return items, versions, snap


def one_row(numbers):
    """One-number DataFrames side by side."""
    rows = [df.toDF("n").select(F.lit(name).alias("name"), "n") for name, df in numbers.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[
        F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in numbers])


def classified(spark, sf):
    items, versions, snap = before(spark, sf)
    return H.classify(H.match_snapshot(snap, items, versions), N)


@query("h1_match_snapshot", STORE + OLD + "SELECT item_path, item_type, item_id, seen, item_version FROM matched")
def h1(spark, sf):
    items, versions, snap = before(spark, sf)
    return H.match_snapshot(snap, items, versions).select(
        "item_path", "item_type", "item_id", F.coalesce("seen", F.lit(False)).alias("seen"), "item_version")


@query("h2_classify_change", STORE + OLD + "SELECT item_path, item_type, change FROM matched")
def h2(spark, sf):
    return classified(spark, sf).select("item_path", "item_type", "change")


@query("h3_new_identities", STORE + OLD + f"""
SELECT (SELECT max(item_id) FROM old) + row_number() OVER (ORDER BY m.item_path, m.item_type) AS item_id,
  {ROOT} AS root_id, m.item_path, i.item_name, i.parent_path, i.file_extension, m.item_type, i.has_validator
FROM matched m JOIN items i ON i.item_path = m.item_path AND i.item_type = m.item_type WHERE change = 'new'""")
def h3(spark, sf):
    items, versions, snap = before(spark, sf)
    new = H.classify(H.match_snapshot(snap, items, versions), N).where(F.col("change") == "new")
    top = items.agg(F.max("item_id")).first()[0]
    return H.new_items(new.select("root_id", "item_path", "item_type"), top).drop("do_not_validate")


@query("h3_number_every_page", """
SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS item_id FROM pages""")
def h3_pages(spark, sf):
    from tempora.plans.sizing import number_rows
    return number_rows(feeds.table(spark, sf, "pages").select("url", "page_id"), ["url", "page_id"],
                       "item_id").select("page_id", "item_id")


MADE = ["item_path", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "access",
        "mod_date", "size", "add_count", "modify_count", "delete_count", "unchanged_count"]


def made(rows, versions):
    return versions.join(rows.select("item_id", "item_path"), "item_id").select(*MADE)


ZERO = ", ".join(f"CASE WHEN item_type = 1 THEN 0 END AS {c}"
                 for c in ("add_count", "modify_count", "delete_count", "unchanged_count"))
MADE_SQL = f"""SELECT item_path, coalesce(item_version, 0) + 1 AS item_version, {N} AS first_scan_id,
  {N} AS last_scan_id, {{flags}}, {{meta}}, {{counts}} FROM matched WHERE change = """


@query("h4_initial_versions", STORE + OLD + MADE_SQL.format(
    flags="true AS is_added, false AS is_deleted", meta=META, counts=ZERO) + "'new'")
def h4(spark, sf):
    rows = classified(spark, sf).where(F.col("change") == "new").withColumn(
        "item_id", F.xxhash64("root_id", "item_path", "item_type"))
    return made(rows, H.initial_versions(rows, N))


@query("h5_modified_versions", STORE + OLD + MADE_SQL.format(
    flags="false AS is_added, false AS is_deleted", meta=META, counts="""
  CASE WHEN item_type = 1 THEN 0 END AS add_count, CASE WHEN item_type = 1 THEN 0 END AS modify_count,
  CASE WHEN item_type = 1 THEN 0 END AS delete_count,
  CASE WHEN item_type = 1 THEN add_count + modify_count + unchanged_count END AS unchanged_count""") + "'modified'")
def h5(spark, sf):
    rows = classified(spark, sf).where(F.col("change") == "modified")
    return made(rows, H.modified_versions(rows, N))


@query("h6_touch_unchanged", STORE + OLD + f"""
SELECT o.item_id, o.item_version, CASE WHEN m.item_id IS NOT NULL THEN {N}
  ELSE least(o.last_scan_id, {N - 100}) END AS last_scan_id
FROM old o LEFT JOIN matched m ON m.item_id = o.item_id AND m.item_version = o.item_version
  AND m.change = 'unchanged'""")
def h6(spark, sf):
    items, versions, snap = before(spark, sf)
    same = H.classify(H.match_snapshot(snap, items, versions), N).where(F.col("change") == "unchanged")
    return H.touch_unchanged(versions, same, N).select("item_id", "item_version", "last_scan_id")


@query("h7_sweep", STORE + OLD + MADE_SQL.format(
    flags="false AS is_added, true AS is_deleted", meta="ca AS access, cm AS mod_date, cs AS size",
    counts=ZERO) + "'swept'")
def h7(spark, sf):
    items, versions, snap = before(spark, sf)
    same = H.classify(H.match_snapshot(snap, items, versions), N)
    seen = same.where(F.col("change").isin("unchanged", "modified", "rehydrated"))
    touched = H.touch_unchanged(versions, seen, N)
    return made(items, H.sweep(items, touched, ROOT, N))


@query("h8_rehydrate", STORE + OLD + MADE_SQL.format(
    flags="true AS is_added, false AS is_deleted", meta=META, counts=ZERO) + "'rehydrated'")
def h8(spark, sf):
    rows = classified(spark, sf).where(F.col("change") == "rehydrated")
    return made(rows, H.initial_versions(rows, N))


@query("h8_merge_one_snapshot", STORE + f"""
SELECT item_path, item_version, first_scan_id, least(last_scan_id, {N}) AS last_scan_id, is_added, is_deleted, access,
  mod_date, size FROM history WHERE root_id = {ROOT} AND item_type = 0 AND first_scan_id <= {N}""")
def h8_merge(spark, sf):
    items, versions, snap = before(spark, sf)
    all_items, merged = H.merge_snapshot(items, versions, snap, ROOT, N)
    files = all_items.where(F.col("item_type") == 0).select("item_id", "item_path")
    return merged.join(files, "item_id").select(
        "item_path", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "access",
        "mod_date", "size")


@query("h9_directory_sizes", f"""
WITH files AS (SELECT root_path, list_filter(string_split(item_path, '/'), x -> x <> '') AS parts, size FROM {PAGE}),
chain AS (SELECT root_path, unnest(list_transform(range(2, len(parts)),
    i -> '/' || array_to_string(parts[1:i], '/'))) AS item_path, size FROM files)
SELECT item_path, CAST(sum(size) AS BIGINT) AS size FROM chain GROUP BY item_path""".replace(
    "x -> ", "lambda x: ").replace("i -> ", "lambda i: "))
def h9(spark, sf):
    pages = feeds.page_files(feeds.table(spark, sf, "pages"))
    files = pages.select(F.lit(1).alias("root_id"), F.lit(1).alias("scan_id"), "root_path", "item_path",
                         F.lit(None).cast("long").alias("mod_date"), "size")
    return tree.synthesize_directories(files).select("item_path", "size")


@query("h9_root_sizes", f"SELECT root_path, CAST(sum(size) AS BIGINT) AS total_size FROM {PAGE} GROUP BY root_path")
def h9_roots(spark, sf):
    return feeds.page_files(feeds.table(spark, sf, "pages")).groupBy("root_path").agg(
        F.sum("size").alias("total_size"))


@query("h10_next_access", on_store("""
SELECT item_id, item_version, CASE WHEN size % 7 = 6 THEN 1
  WHEN item_type = 1 THEN CASE WHEN size % 5 = 0 THEN 2 ELSE 0 END
  WHEN access = 2 THEN 2 ELSE 0 END AS access
FROM versions JOIN items USING (item_id)"""))
def h10(spark, sf):
    st = store(spark, sf)
    rows = st.versions.join(st.items.select("item_id", "item_type"), "item_id")
    new = H.next_access(F.col("item_type"), F.col("access"), F.col("size") % 5 == 0, F.col("size") % 7 == 6)
    return rows.select("item_id", "item_version", new.alias("access"))


@query("h11_folder_changes", on_store("SELECT item_path AS folder_path, root_id, d * 100 + root_id AS scan_id, "
                                      "adds, mods, dels FROM tree"))
def h11(spark, sf):
    st = store(spark, sf)
    bare = feeds.bare_history(spark, sf)
    paths = st.items.join(st.roots, "root_id").select("item_id", "root_path", "parent_path")
    return tree.folder_changes(tree.change_flags(with_previous(bare, ["is_deleted"])), paths)


@query("h12_folder_versions", on_store("""
SELECT item_id, item_version, first_scan_id, last_scan_id, is_added, is_deleted, size, add_count,
  modify_count, delete_count, unchanged_count FROM history WHERE item_type = 1"""))
def h12(spark, sf):
    st = store(spark, sf)
    whole = tree.with_folder_counters(feeds.bare_history(spark, sf), st.items, st.roots, st.scans)
    return whole.where(F.col("add_count").isNotNull()).select(
        "item_id", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "size",
        "add_count", "modify_count", "delete_count", "unchanged_count")


STATS = scanstats.LEVELS + scanstats.CHANGES + scanstats.NEW_ISSUES


@query("h13_scan_statistics", on_store(f"SELECT scan_id, {', '.join(STATS)} FROM scans WHERE state = 4"))
def h13(spark, sf):
    st = store(spark, sf)
    return scanstats.scan_statistics(st.versions, st.items, st.hashes, st.scans).select("scan_id", *STATS)


@query("h14_history_of_activity", on_store(f"""
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY f) AS item_version, f * 100 + root_id AS first_scan_id,
  l * 100 + root_id AS last_scan_id, is_added, is_deleted, {META} FROM plain"""))
def h14(spark, sf):
    out = H.build_history(feeds.activity_observations(spark, sf), feeds.activity_scans(spark, sf))
    return out.drop("root_id")


def shipping_sql(key, coarse):
    return f"""
WITH month AS (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) - {feeds.FIRST_MONTH} + 1 AS d FROM lineitem),
roots AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS root_id
  FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
obs AS (SELECT root_id, {key} * 100 + root_id AS item_id, d, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) // {coarse} AS size
  FROM month JOIN roots USING (l_returnflag) GROUP BY root_id, {key}, d),
marked AS (SELECT *, lag(d) OVER w AS pd, lag(size) OVER w AS ps, lead(d) OVER w AS nd FROM obs
  WINDOW w AS (PARTITION BY item_id ORDER BY d)),
islands AS (SELECT *, sum(CASE WHEN pd = d - 1 AND ps = size THEN 0 ELSE 1 END)
  OVER (PARTITION BY item_id ORDER BY d) AS g FROM marked),
rows AS (
  SELECT item_id, root_id, min(d) AS f, max(d) AS l, min_by(pd IS NULL OR pd < d - 1, d) AS is_added,
    false AS is_deleted, any_value(size) AS size FROM islands GROUP BY item_id, root_id, g
  UNION ALL
  SELECT item_id, root_id, d + 1, d + 1, false, true, size FROM marked
  WHERE (nd IS NULL OR nd > d + 1) AND d < (SELECT max(d) FROM obs))
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY f) AS item_version, f * 100 + root_id AS first_scan_id,
  l * 100 + root_id AS last_scan_id, is_added, is_deleted, size FROM rows"""


SHIPPED = ["item_id", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "size"]


@query("h14_history_of_parts", shipping_sql("l_partkey", 1))
def h14_parts(spark, sf):
    return feeds.shipping_history(spark, sf).select(*SHIPPED)


@query("h14_history_of_suppliers", shipping_sql("l_suppkey", 50))
def h14_suppliers(spark, sf):
    return feeds.shipping_history(spark, sf, "l_suppkey", 50).select(*SHIPPED)


UNDONE = 3003  # the newest scan of root 3


@query("h15_rolled_back_versions", on_store(f"""
SELECT item_id, item_version, last_scan_id, CASE WHEN val_scan_id <= last_scan_id THEN val_scan_id END AS val_scan_id,
  CASE WHEN val_scan_id <= last_scan_id THEN val_state END AS val_state
FROM (SELECT * REPLACE (CASE WHEN last_scan_id = {UNDONE} THEN {UNDONE - 100} ELSE last_scan_id END AS last_scan_id)
      FROM versions) WHERE first_scan_id <> {UNDONE}"""))
def h15(spark, sf):
    return rollback.roll_back(store(spark, sf), UNDONE).versions.select(
        "item_id", "item_version", "last_scan_id", "val_scan_id", "val_state")


@query("h15_rolled_back_counts", on_store(f"""
SELECT (SELECT count(*) FROM hashes WHERE first_scan_id <> {UNDONE}) AS hashes,
  (SELECT count(*) FROM hashes WHERE first_scan_id <> {UNDONE} AND last_scan_id = {UNDONE}) AS extended,
  (SELECT count(DISTINCT item_id) FROM versions WHERE first_scan_id <> {UNDONE}) AS items,
  (SELECT count(*) FROM scans WHERE state = 6) + 1 AS failed_scans,
  (SELECT CAST(sum(total_size) AS BIGINT) FROM scans WHERE scan_id <> {UNDONE}) AS sizes"""))
def h15_counts(spark, sf):
    st = rollback.roll_back(store(spark, sf), UNDONE, error="disk gone")
    # the undone scan's extended hashes fall back, so none of them ends at it any more
    hashes = st.hashes.agg(F.count(F.lit(1)).alias("hashes"))
    ended = store(spark, sf).hashes.where((F.col("first_scan_id") != UNDONE) & (F.col("last_scan_id") == UNDONE))
    fell = ended.join(st.hashes.where(F.col("last_scan_id") < UNDONE).select(
        "item_id", "item_version", "first_scan_id"), ["item_id", "item_version", "first_scan_id"], "left_semi")
    kept = {"items": st.items.agg(F.count(F.lit(1))), "failed_scans": st.scans.agg(F.count_if(F.col("state") == 6)),
            "sizes": st.scans.agg(F.sum("total_size")), "hashes": hashes, "extended": fell.agg(F.count(F.lit(1)))}
    return one_row(kept)


def undone(spark, sf):
    """The scan undone from the changes between the version published before it and the one after."""
    st = store(spark, sf)
    after = st.with_(**{n: df.where(F.col("root_id") == UNDONE % 100) for n, df in st.tables().items()})
    recorded = changefeed.store_changes(feeds.activity_before(spark, sf, UNDONE), after)
    return rollback.undo_scan(after, recorded, UNDONE)


@query("h15_undone_versions", on_store(f"""
SELECT item_id, item_version, first_scan_id, least(last_scan_id, {UNDONE - 100}) AS last_scan_id, is_deleted, size,
  add_count, modify_count, delete_count, unchanged_count,
  CASE WHEN val_scan_id < {UNDONE} THEN val_scan_id END AS val_scan_id, CASE WHEN val_scan_id < {UNDONE} THEN val_state END AS val_state,
  CASE WHEN val_scan_id < {UNDONE} THEN val_error END AS val_error
FROM versions WHERE root_id = 3 AND first_scan_id < {UNDONE}"""))
def h15_undone_versions(spark, sf):
    return undone(spark, sf).versions.select(
        "item_id", "item_version", "first_scan_id", "last_scan_id", "is_deleted", "size", "add_count", "modify_count",
        "delete_count", "unchanged_count", "val_scan_id", "val_state", "val_error")


@query("h15_undone_hashes", on_store(f"""
SELECT item_id, item_version, min(d) * 100 + 3 AS first_scan_id, max(d) * 100 + 3 AS last_scan_id, h AS file_hash,
  CASE WHEN bool_or(rn = 1) THEN 1 ELSE 2 END AS hash_state
FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> h THEN 1 ELSE 0 END)
        OVER (PARTITION BY item_id, item_version ORDER BY d) AS g
      FROM hash_marks WHERE root_id = 3 AND d * 100 + 3 < {UNDONE})
GROUP BY item_id, item_version, g, h"""))
def h15_undone_hashes(spark, sf):
    return undone(spark, sf).hashes.select("item_id", "item_version", "first_scan_id", "last_scan_id",
                                           F.lower(F.hex("file_hash")).alias("file_hash"), "hash_state")


@query("h15_recorded_changes", on_store(f"""
SELECT 'items' AS tab, count(*) FILTER (f = {UNDONE}) AS inserts, 0 AS updates FROM (SELECT item_id, min(first_scan_id) AS f FROM versions
  WHERE root_id = 3 GROUP BY item_id)
UNION ALL SELECT 'hashes', count(*) FILTER (first_scan_id = {UNDONE}), count(*) FILTER (first_scan_id < {UNDONE} AND last_scan_id = {UNDONE})
FROM hashes WHERE root_id = 3"""))
def h15_recorded(spark, sf):
    st, before = store(spark, sf), feeds.activity_before(spark, sf, UNDONE)
    parts = []
    for name in ("items", "hashes"):
        after = getattr(st, name).where(F.col("root_id") == UNDONE % 100)
        changes = changefeed.table_changes(getattr(before, name), after, changefeed.KEYS[name])
        kind = changefeed.change_kind()
        parts.append(changes.agg(F.lit(name).alias("tab"), F.count_if(kind == "insert").alias("inserts"),
                                 F.count_if(kind == "update").alias("updates")))
    return reduce(DataFrame.unionByName, parts)


@query("h16_delete_root", on_store("""
SELECT (SELECT count(*) FROM versions WHERE root_id <> 2) AS versions, (SELECT count(*) FROM items WHERE root_id <> 2) AS items,
  (SELECT count(*) FROM hashes WHERE root_id <> 2) AS hashes, (SELECT count(*) FROM scans WHERE root_id <> 2) AS scans,
  (SELECT count(*) FROM schedules WHERE root_id <> 2) AS schedules, (SELECT count(*) FROM roots WHERE root_id <> 2) AS roots,
  (SELECT count(*) FROM tasks WHERE root_id IS DISTINCT FROM 2) AS tasks"""))
def h16(spark, sf):
    kept = rollback.delete_root(store(spark, sf), 2).tables()
    return one_row({name: df.agg(F.count(F.lit(1))) for name, df in kept.items()})


@query("h16_running_tasks", on_store("SELECT task_id FROM tasks WHERE root_id = 4 AND status = 1"))
def h16_running(spark, sf):
    return rollback.running_tasks(store(spark, sf).tasks, 4).select("task_id")


@query("h17_previous_completed_scan", on_store("""
SELECT scan_id, (SELECT max(p.scan_id) FROM scans p WHERE p.root_id = s.root_id AND p.scan_id < s.scan_id
  AND p.state = 4) AS prev_scan_id FROM scans s"""))
def h17(spark, sf):
    return H.previous_completed_scan(store(spark, sf).scans).select("scan_id", "prev_scan_id")


@query("h13_changes_per_scan", on_store("""
SELECT scan_id, add_count, modify_count, delete_count FROM changed"""))
def h13_changes(spark, sf):
    return scanstats.scan_changes(store(spark, sf).versions).drop("root_id")


@query("h2_change_flags", on_store("""
SELECT v.item_id, v.item_version, CAST(NOT v.is_deleted AND (p.item_id IS NULL OR p.is_deleted) AS BIGINT) AS adds,
  CAST(NOT v.is_deleted AND p.item_id IS NOT NULL AND NOT p.is_deleted AS BIGINT) AS mods,
  CAST(v.is_deleted AND p.item_id IS NOT NULL AND NOT p.is_deleted AS BIGINT) AS dels
FROM versions v LEFT JOIN versions p ON p.item_id = v.item_id AND p.item_version = v.item_version - 1"""))
def h2_flags(spark, sf):
    rows = with_previous(store(spark, sf).versions, ["is_deleted"])
    return tree.change_flags(rows).select("item_id", "item_version", "adds", "mods", "dels")
