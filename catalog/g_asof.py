"""As-of, temporal and browse queries.  Scan 1203 is day 12 of root 3."""

from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.operators import asof, browse
from tempora.sources import feeds

store = feeds.activity_store
IN_FORCE = """(SELECT v.* FROM versions v WHERE first_scan_id = (
  SELECT max(first_scan_id) FROM versions w WHERE w.item_id = v.item_id AND w.first_scan_id <= {n}))"""
AT = """(SELECT v.*, item_path, item_name, item_type, parent_path, has_validator,
    (SELECT max_by(hash_state, first_scan_id) FROM hashes x
     WHERE x.item_id = v.item_id AND x.item_version = v.item_version) AS hash_state
  FROM """ + IN_FORCE + """ v JOIN items i USING (item_id)
  WHERE v.root_id = {r} AND (NOT v.is_deleted OR v.first_scan_id = {n}))"""
LATEST_HASH = """(SELECT item_id, item_version, max(first_scan_id) AS hash_first_scan_id,
  max_by(hash_state, first_scan_id) AS hash_state, max_by(file_hash, first_scan_id) AS file_hash
  FROM hashes {where} GROUP BY item_id, item_version)"""
SEEN = ["item_id", "item_version", "first_scan_id", "is_added", "is_deleted", "size", "add_count",
        "modify_count", "delete_count", "unchanged_count", "val_state", "hash_state"]


def at(n):
    return AT.format(n=n, r=n % 100)


def hexed():
    return F.lower(F.hex("file_hash")).alias("file_hash")


@query("g1_current_version", on_store("""
SELECT item_id, item_version, is_deleted, size FROM versions v
WHERE item_version = (SELECT max(item_version) FROM versions w WHERE w.item_id = v.item_id)"""))
def g1(spark, sf):
    return asof.current_versions(store(spark, sf).versions).select(
        "item_id", "item_version", "is_deleted", "size")


@query("g2_is_current", on_store("""
SELECT item_id, item_version, first_scan_id = max(first_scan_id) OVER (PARTITION BY item_id) AS is_current
FROM versions"""))
def g2(spark, sf):
    return asof.with_is_current(store(spark, sf).versions).select("item_id", "item_version", "is_current")


@query("g3_asof_snapshot", on_store(f"""
SELECT item_id, item_version, is_deleted, size FROM {at(1203)}"""))
def g3(spark, sf):
    root = store(spark, sf).versions.where(F.col("root_id") == 3)
    return asof.snapshot_at(root, 1203).select("item_id", "item_version", "is_deleted", "size")


@query("g3_asof_every_scan", on_store("""
SELECT s.root_id, s.scan_id, count(*) AS shown, count_if(is_deleted) AS deleted, CAST(sum(size) AS BIGINT) AS size
FROM scans s JOIN versions v ON v.root_id = s.root_id AND v.first_scan_id = (
  SELECT max(first_scan_id) FROM versions w WHERE w.item_id = v.item_id AND w.first_scan_id <= s.scan_id)
WHERE s.state = 4 AND (NOT v.is_deleted OR v.first_scan_id = s.scan_id) GROUP BY s.root_id, s.scan_id"""))
def g3_all(spark, sf):
    st = store(spark, sf)
    wanted = st.scans.where("state = 4").select("root_id", "scan_id")
    return asof.snapshots_at(st.versions, wanted, st.scans).groupBy("root_id", "scan_id").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if("is_deleted").alias("deleted"),
        F.sum("size").alias("size"))


@query("g4_interval_containment", on_store("""
SELECT item_id, item_version FROM versions WHERE root_id = 3 AND 1203 BETWEEN first_scan_id AND last_scan_id"""))
def g4(spark, sf):
    root = store(spark, sf).versions.where(F.col("root_id") == 3)
    return asof.containing(root, 1203).select("item_id", "item_version")


@query("g5_alive_at_latest", on_store("""
SELECT item_id, item_version FROM versions WHERE last_scan_id = 3003 AND NOT is_deleted"""))
def g5(spark, sf):
    return asof.alive_at_latest(store(spark, sf).versions, 3003).select("item_id", "item_version")


@query("g6_latest_hash", on_store(f"""
SELECT v.item_id, v.item_version, hash_first_scan_id, hash_state, file_hash FROM versions v
LEFT JOIN {LATEST_HASH.format(where='')} h USING (item_id, item_version)"""))
def g6(spark, sf):
    st = store(spark, sf)
    return asof.with_latest_hash(st.versions, st.hashes).select(
        "item_id", "item_version", "hash_first_scan_id", "hash_state", hexed())


@query("g7_latest_hash_as_of", on_store(f"""
SELECT item_id, item_version, hash_first_scan_id, hash_state, file_hash
FROM {LATEST_HASH.format(where='WHERE first_scan_id <= 1250')}"""))
def g7(spark, sf):
    return asof.latest_hashes(store(spark, sf).hashes, 1250).select(
        "item_id", "item_version", "hash_first_scan_id", "hash_state", hexed())


@query("g8_previous_version", on_store("""
SELECT v.item_id, v.item_version, p.item_version AS prev_version, p.is_deleted AS prev_deleted, p.size AS prev_size
FROM versions v LEFT JOIN versions p ON p.item_id = v.item_id AND p.first_scan_id = (
  SELECT max(first_scan_id) FROM versions w WHERE w.item_id = v.item_id AND w.first_scan_id < v.first_scan_id)"""))
def g8(spark, sf):
    out = asof.with_previous(store(spark, sf).versions, ["item_version", "is_deleted", "size"])
    return out.select("item_id", "item_version", F.col("prev.item_version").alias("prev_version"),
                      F.col("prev.is_deleted").alias("prev_deleted"), F.col("prev.size").alias("prev_size"))


def root_path(n):
    return f"(SELECT root_path FROM roots WHERE root_id = {n})"


def name_of(st, root_id):
    """Root path of a root id, looked up once: the folder to browse is a parameter of the query."""
    return st.roots.where(F.col("root_id") == root_id).first()["root_path"]


@query("g9_browse_children", on_store(f"""
SELECT {', '.join(SEEN)}
FROM {at(1203)} WHERE parent_path = {root_path(3)} || '/b4' OR parent_path = {root_path(3)} || '/b4/d1'"""))
def g9(spark, sf):
    st = store(spark, sf)
    base = name_of(st, 3)
    both = browse.children_at(st, 3, f"{base}/b4", 1203).unionByName(
        browse.children_at(st, 3, f"{base}/b4/d1", 1203))
    return both.select(*SEEN)


@query("g9_browse_page", on_store(f"""
SELECT item_id, item_path FROM {at(1203)} WHERE parent_path = {root_path(3)}
ORDER BY item_path LIMIT 4 OFFSET 3"""))
def g9_page(spark, sf):
    st = store(spark, sf)
    return browse.children_page(st, 3, name_of(st, 3), 1203, 4, 3).select("item_id", "item_path")


@query("g10_count_children", on_store(f"""
SELECT count(*) AS count FROM {at(1203)} WHERE parent_path = {root_path(3)} || '/b4/d1'"""))
def g10(spark, sf):
    st = store(spark, sf)
    return browse.count_children(st, 3, name_of(st, 3) + "/b4/d1", 1203)


@query("g11_descendant_counts", on_store(f"""
SELECT count_if(item_type = 0) AS file_count, count_if(item_type = 1) AS directory_count
FROM {at(1203)} WHERE NOT is_deleted AND starts_with(item_path, {root_path(3)} || '/b4/')"""))
def g11(spark, sf):
    st = store(spark, sf)
    return browse.descendant_counts(st, 3, name_of(st, 3) + "/b4", 1203)


@query("g12_name_search", on_store(f"""
SELECT {', '.join(SEEN)} FROM {at(1203)} WHERE contains(lower(item_name), 'u1')"""))
def g12(spark, sf):
    return browse.search_at(store(spark, sf), 3, "U1", 1203).select(*SEEN)


@query("g13_version_history", on_store("""
SELECT item_version, f.started_at AS first_scan_date, l.started_at AS last_scan_date, size, is_deleted,
  (SELECT max_by(hash_state, first_scan_id) FROM hashes x WHERE x.item_id = v.item_id
     AND x.item_version = v.item_version) AS hash_state
FROM versions v JOIN scans f ON f.scan_id = first_scan_id JOIN scans l ON l.scan_id = last_scan_id
WHERE item_id = 703 ORDER BY item_version DESC LIMIT 12"""))
def g13(spark, sf):
    return browse.version_history(store(spark, sf), 703).limit(12).select(
        "item_version", "first_scan_date", "last_scan_date", "size", "is_deleted", "hash_state")


@query("g14_version_counts", on_store("SELECT item_id, count(*) AS version_count FROM versions GROUP BY item_id"))
def g14(spark, sf):
    return browse.version_counts(store(spark, sf).versions)


LONGEST = """(SELECT item_id, item_version FROM hashes GROUP BY item_id, item_version
  ORDER BY count(*) DESC, item_id, item_version LIMIT 1)"""


@query("g15_hash_history", on_store(f"""
SELECT h.item_id, h.item_version, h.first_scan_id, s.started_at AS first_scan_date, hash_state, file_hash
FROM hashes h JOIN {LONGEST} USING (item_id, item_version) JOIN scans s ON s.scan_id = h.first_scan_id"""))
def g15(spark, sf):
    st = store(spark, sf)
    pick = st.hashes.groupBy("item_id", "item_version").count().orderBy(
        F.desc("count"), "item_id", "item_version").first()
    return browse.hash_history(st, pick["item_id"], pick["item_version"]).select(
        "item_id", "item_version", "first_scan_id", "first_scan_date", "hash_state", hexed())


@query("g16_size_history", on_store("""
SELECT first_scan_id AS scan_id, started_at, size FROM versions JOIN scans ON scan_id = first_scan_id
WHERE item_id = 703 AND size IS NOT NULL AND started_at BETWEEN epoch(TIMESTAMP '2024-01-05')
  AND (SELECT started_at FROM scans WHERE scan_id = 2303)"""))
def g16(spark, sf):
    return browse.size_history(store(spark, sf), 703, "2024-01-05", 2303)


@query("g17_integrity_state", on_store(f"""
SELECT o.o_orderkey AS item_id, coalesce(i.has_validator, false) AS has_validator,
  coalesce(i.do_not_validate, false) AS do_not_validate, v.val_state, v.val_error, h.hash_state, h.file_hash
FROM orders o LEFT JOIN items i ON i.item_id = o.o_orderkey
LEFT JOIN {IN_FORCE.format(n=1203)} v ON v.item_id = o.o_orderkey
LEFT JOIN {LATEST_HASH.format(where='')} h ON h.item_id = v.item_id AND h.item_version = v.item_version"""))
def g17(spark, sf):
    asked = feeds.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"))
    return browse.integrity_state_at(store(spark, sf), asked, 1203).select(
        "item_id", "has_validator", "do_not_validate", "val_state", "val_error", "hash_state", hexed())


KIND = """CASE WHEN is_deleted THEN 'deleted' WHEN first_scan_id = 1203 AND is_added THEN 'added'
  WHEN first_scan_id = 1203 THEN 'modified' ELSE 'unchanged' END"""


def viewed(spark, sf):
    st = store(spark, sf)
    root = st.versions.where(F.col("root_id") == 3)
    rows = asof.snapshot_at(root, 1203).join(st.items.select("item_id", "item_type", "item_path"), "item_id")
    return asof.with_change_view(rows, 1203)


@query("g18_change_kind", on_store(f"SELECT item_id, {KIND} AS change_kind FROM {at(1203)}"))
def g18(spark, sf):
    return viewed(spark, sf).select("item_id", "change_kind")


@query("g19_folder_counters", on_store(f"""
SELECT item_id, CASE WHEN first_scan_id < 1203 THEN 0 ELSE add_count END AS add_count,
  CASE WHEN first_scan_id < 1203 THEN 0 ELSE modify_count END AS modify_count,
  CASE WHEN first_scan_id < 1203 THEN 0 ELSE delete_count END AS delete_count,
  CASE WHEN first_scan_id < 1203 THEN add_count + modify_count + unchanged_count
       ELSE unchanged_count END AS unchanged_count
FROM {at(1203)} WHERE item_type = 1"""))
def g19(spark, sf):
    return viewed(spark, sf).where("item_type = 1").select(
        "item_id", "add_count", "modify_count", "delete_count", "unchanged_count")


@query("g20_visible_changes", on_store(f"""
SELECT item_id FROM (SELECT *, {KIND} AS kind FROM {at(1203)})
WHERE kind IN ('added', 'deleted')
  OR (item_type = 1 AND first_scan_id = 1203 AND (add_count > 0 OR delete_count > 0))"""))
def g20(spark, sf):
    return viewed(spark, sf).where(asof.visible(["unchanged", "modified"])).select("item_id")
