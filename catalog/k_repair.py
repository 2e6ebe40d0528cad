"""Repair and backfill jobs over histories damaged by deterministic expressions."""

from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.operators import hashes as hash_ops
from tempora.operators import repair, scanstats, tasks
from tempora.operators.asof import current_versions, with_previous
from tempora.operators.history import sized_calendar
from tempora.plans.sizing import scratch_path, write_and_read
from tempora.plans.windows import with_neighbours
from tempora.schemas import HASHES
from tempora.sources import feeds

store = feeds.activity_store


# ---- K1: change log ---------------------------------------------------------------------------

CHANGES = """
, logged AS (
  SELECT v.item_id, v.root_id, v.first_scan_id AS scan_id,
    CASE WHEN v.is_deleted THEN 3 WHEN v.is_added THEN 1 ELSE 2 END AS change_type,
    CASE WHEN v.is_added OR (NOT v.is_deleted AND v.access <> p.access) THEN v.access END AS access_new,
    CASE WHEN NOT v.is_deleted THEN v.is_added OR v.size <> p.size END AS meta_change,
    CASE WHEN NOT v.is_deleted THEN v.mod_date END AS mod_date_new,
    CASE WHEN NOT v.is_deleted THEN v.size END AS size_new
  FROM versions v JOIN items i ON i.item_id = v.item_id
  LEFT JOIN versions p ON p.item_id = v.item_id AND p.item_version = v.item_version - 1 WHERE item_type = 0),
hash_log AS (SELECT item_id, root_id, first_scan_id AS scan_id, file_hash AS hash_new FROM hashes),
val_log AS (SELECT item_id, root_id, val_scan_id AS scan_id, val_state AS val_new, val_error AS val_error_new
  FROM versions WHERE val_scan_id IS NOT NULL),
marks AS (SELECT item_id, root_id, scan_id FROM logged UNION SELECT item_id, root_id, scan_id FROM hash_log
  UNION SELECT item_id, root_id, scan_id FROM val_log),
changes AS (
  SELECT m.*, coalesce(change_type, 2) AS change_type, access_new, coalesce(meta_change, false) AS meta_change,
    mod_date_new, size_new, hash_new IS NOT NULL AS hash_change, hash_new, val_new IS NOT NULL AS val_change,
    val_new, val_error_new
  FROM marks m LEFT JOIN logged USING (item_id, root_id, scan_id) LEFT JOIN hash_log USING (item_id, root_id, scan_id)
  LEFT JOIN val_log USING (item_id, root_id, scan_id)
  WHERE item_id // 100 % 11 <> 5),
lives AS (SELECT *, lead(scan_id) OVER w AS nxt, count(*) FILTER (change_type = 1) OVER w AS life FROM changes
  WINDOW w AS (PARTITION BY item_id ORDER BY scan_id)),
rebuilt AS (
  SELECT item_id, root_id, scan_id AS first_scan_id, nxt, change_type = 3 AS is_deleted,
    last_value(access_new IGNORE NULLS) OVER w AS access,
    last_value(CASE WHEN meta_change THEN size_new END IGNORE NULLS) OVER w AS size,
    last_value(hash_new IGNORE NULLS) OVER w AS file_hash,
    coalesce(last_value(val_new IGNORE NULLS) OVER w, 3) AS val,
    last_value(CASE WHEN val_change THEN scan_id END IGNORE NULLS) OVER w AS last_val_scan,
    last_value(CASE WHEN hash_change THEN scan_id END IGNORE NULLS) OVER w AS last_hash_scan
  FROM lives WINDOW w AS (PARTITION BY item_id, life ORDER BY scan_id)),
current_rows AS (
  SELECT v.item_id, v.root_id, v.is_deleted, v.access, v.size, v.last_scan_id AS last_scan FROM versions v
  JOIN items i USING (item_id)
  WHERE item_type = 0 AND item_version = (SELECT max(item_version) FROM versions w WHERE w.item_id = v.item_id))
SELECT item_id, first_scan_id, nxt - 100 AS last_scan_id, is_deleted, access, size, file_hash, val,
  last_hash_scan, last_val_scan FROM rebuilt WHERE nxt IS NOT NULL
UNION ALL
SELECT c.item_id, coalesce((SELECT max(scan_id) FROM changes g WHERE g.item_id = c.item_id), last_scan), last_scan,
  is_deleted, access, size, NULL, 3, NULL, NULL FROM current_rows c"""


def change_log(st):
    """Change records as an older store would have logged them; some items have none."""
    files = st.items.where("item_type = 0").select("item_id")
    v = with_previous(st.versions.join(files, "item_id"), ["access", "size"])
    p, alive = F.col("prev"), ~F.col("is_deleted")
    nul = {"long": F.lit(None).cast("long"), "int": F.lit(None).cast("int"), "string": F.lit(None).cast("string"),
           "binary": F.lit(None).cast("binary"), "boolean": F.lit(None).cast("boolean")}
    base = {"access_new": "int", "meta_change": "boolean", "mod_date_new": "long", "size_new": "long",
            "hash_change": "boolean", "hash_new": "binary", "val_change": "boolean", "val_new": "int",
            "val_error_new": "string"}

    def shaped(df, scan, seq, kind, **given):
        return df.select("item_id", "root_id", scan.alias("scan_id"), F.lit(seq).alias("seq"), kind.alias("change_type"),
                         *[given.get(n, nul[t]).cast(t).alias(n) for n, t in base.items()])

    moves = shaped(
        v, F.col("first_scan_id"), 0, F.when(F.col("is_deleted"), 3).when(F.col("is_added"), 1).otherwise(2),
        access_new=F.when(F.col("is_added") | (alive & (F.col("access") != p["access"])), F.col("access")),
        meta_change=F.when(alive, F.col("is_added") | (F.col("size") != p["size"])),
        mod_date_new=F.when(alive, F.col("mod_date")), size_new=F.when(alive, F.col("size")))
    hashed = shaped(st.hashes, F.col("first_scan_id"), 1, F.lit(2), hash_change=F.lit(True), hash_new=F.col("file_hash"))
    judged = shaped(st.versions.where("val_scan_id IS NOT NULL"), F.col("val_scan_id"), 2, F.lit(2),
                    val_change=F.lit(True), val_new=F.col("val_state"), val_error_new=F.col("val_error"))
    log = moves.unionByName(hashed).unionByName(judged)
    return repair.fold_same_scan(log.where(F.floor(F.col("item_id") / 100) % 11 != 5))


@query("k1_versions_from_changes", on_store(CHANGES))
def k1(spark, sf):
    st = store(spark, sf)
    files = st.items.where("item_type = 0").select("item_id")
    now = current_versions(st.versions.join(files, "item_id")).select(
        "item_id", "root_id", "is_deleted", "access", "mod_date", "size", F.col("last_scan_id").alias("last_scan"),
        F.lit(None).cast("binary").alias("file_hash"), F.lit(3).alias("val"), F.lit(None).cast("string").alias("val_error"),
        F.lit(None).cast("long").alias("last_hash_scan"), F.lit(None).cast("long").alias("last_val_scan"))
    return repair.versions_from_changes(change_log(st), now, st.scans).select(
        "item_id", "first_scan_id", "last_scan_id", "is_deleted", "access", "size",
        F.lower(F.hex("file_hash")).alias("file_hash"), "val", "last_hash_scan", "last_val_scan")


# ---- K2, K3, K8: collapsing -------------------------------------------------------------------

CHOPPED = """
, chopped AS (
  SELECT item_id, item_version, root_id, d * 100 + root_id AS first_scan_id, d * 100 + root_id AS last_scan_id, is_added,
    is_deleted, access, mod_date, size, {counts}, d
  FROM history, (SELECT unnest(range(1, max(l) + 1)) AS d FROM history) t WHERE d BETWEEN f AND l AND item_type = {kind})"""
SAME_COUNTS = "add_count, modify_count, delete_count, unchanged_count"
QUIET_COUNTS = ("CASE WHEN d > f THEN 0 ELSE add_count END AS add_count, CASE WHEN d > f THEN 0 ELSE modify_count END AS modify_count, "
                "CASE WHEN d > f THEN 0 ELSE delete_count END AS delete_count, "
                "CASE WHEN d > f THEN add_count + modify_count + unchanged_count ELSE unchanged_count END AS unchanged_count")


def chopped(spark, sf, item_type, quiet=False):
    """Every version cut into one row per scan, as a store that never merged would hold it."""
    st = store(spark, sf)
    cal = sized_calendar(st.scans)[0].select("root_id", "scan_id", "ord")
    rows = st.versions.join(st.items.where(F.col("item_type") == item_type).select("item_id"), "item_id")
    lo = cal.select("root_id", F.col("scan_id").alias("first_scan_id"), F.col("ord").alias("lo"))
    hi = cal.select("root_id", F.col("scan_id").alias("last_scan_id"), F.col("ord").alias("hi"))
    laid = rows.join(lo, ["root_id", "first_scan_id"]).join(hi, ["root_id", "last_scan_id"]).withColumn(
        "ord", F.explode(F.sequence("lo", "hi"))).drop("first_scan_id", "last_scan_id")
    out = laid.join(cal, ["root_id", "ord"]).withColumns({"first_scan_id": F.col("scan_id"), "last_scan_id": F.col("scan_id")})
    if quiet:
        later = F.col("ord") > F.col("lo")
        total = F.col("add_count") + F.col("modify_count") + F.col("unchanged_count")
        out = out.withColumns({
            **{c: F.when(later, 0).otherwise(F.col(c)) for c in ("add_count", "modify_count", "delete_count")},
            "unchanged_count": F.when(later, total).otherwise(F.col("unchanged_count")),
        })
    return out.drop("scan_id", "ord", "lo", "hi")


COLLAPSED = ["item_id", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "access", "size", "add_count",
             "modify_count", "delete_count"]
ISLANDS = """
, marked AS (SELECT *, CASE WHEN lag(d) OVER w IS NOT NULL AND {same} THEN 0 ELSE 1 END AS fresh FROM chopped
  WINDOW w AS (PARTITION BY item_id ORDER BY d)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY d) AS g FROM marked)
SELECT item_id, min(first_scan_id) AS first_scan_id, max(last_scan_id) AS last_scan_id, min_by(is_added, d) AS is_added,
  min_by(is_deleted, d) AS is_deleted, min_by(access, d) AS access, min_by(size, d) AS size,
  min_by(add_count, d) AS add_count, min_by(modify_count, d) AS modify_count, min_by(delete_count, d) AS delete_count
FROM runs GROUP BY item_id, g"""
SAME = " AND ".join(f"lag({c}) OVER w IS NOT DISTINCT FROM {c}" for c in repair.FOLDER_FIELDS)


@query("k2_collapse_identical", on_store(
    CHOPPED.format(counts=SAME_COUNTS, kind=0) + ISLANDS.format(same=SAME)))
def k2(spark, sf):
    return repair.collapse_identical(chopped(spark, sf, 0)).select(*COLLAPSED)


@query("k3_collapse_noop_folders", on_store(CHOPPED.format(counts=QUIET_COUNTS, kind=1) + ISLANDS.format(same=(
    f"(({SAME}) OR (NOT is_added AND NOT is_deleted AND add_count = 0 AND modify_count = 0 AND delete_count = 0 "
    "AND lag(access) OVER w = access AND lag(mod_date) OVER w = mod_date AND lag(size) OVER w = size))"))))
def k3(spark, sf):
    rows = chopped(spark, sf, 1, quiet=True)
    return repair.collapse_noop_folders(rows, meta=("access", "mod_date", "size")).select(*COLLAPSED)


@query("k8_merge_adjacent_folders", on_store(
    CHOPPED.format(counts=SAME_COUNTS, kind=1) + ISLANDS.format(same=SAME)))
def k8(spark, sf):
    return repair.collapse_identical(chopped(spark, sf, 1)).select(*COLLAPSED)


@query("k4_recompute_changes", on_store("SELECT scan_id, add_count, modify_count, delete_count FROM scans WHERE state = 4"))
def k4(spark, sf):
    st = store(spark, sf)
    counts = scanstats.scan_changes(st.versions).drop("root_id")
    done = st.scans.where("state = 4").select("scan_id").join(counts, "scan_id", "left")
    return done.fillna(0, list(scanstats.CHANGES))


OLD_ROWS = CHOPPED.format(counts=SAME_COUNTS, kind=0) + """
, old AS (SELECT c.*, CASE WHEN d % 2 = 1 AND NOT c.is_deleted THEN sha256(c.item_id || ':' || d) END AS file_hash,
    CASE WHEN d % 2 = 1 AND NOT c.is_deleted THEN CASE WHEN d % 5 = 0 THEN 2 ELSE 1 END END AS hash_state,
    CASE WHEN d % 2 = 1 AND NOT c.is_deleted THEN first_scan_id END AS last_hash_scan,
    d % 4 AS val_state, CASE WHEN d % 4 = 2 THEN 'bad at ' || d END AS val_error,
    CASE WHEN d % 6 <> 0 THEN first_scan_id END AS last_val_scan
  FROM (SELECT * REPLACE (is_added AND NOT EXISTS (SELECT 1 FROM chopped q WHERE q.item_id = p.item_id AND q.d = p.d - 1
          AND NOT q.is_deleted) AS is_added) FROM chopped p) c),
judged AS (SELECT *, lag(is_deleted) OVER w IS NOT DISTINCT FROM false AND NOT is_added AND NOT is_deleted
    AND lag(access) OVER w = access AND lag(mod_date) OVER w = mod_date AND lag(size) OVER w = size AS phantom
  FROM old WINDOW w AS (PARTITION BY item_id ORDER BY d)),
runs AS (SELECT *, sum(CASE WHEN phantom THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY d) AS g FROM judged)
SELECT item_id, min(first_scan_id) AS first_scan_id, max(last_scan_id) AS last_scan_id, min_by(size, d) AS size,
  min_by(file_hash, d) FILTER (file_hash IS NOT NULL) AS file_hash, min(last_hash_scan) AS hash_first_scan_id,
  max_by(hash_state, d) FILTER (file_hash IS NOT NULL) AS hash_state,
  max(last_val_scan) FILTER (val_state IN (1, 2)) AS val_scan_id,
  max_by(val_state, d) FILTER (val_state IN (1, 2) AND last_val_scan IS NOT NULL) AS val_state,
  max_by(coalesce(val_error, ''), d) FILTER (val_state IN (1, 2) AND last_val_scan IS NOT NULL) AS val_error
FROM runs GROUP BY item_id, g"""


@query("k5_group_phantoms", on_store(OLD_ROWS))
def k5(spark, sf):
    rows = chopped(spark, sf, 0)
    d = F.floor(F.col("first_scan_id") / 100)
    rows = with_neighbours(rows, ["item_id"], "first_scan_id", ["first_scan_id", "is_deleted"], next=None)
    follows = (F.floor(F.col("prev")["first_scan_id"] / 100) == d - 1) & ~F.col("prev")["is_deleted"]
    hashed = (d % 2 == 1) & ~F.col("is_deleted")
    old = rows.withColumns({
        "is_added": F.col("is_added") & ~F.coalesce(follows, F.lit(False)),
        "file_hash": F.when(hashed, F.unhex(F.sha2(F.concat_ws(":", "item_id", d), 256))),
        "hash_state": F.when(hashed, F.when(d % 5 == 0, 2).otherwise(1)),
        "last_hash_scan": F.when(hashed, F.col("first_scan_id")),
        "val_state": (d % 4).cast("int"),
        "val_error": F.when(d % 4 == 2, F.concat(F.lit("bad at "), d)),
        "last_val_scan": F.when(d % 6 != 0, F.col("first_scan_id")),
    })
    return repair.group_phantoms(old).select(
        "item_id", "first_scan_id", "last_scan_id", "size", F.lower(F.hex("file_hash")).alias("file_hash"),
        "hash_first_scan_id", "hash_state", "val_scan_id", "val_state",
        F.when(F.col("val_state").isNotNull(), F.coalesce("val_error", F.lit(""))).alias("val_error"))


# ---- K6, K7, K9, K10: overlaps and flags ------------------------------------------------------

STRETCHED = """
, stretched AS (SELECT * REPLACE (CASE WHEN item_version % 3 = 0 THEN last_scan_id + 200 ELSE last_scan_id END AS last_scan_id)
  FROM versions)"""


def stretched(spark, sf):
    st = store(spark, sf)
    return st, st.versions.withColumn("last_scan_id", F.when(
        F.col("item_version") % 3 == 0, F.col("last_scan_id") + 200).otherwise(F.col("last_scan_id")))


@query("k6_overlapping_versions", on_store(STRETCHED + """
SELECT item_id, item_version FROM stretched v WHERE EXISTS (SELECT 1 FROM stretched e WHERE e.item_id = v.item_id
  AND e.first_scan_id < v.first_scan_id AND e.last_scan_id >= v.first_scan_id)"""))
def k6(spark, sf):
    return repair.overlapping(stretched(spark, sf)[1]).select("item_id", "item_version")


@query("k7_rechain_overlaps", on_store(STRETCHED + """
, bad AS (SELECT DISTINCT v.item_id FROM stretched v JOIN stretched e ON e.item_id = v.item_id
  AND e.first_scan_id < v.first_scan_id AND e.last_scan_id >= v.first_scan_id),
chained AS (SELECT s.item_id, item_version, first_scan_id, item_type, CASE WHEN b.item_id IS NULL THEN last_scan_id
    ELSE coalesce(lead(first_scan_id) OVER w - 1, max(last_scan_id) OVER (PARTITION BY s.item_id)) END AS last_scan_id
  FROM stretched s LEFT JOIN bad b ON b.item_id = s.item_id JOIN items i ON i.item_id = s.item_id
  WINDOW w AS (PARTITION BY s.item_id ORDER BY first_scan_id))
SELECT item_id, item_version, first_scan_id, last_scan_id FROM chained WHERE item_type = 0 OR first_scan_id <= last_scan_id"""))
def k7(spark, sf):
    st, bad = stretched(spark, sf)
    return repair.rechain_overlaps(bad, st.items).select("item_id", "item_version", "first_scan_id", "last_scan_id")


FLAGGED = """
, flagged AS (SELECT v.* REPLACE (is_deleted OR (item_type = 1 AND item_version % 4 = 1) AS is_deleted), item_path, item_type
  FROM versions v JOIN items USING (item_id)),
wrong AS (SELECT v.item_id, v.item_version, v.root_id, v.first_scan_id, v.last_scan_id FROM flagged v
  WHERE item_type = 1 AND is_deleted AND EXISTS (SELECT 1 FROM flagged c WHERE c.root_id = v.root_id AND c.item_type = 0
    AND NOT c.is_deleted AND starts_with(c.item_path, v.item_path || '/')
    AND c.first_scan_id <= v.last_scan_id AND c.last_scan_id >= v.first_scan_id))"""


def flagged(spark, sf):
    st = store(spark, sf)
    rows = st.versions.join(st.items.select("item_id", "item_type"), "item_id").withColumn(
        "is_deleted", F.col("is_deleted") | ((F.col("item_type") == 1) & (F.col("item_version") % 4 == 1)))
    rows = rows.select(*st.versions.columns)
    return st, rows, repair.wrongly_deleted_folders(rows, st.items, st.roots)


@query("k9_wrongly_deleted_folders", on_store(FLAGGED + "SELECT * FROM wrong"))
def k9(spark, sf):
    return flagged(spark, sf)[2]


@query("k9_repaired_flags", on_store(FLAGGED + """
SELECT f.item_id, f.item_version, f.is_deleted AND w.item_id IS NULL AS is_deleted FROM flagged f
LEFT JOIN wrong w ON w.item_id = f.item_id AND w.item_version = f.item_version"""))
def k9_repaired(spark, sf):
    _, rows, wrong = flagged(spark, sf)
    return repair.repair_deletion_flags(rows, wrong).select("item_id", "item_version", "is_deleted")


@query("k9_affected_scans", on_store(FLAGGED + """
SELECT DISTINCT s.root_id, s.scan_id FROM scans s JOIN wrong w ON w.root_id = s.root_id
  AND s.scan_id BETWEEN w.first_scan_id AND w.last_scan_id WHERE s.state = 4"""))
def k9_scans(spark, sf):
    st, _, wrong = flagged(spark, sf)
    return repair.affected_scans(wrong, st.scans)


COUNTED = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in scanstats.LEVELS)
RECOUNT = """
, force AS (SELECT s.scan_id, v.item_id, v.item_version, v.size, v.val_state AS vs, item_type, has_validator
  FROM scans0 s JOIN stretched v ON v.root_id = s.root_id AND v.last_scan_id >= s.scan_id AND v.first_scan_id = (
    SELECT max(first_scan_id) FROM stretched w WHERE w.item_id = v.item_id AND w.first_scan_id <= s.scan_id)
  JOIN items USING (item_id) WHERE s.state = 4 AND NOT is_deleted),
shown AS (SELECT f.*, (SELECT max_by(hash_state, first_scan_id) FROM hashes h WHERE h.item_id = f.item_id
    AND h.item_version = f.item_version AND h.first_scan_id <= f.scan_id) AS hs FROM force f)
SELECT s.scan_id, {levels} FROM (SELECT scan_id FROM scans0 WHERE state = 4) s LEFT JOIN (
  SELECT scan_id, count_if(item_type = 0) AS file_count, count_if(item_type = 1) AS folder_count,
    sum(size) FILTER (item_type = 0) AS total_size,
    count(*) FILTER (item_type = 0 AND has_validator AND vs IS NULL) AS val_unknown_count,
    count(*) FILTER (vs = 1) AS val_valid_count, count(*) FILTER (vs = 2) AS val_invalid_count,
    count(*) FILTER (item_type = 0 AND NOT has_validator) AS val_no_validator_count,
    count(*) FILTER (item_type = 0 AND hs IS NULL) AS hash_unknown_count,
    count(*) FILTER (hs = 1) AS hash_baseline_count, count(*) FILTER (hs = 2) AS hash_suspect_count
  FROM shown GROUP BY scan_id) x ON x.scan_id = s.scan_id"""


@query("k10_recount_statistics", on_store(STRETCHED + RECOUNT.format(levels=COUNTED)))
def k10(spark, sf):
    st, rows = stretched(spark, sf)
    return scanstats.scan_levels(rows, st.items, st.hashes, st.scans, recount=True).drop("root_id")


def parts_recount_sql():
    from catalog.h_history import shipping_sql
    return f"""
WITH versions AS ({shipping_sql('l_partkey', 1)})
SELECT d * 100 + r AS scan_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size
FROM versions, (SELECT unnest(range(1, max(last_scan_id // 100) + 1)) AS d FROM versions) t,
  (SELECT DISTINCT first_scan_id % 100 AS r FROM versions) u
WHERE NOT is_deleted AND first_scan_id % 100 = r AND d BETWEEN first_scan_id // 100 AND last_scan_id // 100
GROUP BY 1"""


@query("k10_recount_parts", parts_recount_sql())
def k10_parts(spark, sf):
    versions = write_and_read(feeds.shipping_history(spark, sf), scratch_path(spark, "parts")).withColumns(
        {"val_state": F.lit(None).cast("int"), "val_scan_id": F.lit(None).cast("long")})
    items = versions.select("item_id").distinct().withColumns(
        {"item_type": F.lit(0), "has_validator": F.lit(False)})
    none = spark.createDataFrame([], HASHES)
    return scanstats.scan_levels(versions, items, none, feeds.shipping_scans(spark, sf)).where(
        F.col("file_count") > 0).select("scan_id", "file_count", "total_size")


# ---- K11 - K18 --------------------------------------------------------------------------------

@query("k11_purge_suspects", on_store("""
SELECT scan_id, hash_baseline_count + hash_suspect_count AS hash_baseline_count,
  CAST(CASE WHEN hash_suspect_count IS NOT NULL THEN 0 END AS BIGINT) AS hash_suspect_count,
  CAST(CASE WHEN hash_suspect_count IS NOT NULL THEN 0 END AS BIGINT) AS new_hash_suspect_count FROM scans"""))
def k11(spark, sf):
    st = store(spark, sf)
    return hash_ops.purge_suspects(st.versions, st.hashes, st.scans)[2].select(
        "scan_id", "hash_baseline_count", "hash_suspect_count", "new_hash_suspect_count")


@query("k11_kept_hashes", on_store("""
SELECT h.item_id, h.item_version, h.first_scan_id, CAST(NULL AS BIGINT) AS hash_reviewed_at
FROM hashes h JOIN versions v USING (item_id, item_version) WHERE hash_state = 1"""))
def k11_hashes(spark, sf):
    st = store(spark, sf)
    versions, kept, _ = hash_ops.purge_suspects(st.versions, st.hashes, st.scans)
    return kept.join(versions.select("item_id", "item_version", "hash_reviewed_at"), ["item_id", "item_version"]).select(
        "item_id", "item_version", "first_scan_id", "hash_reviewed_at")


@query("k12_backfill_new_issues", on_store(
    "SELECT scan_id, new_hash_suspect_count, new_val_invalid_count FROM scans"))
def k12(spark, sf):
    st = store(spark, sf)
    bare = st.scans.withColumns({c: F.lit(None).cast("long") for c in scanstats.NEW_ISSUES})
    return repair.backfill_new_issues(bare, st.versions, st.hashes).select("scan_id", *scanstats.NEW_ISSUES)


@query("k13_backfill_folder_counters", on_store("""
SELECT t.root_id, t.item_path AS folder_path, t.d * 100 + t.root_id AS scan_id, adds, mods, dels,
  coalesce(alive, 0) - adds - mods AS unchanged FROM tree t LEFT JOIN held h ON h.item_id = t.item_id AND h.d = t.d"""))
def k13(spark, sf):
    st = store(spark, sf)
    return repair.backfill_folder_counters(feeds.bare_history(spark, sf), st.items, st.roots)


@query("k14_folder_state_counts", on_store("""
SELECT s.root_id, n.scan_id, f.item_path AS folder_path, count(*) AS file_count,
  count(*) FILTER (n.has_validator AND vs IS NULL) AS val_unknown_count, count(*) FILTER (vs = 1) AS val_valid_count,
  count(*) FILTER (vs = 2) AS val_invalid_count, count(*) FILTER (NOT n.has_validator) AS val_no_validator_count,
  count(*) FILTER (hs IS NULL) AS hash_unknown_count, count(*) FILTER (hs = 1) AS hash_baseline_count,
  count(*) FILTER (hs = 2) AS hash_suspect_count
FROM seen n JOIN scans0 s ON s.scan_id = n.scan_id JOIN items i ON i.item_id = n.item_id
JOIN items f ON f.root_id = i.root_id AND f.item_type = 1 AND starts_with(i.item_path, f.item_path || '/')
WHERE n.item_type = 0 GROUP BY ALL"""))
def k14(spark, sf):
    st = store(spark, sf)
    return scanstats.folder_levels(st.versions, st.items, st.hashes, st.roots, st.scans)


@query("k15_consistency_report", on_store("""
, old AS (SELECT item_id, max_by(is_deleted, last_scan_id) <> (item_id % 7 = 0) AS is_deleted FROM versions GROUP BY item_id
  UNION ALL SELECT -doc_id - 1, false FROM labels),
few AS (SELECT * FROM versions WHERE item_id % 5 <> 0)
SELECT 'old item without identity' AS check, count(*) AS violations FROM labels
UNION ALL SELECT 'item without version', count(*) FROM items WHERE item_id % 5 = 0
UNION ALL SELECT 'deleted state differs', count(*) FROM old o JOIN (SELECT item_id, max_by(is_deleted, last_scan_id) AS g
  FROM few GROUP BY item_id) n ON n.item_id = o.item_id WHERE g <> o.is_deleted
UNION ALL SELECT 'item counts differ', CAST((SELECT count(*) FROM old) <> (SELECT count(*) FROM items) AS BIGINT)
UNION ALL SELECT 'fewer versions than items', CAST((SELECT count(*) FROM few) < (SELECT count(*) FROM items) AS BIGINT)"""))
def k15(spark, sf):
    st = store(spark, sf)
    newest = st.versions.groupBy("item_id").agg(
        (F.max_by("is_deleted", "last_scan_id") != (F.col("item_id") % 7 == 0)).alias("is_deleted"))
    extra = feeds.table(spark, sf, "labels").select((-F.col("doc_id") - 1).alias("item_id"), F.lit(False).alias("is_deleted"))
    few = st.versions.where(F.col("item_id") % 5 != 0)
    return repair.consistency_report(newest.unionByName(extra), st.with_(versions=few))


@query("k16_invariant_report", on_store("""
, chain AS (SELECT *, lag(hash_state) OVER (PARTITION BY item_id, item_version ORDER BY first_scan_id) AS before FROM hashes)
SELECT 'first hash is not baseline' AS check, count(*) AS violations FROM chain WHERE before IS NULL AND hash_state <> 1
UNION ALL SELECT 'baseline after suspect', count(*) FROM chain WHERE before = 2 AND hash_state = 1
UNION ALL SELECT 'version numbers with gaps', count(*) FROM (SELECT item_id FROM versions GROUP BY item_id
  HAVING count(*) <> max(item_version))
UNION ALL SELECT 'interval ends before it starts', count(*) FROM versions WHERE last_scan_id < first_scan_id
UNION ALL SELECT 'overlapping versions', count(*) FROM versions v WHERE EXISTS (SELECT 1 FROM versions e
  WHERE e.item_id = v.item_id AND e.first_scan_id < v.first_scan_id AND e.last_scan_id >= v.first_scan_id)
UNION ALL SELECT 'negative folder counters', count(*) FROM versions WHERE NOT is_deleted AND unchanged_count < 0
UNION ALL SELECT 'items with deep histories', count(*) FROM (SELECT item_id FROM versions GROUP BY item_id HAVING count(*) >= 20)
UNION ALL SELECT 'returned items', count(DISTINCT item_id) FROM versions WHERE is_added AND item_version > 1"""))
def k16(spark, sf):
    return repair.invariant_report(store(spark, sf), deep=20)


@query("k17_queue_to_tasks", """
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS status,
  coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) // 1000000 END, 0) AS run_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN '{"scan_id":' || (o_orderkey % 83 + 1) || ',"high_water_mark":'
         || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END || '}'
       WHEN o_orderkey % 2 = 0 THEN '{"high_water_mark":' || o_custkey || '}' END AS task_state,
  CASE WHEN o_orderstatus = 'P' THEN epoch_us(o_orderdate) // 1000000 END AS started_at
FROM orders""")
def k17(spark, sf):
    o, k = feeds.table(spark, sf, "orders"), F.col("o_orderkey")
    at = feeds.epoch_seconds(F.col("o_orderdate"))
    queue = o.select(
        k.alias("queue_id"), F.lit(1).alias("root_id"), F.lit(1).alias("schedule_id"), F.lit(0).alias("source"),
        (F.col("o_orderstatus") == "P").alias("is_active"), F.when(k % 4 != 0, at).alias("next_run_time"),
        F.when(k % 3 != 0, k % 83 + 1).alias("scan_id"), F.when(k % 2 == 0, F.col("o_custkey")).alias("analysis_hwm"),
        at.alias("created_at"))
    return tasks.queue_to_tasks(queue).select("task_id", "status", "run_at", "task_state", "started_at")


@query("k18_backfill_item_fields", on_store("SELECT item_id, file_extension, has_validator FROM items"))
def k18(spark, sf):
    bare = store(spark, sf).items.withColumns(
        {"file_extension": F.lit(None).cast("string"), "has_validator": F.lit(False)})
    return repair.backfill_item_fields(bare).select("item_id", "file_extension", "has_validator")


@query("k18_text_hashes_to_binary", """
SELECT doc_id, 32 AS width, upper(sha256(text)) AS hex FROM documents""")
def k18_hashes(spark, sf):
    rows = feeds.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return repair.text_hashes_to_binary(rows).select(
        "doc_id", F.octet_length("file_hash").alias("width"), F.hex("file_hash").alias("hex"))
