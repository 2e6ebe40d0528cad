"""Work lists, drift, validation, issues and review.  Scan 3003 is the newest of root 3."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import STORE, on_store, query
from catalog.bf_domains import NATURAL
from tempora.functions.paths import natural_key
from tempora.operators import checks, hashes, review
from tempora.sources import feeds

store = feeds.activity_store
LH = """LEFT JOIN (SELECT item_id, item_version, max_by(file_hash, first_scan_id) AS lh,
    max_by(last_scan_id, first_scan_id) AS ll FROM hashes GROUP BY item_id, item_version) h
  USING (item_id, item_version)"""
WORK = f"""(SELECT v.item_id, v.item_version, val_scan_id, ll,
    lh IS NULL OR ll < 2703 AS needs_hash,
    has_validator AND NOT do_not_validate AND coalesce(file_extension, '') <> 'jpg' AND val_state IS NULL AS needs_val
  FROM versions v JOIN items i USING (item_id) {LH}
  WHERE v.root_id = 3 AND v.last_scan_id = 2703 AND NOT is_deleted AND access <> 1 AND item_type = 0)"""


def candidates(spark, sf):
    return checks.work_candidates(store(spark, sf), 3, 2703, "all", True, ["jpg"])


@query("i1_work_list", on_store(f"""
SELECT item_id, item_version, needs_hash, needs_val FROM {WORK} WHERE needs_hash OR needs_val"""))
def i1(spark, sf):
    return checks.work_list(candidates(spark, sf)).select("item_id", "item_version", "needs_hash", "needs_val")


@query("i1_new_only_work_list", on_store(f"""
SELECT v.item_id, v.item_version FROM versions v JOIN items i USING (item_id) {LH}
WHERE v.root_id = 2 AND v.last_scan_id = 702 AND NOT is_deleted AND access <> 1 AND item_type = 0 AND lh IS NULL"""))
def i1_new(spark, sf):
    return checks.work_list(checks.work_candidates(store(spark, sf), 2, 702, "new")).select(
        "item_id", "item_version")


@query("i2_work_totals", on_store(f"""
SELECT count_if(needs_hash OR needs_val) AS total_needed,
  count(*) FILTER ((needs_hash AND ll = 2703) OR (needs_val AND val_scan_id = 2703)) AS total_done FROM {WORK}"""))
def i2(spark, sf):
    return checks.work_totals(candidates(spark, sf), 2703)


DRIFT = """
WITH seen AS (
  SELECT doc_id, s, sha256(text || CASE WHEN doc_id % 17 = 0 AND s >= 3 AND NOT (doc_id % 34 = 0 AND s >= 6)
    THEN '#' ELSE '' END) AS h FROM documents, range(1, 9) t(s)),
marked AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM seen),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> h THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
drift AS (SELECT doc_id AS item_id, min(s) AS first_scan_id, max(s) AS last_scan_id, h AS file_hash,
  CASE WHEN g = 1 THEN 1 ELSE 2 END AS hash_state FROM runs GROUP BY doc_id, g, h)
"""


def drift(spark, sf):
    return hashes.drift_history(feeds.document_hash_observations(feeds.table(spark, sf, "documents")))


@query("i3_hash_drift", DRIFT + "SELECT * FROM drift")
def i3(spark, sf):
    return drift(spark, sf).select("item_id", "first_scan_id", "last_scan_id", "file_hash", "hash_state")


@query("i3_hash_merge_one_scan", """
SELECT doc_id AS item_id, 1 AS first_scan_id, CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 3 END AS last_scan_id, 1 AS hash_state
FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, 3, 3, 2 FROM documents WHERE doc_id % 17 = 0 AND doc_id % 10 <> 0
UNION ALL SELECT doc_id, 3, 3, 1 FROM documents WHERE doc_id % 10 = 0""")
def i3_merge(spark, sf):
    seen = feeds.document_hash_observations(feeds.table(spark, sf, "documents"))
    old = hashes.drift_history(seen.where((F.col("scan_id") <= 2) & (F.col("item_id") % 10 != 0)))
    return hashes.merge_hashes(old, seen.where(F.col("scan_id") == 3), 3).select(
        "item_id", "first_scan_id", "last_scan_id", "hash_state")


@query("i4_validation_merge", on_store("""
SELECT v.item_id, v.item_version, CASE WHEN val_state IS NULL AND quality IS NOT NULL THEN 9999 ELSE val_scan_id END AS val_scan_id,
  CASE WHEN val_state IS NULL AND quality IS NOT NULL THEN 2 - quality ELSE val_state END AS val_state,
  CASE WHEN val_state IS NULL AND quality = 0 THEN 'low quality' ELSE val_error END AS val_error
FROM versions v LEFT JOIN labels ON doc_id = v.item_id AND v.item_version = 1"""))
def i4(spark, sf):
    labels = feeds.table(spark, sf, "labels")
    results = labels.select(
        F.col("doc_id").alias("item_id"), F.lit(1).alias("item_version"), (2 - F.col("quality")).alias("val_state"),
        F.when(F.col("quality") == 0, "low quality").alias("val_error"))
    return checks.merge_validation(store(spark, sf).versions, results, 9999).select(
        "item_id", "item_version", "val_scan_id", "val_state", "val_error")


OUTCOME = "CASE (v.item_id // 100) % 9 WHEN 1 THEN 'missing' WHEN 4 THEN 'denied' WHEN 7 THEN 'read' END"


@query("i5_access_reconciliation", on_store(f"""
, alive AS (SELECT v.*, CASE {OUTCOME} WHEN 'missing' THEN 1 WHEN 'denied' THEN 2 WHEN 'read' THEN 0 ELSE access END AS na
  FROM versions v JOIN items i USING (item_id) WHERE v.last_scan_id = 3003 AND NOT is_deleted AND item_type = 0)
SELECT v.item_id, v.item_version, v.first_scan_id,
  CASE WHEN a.na <> v.access AND v.first_scan_id < 3003 THEN 2903 ELSE v.last_scan_id END AS last_scan_id,
  CASE WHEN a.na <> v.access AND v.first_scan_id = 3003 THEN a.na ELSE v.access END AS access, v.size, v.val_state
FROM versions v LEFT JOIN alive a ON a.item_id = v.item_id AND a.item_version = v.item_version
UNION ALL
SELECT item_id, item_version + 1, 3003, 3003, na, size, NULL FROM alive WHERE na <> access AND first_scan_id < 3003"""))
def i5(spark, sf):
    st = store(spark, sf)
    alive = st.versions.where((F.col("last_scan_id") == 3003) & ~F.col("is_deleted")).join(
        st.items.where("item_type = 0").select("item_id"), "item_id")
    slot = F.floor(F.col("item_id") / 100) % 9
    outcome = F.when(slot == 1, "missing").when(slot == 4, "denied").when(slot == 7, "read")
    return checks.reconcile_access(
        st.versions, alive.select("item_id", "item_version", outcome.alias("outcome")), 3003, 2903
    ).select("item_id", "item_version", "first_scan_id", "last_scan_id", "access", "size", "val_state")


@query("i6_stale_guard", on_store("""
SELECT o.item_path FROM files o JOIN files n ON n.item_path = o.item_path AND n.d = 13
WHERE o.d = 12 AND (o.u % 6 = 0 OR n.size = o.size) AND n.mod_date = o.mod_date"""))
def i6(spark, sf):
    files = feeds.activity_files(spark, sf).withColumn(
        "day", F.floor(F.col("scan_id") / 100))
    old, new = files.where("day = 12"), files.where("day = 13")
    expected = old.withColumn("size", F.when(F.floor(F.col("item_id") / 100) % 6 != 0, F.col("size")))
    return checks.drop_stale(old.select("item_path"), expected, new)


@query("i7_content_check", """
SELECT page_id, CASE WHEN length(html) = 0 THEN 'empty' WHEN NOT regexp_matches(html, '<title>') THEN 'no title'
    WHEN NOT rtrim(lower(html)) LIKE '%</html>' THEN 'cut off' END AS val_error,
  CASE WHEN length(html) > 0 AND regexp_matches(html, '<title>') AND rtrim(lower(html)) LIKE '%</html>'
    THEN 1 ELSE 2 END AS val_state FROM pages""")
def i7(spark, sf):
    html = F.col("html")
    return checks.run_checks(feeds.table(spark, sf, "pages"), {
        "empty": F.length(html) > 0, "no title": html.contains("<title>"), "cut off": checks.is_whole_html(html),
    }).select("page_id", "val_error", "val_state")


def _chunk(kind, body):
    """A PNG chunk around a binary column: length, kind, body, checksum of kind and body."""
    four = F.concat(F.lit(kind.encode()), body)
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), four,
                    F.unhex(F.lpad(F.hex(F.crc32(four)), 8, "0")))


@query("i7_binary_content", """
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'gif' WHEN 3 THEN 'txt' ELSE 'png' END AS file_extension,
  CASE doc_id % 5 WHEN 4 THEN false WHEN 3 THEN NULL ELSE true END AS has_magic,
  CASE doc_id % 5 WHEN 3 THEN NULL WHEN 0 THEN 1 ELSE 2 END AS val_state,
  CASE doc_id % 5 WHEN 1 THEN 'cut off' WHEN 2 THEN 'checksum at 33' WHEN 4 THEN 'no gif signature' END AS val_error
FROM documents""")
def i7_binary(spark, sf):
    """Documents wrapped as PNG chunks: whole, cut, with a changed byte, and under other extensions."""
    body = F.encode(F.concat(F.lit("x"), F.coalesce("text", F.lit(""))), "UTF-8")
    kind = F.col("doc_id") % 5
    sound = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), _chunk("IHDR", F.unhex(F.lit("00000001000000010800000000"))),
                     _chunk("IDAT", body), _chunk("IEND", F.unhex(F.lit(""))))
    size = F.octet_length(sound)
    # byte 42 is the first of the data
    changed = F.concat(F.substring(sound, 1, 41), F.encode(F.lit("y"), "UTF-8"), F.substr(sound, F.lit(43), size))
    rows = feeds.table(spark, sf, "documents").select(
        "doc_id", F.when(kind == 4, "gif").when(kind == 3, "txt").otherwise("png").alias("file_extension"),
        F.when(kind == 1, F.substr(sound, F.lit(1), size - 5)).when(kind == 2, changed).otherwise(sound).alias("content"))
    return checks.check_content(rows).select(
        "doc_id", "file_extension", checks.has_magic(F.col("content"), F.col("file_extension")).alias("has_magic"),
        "val_state", "val_error")


HAS_HASH = ("EXISTS (SELECT 1 FROM hashes x WHERE x.item_id = v.item_id AND x.item_version = v.item_version "
            "AND x.hash_state = 2)")
VAL, VAL_OPEN = "(val_state IS NOT DISTINCT FROM 2)", "(val_state IS NOT DISTINCT FROM 2 AND val_reviewed_at IS NULL)"
HASH_OPEN = f"(hash_reviewed_at IS NULL AND {HAS_HASH})"
PREDICATES = {
    ("all", "unreviewed"): f"({VAL_OPEN} OR {HASH_OPEN})",
    ("all", "reviewed"): f"({VAL} OR {HAS_HASH}) AND NOT {VAL_OPEN} AND NOT {HASH_OPEN}",
    ("all", "all"): f"({VAL} OR {HAS_HASH})",
    ("val", "unreviewed"): VAL_OPEN,
    ("val", "reviewed"): f"{VAL} AND val_reviewed_at IS NOT NULL",
    ("val", "all"): VAL,
    ("hash", "unreviewed"): HASH_OPEN,
    ("hash", "reviewed"): f"{HAS_HASH} AND hash_reviewed_at IS NOT NULL",
    ("hash", "all"): HAS_HASH,
}
for (_kind, _status), _where in PREDICATES.items():
    def _run(spark, sf, kind=_kind, status=_status):
        st = store(spark, sf)
        return review.with_suspects(st.versions, st.hashes).where(
            review.issue_predicate(kind, status)).select("item_id", "item_version")

    query(f"i8_issues_{_kind}_{_status}", on_store(f"SELECT item_id, item_version FROM versions v WHERE {_where}"))(_run)


@query("i8_issues_three_valued", on_store(f"""
SELECT item_id, item_version FROM versions v WHERE (val_state = 2 OR {HAS_HASH})
  AND NOT (val_state = 2 AND val_reviewed_at IS NULL) AND NOT {HASH_OPEN}"""))
def i8_three_valued(spark, sf):
    st = store(spark, sf)
    return review.with_suspects(st.versions, st.hashes).where(
        review.issue_predicate("all", "reviewed", three_valued=True)).select("item_id", "item_version")


I9 = f"""FROM versions v JOIN items i USING (item_id) WHERE i.root_id = 2 AND item_type = 0 AND NOT is_deleted
  AND lower(item_path) LIKE '%/b_/d%' AND file_extension IN ('jpg', 'jpeg', 'png', 'gif', 'tiff', 'bmp')
  AND {PREDICATES['all', 'all']}"""
FILTER = review.IssueFilter("all", "all", 2, "/B_/d", review.EXTENSION_GROUPS["images"])


@query("i9_issue_filters", on_store(f"SELECT v.item_id, v.item_version {I9}"))
def i9(spark, sf):
    return review.issue_versions(store(spark, sf), FILTER).select("item_id", "item_version")


@query("i10_count_issue_items", on_store(f"SELECT count(DISTINCT v.item_id) AS count {I9}"))
def i10(spark, sf):
    return review.count_issue_items(store(spark, sf), FILTER)


def _summary(name, kind, status):
    def part(k, has, null):
        if kind not in ("all", k):
            return f"0 AS {k}_{'unreviewed' if null else 'reviewed'}"
        test = "IS NULL" if null else "IS NOT NULL"
        return (f"count(*) FILTER ({has} AND {k}_reviewed_at {test}) AS {k}_{'unreviewed' if null else 'reviewed'}")

    hs = "suspect"
    sql = f"""SELECT item_id, item_path, item_name, file_extension, do_not_validate, {part('hash', hs, True)},
  {part('hash', hs, False)}, {part('val', VAL, True)}, {part('val', VAL, False)}, max(last_scan_id) AS latest_scan_id
FROM (SELECT v.*, item_path, item_name, file_extension, do_not_validate, {HAS_HASH} AS suspect
  FROM versions v JOIN items i USING (item_id)
  WHERE item_type = 0 AND NOT is_deleted AND {PREDICATES[kind, status]}) GROUP BY ALL"""

    @query(name, on_store(sql))
    def run(spark, sf):
        return review.issue_items(store(spark, sf), review.IssueFilter(kind, status))


_summary("i11_issue_summary", "all", "all")
_summary("i11_issue_summary_hash", "hash", "unreviewed")


@query("i11_issue_page", on_store(f"""
SELECT item_id, item_path, row_number() OVER (ORDER BY {NATURAL.format(p='item_path')}, item_id) AS place
FROM (SELECT DISTINCT v.item_id, item_path FROM versions v JOIN items i USING (item_id)
  WHERE item_type = 0 AND NOT is_deleted AND {PREDICATES['all', 'all']})
ORDER BY place LIMIT 40 OFFSET 15"""))
def i11_page(spark, sf):
    rows = review.issue_items_page(store(spark, sf), review.IssueFilter("all", "all"), 40, 15)
    place = F.row_number().over(Window.orderBy(natural_key(F.col("item_path")), "item_id")) + 15
    return rows.select("item_id", "item_path", place.cast("long").alias("place"))


@query("i12_issue_versions", on_store(f"""
SELECT v.item_id, v.item_version, first_scan_id AS scan_id, started_at,
  (SELECT count(*) FROM hashes x WHERE x.item_id = v.item_id AND x.item_version = v.item_version) AS hash_count,
  (SELECT count(*) FROM hashes x WHERE x.item_id = v.item_id AND x.item_version = v.item_version
     AND x.hash_state = 2) AS suspect_count, val_state, val_error, val_reviewed_at, hash_reviewed_at
FROM versions v JOIN scans ON scan_id = first_scan_id WHERE {PREDICATES['all', 'all']}"""))
def i12(spark, sf):
    st = store(spark, sf)
    return review.issue_versions_of(st, st.items.select("item_id"), review.IssueFilter("all", "all"))


@query("i12_issue_versions_count", on_store(f"""
SELECT count(*) AS count FROM versions v WHERE {PREDICATES['all', 'all']}"""))
def i12_count(spark, sf):
    st = store(spark, sf)
    return review.count_issue_versions_of(st, st.items.select("item_id"), review.IssueFilter("all", "all"))


@query("i12_issue_versions_page", on_store(f"""
SELECT item_id, item_version, first_scan_id AS scan_id, started_at FROM versions v JOIN scans ON scan_id = first_scan_id
WHERE {PREDICATES['all', 'all']} ORDER BY item_version DESC, item_id LIMIT 10 OFFSET 5"""))
def i12_page(spark, sf):
    st = store(spark, sf)
    return review.issue_versions_page(st, st.items.select("item_id"), review.IssueFilter("all", "all"), 10, 5).select(
        "item_id", "item_version", "scan_id", "started_at")


MARK = 1_900_000_000


def _reviewed(name, chosen_sql, at, run, kinds=("val", "hash")):
    """Register the versions after a review and, apart, the number of marks it changed."""
    def new(kind, has):
        old = f"{kind}_reviewed_at"
        if kind not in kinds:
            return old
        due = f"{old} IS NULL" if at is not None else f"{old} IS NOT NULL"
        return f"CASE WHEN hit AND {has} AND {due} THEN {'NULL' if at is None else at} ELSE {old} END"

    rows = f"""(SELECT v.*, {HAS_HASH} AS suspect, {chosen_sql} AS hit FROM versions v)"""
    val, hsh = new("val", VAL), new("hash", "suspect")
    query(name, on_store(f"SELECT item_id, item_version, {val} AS val_reviewed_at, {hsh} AS hash_reviewed_at FROM {rows}"))(
        lambda spark, sf: run(store(spark, sf))[0].select(
            "item_id", "item_version", "val_reviewed_at", "hash_reviewed_at"))
    query(name + "_affected", on_store(f"""
SELECT count(*) FILTER (({val}) IS DISTINCT FROM val_reviewed_at)
  + count(*) FILTER (({hsh}) IS DISTINCT FROM hash_reviewed_at) AS affected FROM {rows}"""))(
        lambda spark, sf: run(store(spark, sf))[1])


_reviewed("i13_review_versions", "(v.root_id = 3 AND v.item_version <= 9)", MARK, lambda st: review.review(
    st, st.versions.where("root_id = 3 AND item_version <= 9").select("item_id", "item_version"), MARK))
_reviewed("i13_clear_reviews", "(v.root_id = 1)", None, lambda st: review.review(
    st, st.items.where("root_id = 1").select("item_id"), None))
_reviewed("i14_bulk_review_by_ids", "(v.item_id % 3 = 0)", MARK, lambda st: review.review(
    st, st.items.where("item_id % 3 = 0").select("item_id"), MARK, ["val"]), ["val"])
_reviewed("i15_bulk_review_by_filter", f"(v.item_id IN (SELECT v.item_id {I9}))", MARK,
          lambda st: review.review_by_filter(st, FILTER, MARK))


@query("i16_opt_out", on_store("""
SELECT item_id, do_not_validate OR item_id IN (SELECT item_id FROM versions WHERE val_state = 2) AS do_not_validate
FROM items"""))
def i16(spark, sf):
    st = store(spark, sf)
    return review.set_do_not_validate(st.items, st.versions.where("val_state = 2")).select(
        "item_id", "do_not_validate")


@query("i17_remaining_work", on_store(f"""
SELECT item_id, item_version FROM {WORK} WHERE (needs_hash OR needs_val) AND (item_id // 100) % 4 <> 0"""))
def i17(spark, sf):
    work = checks.work_list(candidates(spark, sf)).select("item_id", "item_version")
    return checks.remaining_work(work, work.where(F.floor(F.col("item_id") / 100) % 4 == 0))
