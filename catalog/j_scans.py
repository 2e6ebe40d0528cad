"""Scan lookups, trends, overviews, tasks and schedules."""

from pyspark.sql import functions as F

from catalog.base import on_store, query
from catalog.bf_domains import NATURAL
from tempora.operators import browse, scans, tasks
from tempora.operators.domains import page
from tempora.sources import feeds

store = feeds.activity_store
END = "epoch(TIMESTAMP '{}')"


@query("j1_scan_for_date", on_store(f"""
SELECT max_by(scan_id, started_at) AS scan_id FROM scans
WHERE root_id = 2 AND state = 4 AND started_at <= {END.format('2024-01-10 23:59:59')}"""))
def j1(spark, sf):
    return scans.resolve_scan(store(spark, sf).scans, 2, "2024-01-10")


@query("j1_scan_for_every_event_day", on_store("""
, asked AS (SELECT DISTINCT root_id, day * 86400 + 43200 AS until
  FROM (SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events) JOIN roots ON root = event_type)
SELECT root_id, until, (SELECT max_by(scan_id, started_at) FROM scans s
  WHERE s.root_id = a.root_id AND state = 4 AND started_at <= until) AS scan_id FROM asked a"""))
def j1_all(spark, sf):
    events = feeds.table(spark, sf, "events")
    day = feeds.day_number(F.col("ts"))
    asked = events.select(F.col("event_type").alias("root"), (day * 86400 + 43200).alias("until")).distinct().join(
        feeds.activity_roots(spark, sf), "root").select("root_id", "until")
    return scans.resolve_scans(store(spark, sf).scans, asked)


@query("j1_latest_completed", on_store("SELECT max(scan_id) AS scan_id FROM scans WHERE root_id = 2 AND state = 4"))
def j1_latest(spark, sf):
    return scans.resolve_scan(store(spark, sf).scans, 2)


@query("j2_latest_scan_per_root", on_store("""
SELECT root_id, max(scan_id) AS scan_id, max_by(state, scan_id) AS state FROM scans GROUP BY root_id"""))
def j2(spark, sf):
    return scans.latest_scans(store(spark, sf).scans).select("root_id", "scan_id", "state")


@query("j2_latest_scan", on_store("SELECT scan_id, root_id, state FROM scans ORDER BY scan_id DESC LIMIT 1"))
def j2_one(spark, sf):
    return scans.scan_or_latest(store(spark, sf).scans).select("scan_id", "root_id", "state")


@query("j3_scan_dates", on_store("""
SELECT DISTINCT strftime(to_timestamp(started_at)::TIMESTAMP, '%Y-%m-%d') AS day FROM scans
WHERE root_id = 4 AND state = 4 AND started_at >= epoch(TIMESTAMP '2024-01-01') AND started_at < epoch(TIMESTAMP '2024-02-01')"""))
def j3(spark, sf):
    return scans.scan_dates_in_month(store(spark, sf).scans, 4, 2024, 1)


@query("j4_scans_on_date", on_store(f"""
SELECT scan_id, started_at, add_count, modify_count, delete_count FROM scans WHERE root_id = 4 AND state = 4
  AND started_at BETWEEN {END.format('2024-01-10 00:00:00')} AND {END.format('2024-01-10 23:59:59')}"""))
def j4(spark, sf):
    return scans.scans_on_date(store(spark, sf).scans, 4, "2024-01-10")


@query("j5_scan_history", on_store("""
SELECT scan_id, started_at, file_count, total_size, add_count, hash_suspect_count FROM scans
WHERE root_id = 1 AND state = 4 ORDER BY started_at DESC LIMIT 10 OFFSET 5"""))
def j5(spark, sf):
    return page(scans.scan_history(store(spark, sf).scans, 1), 10, 5).select(
        "scan_id", "started_at", "file_count", "total_size", "add_count", "hash_suspect_count")


@query("j5_scan_history_total", on_store("SELECT count(*) AS count FROM scans WHERE root_id = 1 AND state = 4"))
def j5_total(spark, sf):
    return scans.scan_history(store(spark, sf).scans, 1).agg(F.count(F.lit(1)).alias("count"))


TREND = ", ".join(scans.TREND_COUNTERS)


def trend_sql(root, lo, hi):
    return f"""(SELECT scan_id, root_id, started_at, {TREND},
  file_count + folder_count - add_count - modify_count AS unchanged_count FROM scans
  WHERE root_id = {root} AND state = 4 AND started_at BETWEEN {END.format(lo)} AND {END.format(hi)})"""


@query("j6_trend", on_store("SELECT * FROM " + trend_sql(3, "2024-01-04 00:00:00", "2024-01-20 23:59:59")))
def j6(spark, sf):
    return scans.trend(store(spark, sf).scans, 3, "2024-01-04", "2024-01-20")


@query("j7_trend_presets", on_store("""
SELECT scan_id, CAST(d - INTERVAL 7 DAY AS DATE) AS from_7d, CAST(d - INTERVAL 30 DAY AS DATE) AS from_30d,
  CAST(d - INTERVAL 3 MONTH AS DATE) AS from_3m, CAST(d - INTERVAL 6 MONTH AS DATE) AS from_6m,
  CAST(d - INTERVAL 1 YEAR AS DATE) AS from_1y
FROM (SELECT scan_id, CAST(to_timestamp(started_at)::TIMESTAMP AS DATE) AS d FROM scans)"""))
def j7(spark, sf):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("started_at") / 86400).cast("int"))
    return store(spark, sf).scans.select("scan_id", *[
        scans.preset_window(p, day)[0].alias(f"from_{p}") for p in scans.PRESETS])


@query("j8_trend_filters", on_store(f"""
SELECT scan_id FROM {trend_sql(3, '2024-01-01 00:00:00', '2024-12-31 23:59:59')}
WHERE scan_id > (SELECT min(scan_id) FROM scans WHERE root_id = 3 AND state = 4)
  AND (add_count > 0 OR unchanged_count > 0) AND (new_hash_suspect_count > 0 OR val_invalid_count > 0)"""))
def j8(spark, sf):
    st = store(spark, sf)
    rows = scans.without_first_scan(scans.trend(st.scans, 3, "2024-01-01", "2024-12-31"), st.scans)
    rows = scans.with_visible_values(rows, ["add_count", "unchanged_count"])
    return scans.with_visible_values(rows, ["new_hash_suspect_count", "val_invalid_count"]).select("scan_id")


for _kind, _where in {"all": "true", "added": "is_added", "deleted": "is_deleted",
                      "modified": "NOT is_added AND NOT is_deleted"}.items():
    query(f"j9_scan_changes_{_kind}", on_store(f"""
SELECT item_id, item_path, item_type, is_added, is_deleted, size FROM versions JOIN items USING (item_id)
WHERE first_scan_id = 905 AND {_where}"""))(
        lambda spark, sf, kind=_kind: scans.scan_changes_list(store(spark, sf), 905, kind))


@query("j9_scan_changes_count", on_store("SELECT count(*) AS count FROM versions WHERE first_scan_id = 905"))
def j9_count(spark, sf):
    return scans.count_scan_changes(store(spark, sf), 905)


@query("j9_scan_changes_page", on_store("""
SELECT item_id, item_path, item_type, is_added, is_deleted, size FROM versions JOIN items USING (item_id)
WHERE first_scan_id = 905 ORDER BY item_path, item_id LIMIT 10 OFFSET 5"""))
def j9_page(spark, sf):
    return scans.scan_changes_page(store(spark, sf), 905, 10, 5)


@query("j10_root_overview", on_store("""
SELECT r.root_id, root_path, scan_id, state, file_count, folder_count, total_size FROM roots r
LEFT JOIN scans s ON s.root_id = r.root_id AND s.scan_id = (SELECT max(scan_id) FROM scans m WHERE m.root_id = r.root_id)"""))
def j10(spark, sf):
    return scans.root_overview(store(spark, sf)).select(
        "root_id", "root_path", "scan_id", "state", "file_count", "folder_count", "total_size")


@query("j10_root_page", on_store(f"""
SELECT r.root_id, root_path, (SELECT max(scan_id) FROM scans s WHERE s.root_id = r.root_id) AS scan_id FROM roots r
ORDER BY {NATURAL.format(p='root_path')}, root_id LIMIT 3 OFFSET 1"""))
def j10_page(spark, sf):
    return scans.root_overview_page(store(spark, sf), 3, 1).select("root_id", "root_path", "scan_id")


@query("j10_open_issues", on_store("""
SELECT (SELECT count(DISTINCT v.item_id) FROM versions v JOIN hashes h USING (item_id, item_version)
        WHERE hash_state = 2 AND hash_reviewed_at IS NULL) AS hash_issues,
  (SELECT count(DISTINCT item_id) FROM versions WHERE val_state = 2 AND val_reviewed_at IS NULL) AS val_issues"""))
def j10_issues(spark, sf):
    return scans.open_issue_counts(store(spark, sf))


@query("j11_roots_with_schedules", on_store("""
SELECT r.root_id, root_path, (SELECT max(scan_id) FROM scans s WHERE s.root_id = r.root_id) AS scan_id,
  (SELECT count(*) FROM schedules c WHERE c.root_id = r.root_id AND enabled AND deleted_at IS NULL) AS schedule_count
FROM roots r"""))
def j11(spark, sf):
    return scans.roots_with_schedules(store(spark, sf)).select("root_id", "root_path", "scan_id", "schedule_count")


J12 = """SELECT t.task_id, t.task_type, t.root_id, root_path, schedule_name, t.status, s.scan_id, s.add_count,
  s.was_restarted, s.new_hash_suspect_count
FROM tasks t LEFT JOIN roots r ON r.root_id = t.root_id LEFT JOIN schedules c ON c.schedule_id = t.schedule_id
LEFT JOIN scans s ON t.task_type = 0 AND s.scan_id = CAST(json_extract_string(task_state, '$.scan_id') AS BIGINT)
WHERE status IN (2, 3, 4)"""
J12_COLS = ["task_id", "task_type", "root_id", "root_path", "schedule_name", "status", "scan_id", "add_count",
            "was_restarted", "new_hash_suspect_count"]


@query("j12_task_history", on_store(J12))
def j12(spark, sf):
    return tasks.task_history(store(spark, sf)).select(*J12_COLS)


@query("j12_task_history_page", on_store(
    J12 + " AND t.root_id = 2 ORDER BY run_at DESC, t.task_id DESC LIMIT 30 OFFSET 10"))
def j12_page(spark, sf):
    rows = tasks.newest_finished_first(tasks.task_history(store(spark, sf), root_id=2))
    return page(rows, 30, 10).select(*J12_COLS)


@query("j12_task_history_count", on_store(
    "SELECT count(*) AS count FROM tasks WHERE status IN (2, 3, 4) AND task_type = 0"))
def j12_count(spark, sf):
    return tasks.task_history(store(spark, sf), task_type=0).agg(F.count(F.lit(1)).alias("count"))


@query("j13_upcoming_tasks", on_store("""
SELECT task_id, root_path, schedule_name, run_at, t.status, run_at <= 900000000 AS is_ready
FROM tasks t LEFT JOIN roots r ON r.root_id = t.root_id LEFT JOIN schedules c ON c.schedule_id = t.schedule_id
WHERE t.status IN (0, 1) ORDER BY t.status DESC, source, run_at, task_id LIMIT 500"""))
def j13(spark, sf):
    return tasks.upcoming_tasks(store(spark, sf), 900_000_000, paused=True).limit(500).select(
        "task_id", "root_path", "schedule_name", "run_at", "status", "is_ready")


@query("j14_schedule_list", on_store("""
SELECT s.schedule_id, s.root_id, root_path, enabled, schedule_name, run_at AS next_scan_time
FROM schedules s JOIN roots r ON r.root_id = s.root_id LEFT JOIN tasks t ON t.schedule_id = s.schedule_id AND t.status = 0
WHERE deleted_at IS NULL"""))
def j14(spark, sf):
    return tasks.schedule_list(store(spark, sf))


@query("j15_item_detail", on_store("""
SELECT i.item_id, item_path, file_extension, has_validator,
  (SELECT count(*) FROM versions v WHERE v.item_id = i.item_id) AS version_count,
  (SELECT max(item_version) FROM versions v WHERE v.item_id = i.item_id) AS item_version,
  (SELECT s.started_at FROM versions v JOIN scans s ON s.scan_id = v.last_scan_id WHERE v.item_id = i.item_id
     ORDER BY item_version DESC LIMIT 1) AS last_scan_date
FROM items i WHERE item_id = 703"""))
def j15(spark, sf):
    return browse.item_detail(store(spark, sf), 703).select(
        "item_id", "item_path", "file_extension", "has_validator", "version_count", "item_version", "last_scan_date")
