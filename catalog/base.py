"""Registration, and the activity store written once more as SQL over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


STORE = """
WITH span AS (
  SELECT min(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS d0,
         max(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS d1 FROM events),
roots AS (
  SELECT row_number() OVER (ORDER BY event_type) AS root_id, event_type AS root,
         '/' || event_type AS root_path
  FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
days AS (SELECT unnest(range(1, d1 - d0 + 2)) AS d, d0, d1 - d0 + 1 AS n FROM span),
scans0 AS (
  SELECT d * 100 + r * 50 + root_id AS scan_id, root_id, d, r, n,
    CASE WHEN d % 2 = 0 THEN root_id END AS schedule_id,
    (d0 + d) * 86400 - 3600 + r * 1800 AS started_at,
    (d0 + d) * 86400 - 3600 + r * 1800 + root_id * 61 - d AS ended_at,
    d % 13 = 0 AS was_restarted,
    CASE WHEN r = 0 THEN 4 WHEN root_id % 2 = 0 THEN 6 ELSE 5 END AS state,
    d % 10 <> 7 AS is_hash, d % 10 <> 7 AND d % 2 = 0 AS hash_all, d % 3 = 0 AS is_val,
    CASE WHEN r = 1 AND root_id % 2 = 0 THEN 'walk failed' END AS error
  FROM days, roots, (VALUES (0), (1)) t(r) WHERE r = 0 OR d % 10 = 0),
born AS (
  SELECT event_type, user_id, min(epoch_us(ts)) // 1000000 AS mod_date FROM events GROUP BY ALL),
daily AS (
  SELECT event_type, user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
         count(*) AS size FROM events GROUP BY ALL),
files AS (
  SELECT root_id, root_path, user_id AS u, day - d0 + 1 AS d, user_id * 100 + root_id AS item_id,
    root_path || '/b' || (user_id % 10) || '/d' || (user_id % 3) || '/u' || user_id ||
      CASE WHEN user_id % 8 = 1 THEN '.JPG' WHEN user_id % 4 = 0 THEN '.pdf'
           WHEN user_id % 4 = 1 THEN '.jpg' WHEN user_id % 4 = 2 THEN '.txt' ELSE '' END AS item_path,
    0 AS item_type,
    CASE WHEN size >= 3 AND user_id % 2 = 0 THEN 2
         WHEN size >= 3 AND user_id % 5 = 0 THEN 1 ELSE 0 END AS access,
    mod_date, size
  FROM daily JOIN born USING (event_type, user_id) JOIN roots ON root = event_type, span),
dirs AS (
  SELECT root_id, d, 1000000000000 + (b * 10 + dd) * 100 + root_id AS item_id, item_path,
         1 AS item_type, 0 AS access, max(mod_date) AS mod_date, CAST(sum(size) AS BIGINT) AS size
  FROM (
    SELECT root_id, d, u % 10 AS b, 0 AS dd, root_path || '/b' || (u % 10) AS item_path, mod_date, size
    FROM files
    UNION ALL
    SELECT root_id, d, u % 10, u % 3 + 1, root_path || '/b' || (u % 10) || '/d' || (u % 3), mod_date, size
    FROM files)
  GROUP BY ALL),
obs AS MATERIALIZED (
  SELECT root_id, d, item_id, item_path, item_type, access, mod_date, size FROM files
  UNION ALL
  SELECT root_id, d, item_id, item_path, item_type, access, mod_date, size FROM dirs),
items AS (
  SELECT DISTINCT item_id, root_id, item_path,
    regexp_extract(item_path, '([^/]+)$', 1) AS item_name,
    regexp_replace(item_path, '/[^/]+$', '') AS parent_path,
    CASE WHEN item_type = 0 AND regexp_extract(item_path, '([^/]+)$', 1) LIKE '_%.%'
         THEN lower(regexp_extract(item_path, '\\.([^./]*)$', 1)) END AS file_extension,
    item_type,
    item_type = 0 AND regexp_matches(lower(item_path), '\\.(flac|jpg|jpeg|png|gif|tiff|bmp|pdf)$')
      AS has_validator,
    item_type = 0 AND (item_id // 100) % 10 = 9 AS do_not_validate
  FROM obs),
begun AS (
  SELECT o.*, p.item_id IS NULL AS is_added,
         row_number() OVER (PARTITION BY o.item_id ORDER BY o.d) AS k
  FROM obs o LEFT JOIN obs p ON p.item_id = o.item_id AND p.d = o.d - 1
  WHERE p.item_id IS NULL OR p.access <> o.access OR p.mod_date <> o.mod_date OR p.size <> o.size),
ended AS (
  SELECT o.item_id, o.d, row_number() OVER (PARTITION BY o.item_id ORDER BY o.d) AS k
  FROM obs o LEFT JOIN obs q ON q.item_id = o.item_id AND q.d = o.d + 1
  WHERE q.item_id IS NULL OR q.access <> o.access OR q.mod_date <> o.mod_date OR q.size <> o.size),
plain AS (
  SELECT b.item_id, b.root_id, b.item_path, b.item_type, b.d AS f, e.d AS l, b.is_added,
         false AS is_deleted, b.access, b.mod_date, b.size
  FROM begun b JOIN ended e USING (item_id, k)
  UNION ALL
  SELECT o.item_id, o.root_id, o.item_path, o.item_type, o.d + 1, o.d + 1, false, true,
         o.access, o.mod_date, o.size
  FROM obs o LEFT JOIN obs q ON q.item_id = o.item_id AND q.d = o.d + 1
  WHERE q.item_id IS NULL AND o.d < (SELECT max(n) FROM days)),
moves AS (
  SELECT root_id, item_path, f, NOT is_deleted AND is_added AS a,
         NOT is_deleted AND NOT is_added AS m, is_deleted AS x FROM plain),
tree AS (
  SELECT i.item_id, i.root_id, i.item_path, v.f AS d, CAST(count_if(a) AS BIGINT) AS adds,
         CAST(count_if(m) AS BIGINT) AS mods, CAST(count_if(x) AS BIGINT) AS dels
  FROM items i JOIN moves v ON v.root_id = i.root_id AND starts_with(v.item_path, i.item_path || '/')
  WHERE i.item_type = 1 GROUP BY ALL),
held AS (
  SELECT i.item_id, o.d, count(*) AS alive
  FROM items i JOIN obs o ON o.root_id = i.root_id AND starts_with(o.item_path, i.item_path || '/')
  WHERE i.item_type = 1 GROUP BY ALL),
cuts AS (
  SELECT t.item_id, t.d FROM tree t
  WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.item_id = t.item_id AND p.f = t.d)),
folders AS (
  SELECT p.item_id, p.root_id, p.item_path, p.item_type, s.d AS f,
    coalesce((SELECT min(c.d) - 1 FROM cuts c
              WHERE c.item_id = p.item_id AND c.d > s.d AND c.d <= p.l), p.l) AS l,
    p.is_added AND s.d = p.f AS is_added, p.is_deleted, p.access, p.mod_date, p.size
  FROM plain p JOIN (SELECT item_id, f AS d FROM plain UNION SELECT item_id, d FROM cuts) s
    ON s.item_id = p.item_id AND s.d BETWEEN p.f AND p.l
  WHERE p.item_type = 1),
history AS MATERIALIZED (
  SELECT h.item_id, row_number() OVER (PARTITION BY h.item_id ORDER BY f) AS item_version, h.root_id,
    h.item_path, item_type, f, l, f * 100 + h.root_id AS first_scan_id,
    l * 100 + h.root_id AS last_scan_id, is_added, is_deleted, access, mod_date, size,
    CASE WHEN item_type = 1 THEN coalesce(adds, 0) END AS add_count,
    CASE WHEN item_type = 1 THEN coalesce(mods, 0) END AS modify_count,
    CASE WHEN item_type = 1 THEN coalesce(dels, 0) END AS delete_count,
    CASE WHEN item_type = 1
         THEN coalesce(alive, 0) - coalesce(adds, 0) - coalesce(mods, 0) END AS unchanged_count
  FROM (SELECT * FROM plain WHERE item_type = 0 UNION ALL SELECT * FROM folders) h
  LEFT JOIN tree t ON t.item_id = h.item_id AND t.d = h.f
  LEFT JOIN held a ON a.item_id = h.item_id AND a.d = h.f),
hashed AS (
  SELECT item_id, item_version, root_id, s.d,
    sha256(item_path || ':' || mod_date || ':' || size ||
      CASE WHEN (item_id // 100) % 7 = 0 AND s.d - f = 1 THEN ':drift'
           WHEN (item_id // 100) % 14 = 7 AND s.d - f >= 2 THEN ':drift' ELSE '' END) AS h
  FROM history JOIN (SELECT DISTINCT d FROM scans0 WHERE is_hash) s ON s.d BETWEEN f AND l
  WHERE item_type = 0 AND NOT is_deleted),
hash_marks AS (
  SELECT *, lag(h) OVER w AS before, row_number() OVER w AS rn
  FROM hashed WINDOW w AS (PARTITION BY item_id, item_version ORDER BY d)),
hashes AS MATERIALIZED (
  SELECT item_id, item_version, root_id, min(d) * 100 + root_id AS first_scan_id,
         max(d) * 100 + root_id AS last_scan_id, h AS file_hash,
         CASE WHEN bool_or(rn = 1) THEN 1 ELSE 2 END AS hash_state, min(d) AS hf
  FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> h THEN 1 ELSE 0 END)
                  OVER (PARTITION BY item_id, item_version ORDER BY d) AS g FROM hash_marks)
  GROUP BY item_id, item_version, root_id, g, h),
versions0 AS (
  SELECT v.*, val_scan_id,
    CASE WHEN val_scan_id IS NOT NULL
         THEN CASE WHEN (v.item_id // 100 + size) % 5 = 0 THEN 2 ELSE 1 END END AS val_state,
    EXISTS (SELECT 1 FROM hashes x WHERE x.item_id = v.item_id AND x.item_version = v.item_version
            AND x.hash_state = 2) AS suspect
  FROM (SELECT h.*, CASE WHEN NOT is_deleted AND has_validator AND NOT do_not_validate
                          AND ((f + 2) // 3) * 3 <= l
                         THEN ((f + 2) // 3) * 300 + h.root_id END AS val_scan_id
        FROM history h JOIN (SELECT item_id, has_validator, do_not_validate FROM items) i USING (item_id)) v),
versions AS MATERIALIZED (
  SELECT item_id, item_version, root_id, first_scan_id, last_scan_id, is_added, is_deleted, access,
    mod_date, size, add_count, modify_count, delete_count, unchanged_count, val_scan_id, val_state,
    CASE WHEN val_state = 2 THEN 'unexpected end after ' || size || ' bytes' END AS val_error,
    CASE WHEN val_state = 2 AND (item_id // 100) % 2 = 0 THEN 1800000000 END AS val_reviewed_at,
    CASE WHEN suspect AND (item_id // 100) % 3 = 0 THEN 1800000000 END AS hash_reviewed_at
  FROM versions0),
seen AS (
  SELECT s.scan_id, v.item_id, v.item_type, v.size, i.has_validator,
    CASE WHEN v.val_scan_id <= s.scan_id THEN v.val_state END AS vs,
    (SELECT max_by(x.hash_state, x.hf) FROM hashes x WHERE x.item_id = v.item_id
       AND x.item_version = v.item_version AND x.hf <= s.d) AS hs
  FROM scans0 s JOIN versions0 v ON v.root_id = s.root_id AND s.d BETWEEN v.f AND v.l
  JOIN items i ON i.item_id = v.item_id
  WHERE s.state = 4 AND NOT v.is_deleted),
levels AS (
  SELECT scan_id, count_if(item_type = 0) AS file_count, count_if(item_type = 1) AS folder_count,
    coalesce(sum(size) FILTER (item_type = 0), 0) AS total_size,
    count_if(item_type = 0 AND has_validator AND vs IS NULL) AS val_unknown_count,
    count_if(vs = 1) AS val_valid_count, count_if(vs = 2) AS val_invalid_count,
    count_if(item_type = 0 AND NOT has_validator) AS val_no_validator_count,
    count_if(item_type = 0 AND hs IS NULL) AS hash_unknown_count,
    count_if(hs = 1) AS hash_baseline_count, count_if(hs = 2) AS hash_suspect_count
  FROM seen GROUP BY scan_id),
changed AS (
  SELECT v.first_scan_id AS scan_id,
    count(*) FILTER (NOT v.is_deleted AND (p.item_id IS NULL OR p.is_deleted)) AS add_count,
    count(*) FILTER (NOT v.is_deleted AND NOT p.is_deleted) AS modify_count,
    count(*) FILTER (v.is_deleted AND NOT p.is_deleted) AS delete_count
  FROM history v LEFT JOIN history p ON p.item_id = v.item_id AND p.item_version = v.item_version - 1
  GROUP BY 1),
scans AS MATERIALIZED (
  SELECT s.scan_id, s.root_id, schedule_id, started_at, ended_at, was_restarted, state, is_hash,
    hash_all, is_val,
    {counters},
    error
  FROM scans0 s LEFT JOIN levels l ON l.scan_id = s.scan_id LEFT JOIN changed c ON c.scan_id = s.scan_id
  LEFT JOIN (SELECT first_scan_id AS scan_id, count(*) AS new_hash_suspect_count FROM hashes
             WHERE hash_state = 2 GROUP BY 1) hs ON hs.scan_id = s.scan_id
  LEFT JOIN (SELECT val_scan_id AS scan_id, count(*) AS new_val_invalid_count FROM versions
             WHERE val_state = 2 GROUP BY 1) vi ON vi.scan_id = s.scan_id),
schedules AS (
  SELECT root_id AS schedule_id, root_id, root_id % 3 <> 0 AS enabled,
    CASE WHEN root_id % 2 = 0 THEN 'Nightly ' ELSE 'nightly ' END || root AS schedule_name,
    CASE WHEN root_id % 4 = 0 THEN root_id * 2000 END AS deleted_at FROM roots),
tasks AS (
  SELECT o_orderkey AS task_id, CAST(o_orderkey % 4 AS INTEGER) AS task_type,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE
      CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END END AS status,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 6 + 1 END AS root_id,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 + 1 END AS schedule_id,
    epoch_us(o_orderdate) // 1000000 AS run_at, CAST(o_orderkey % 2 AS INTEGER) AS source,
    CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN NULL
         WHEN o_orderkey % 7 = 0 THEN '{"high_water_mark":' || (o_orderkey % 83) || '}'
         ELSE '{"scan_id":' || ((o_orderkey % 30 + 1) * 100 + o_orderkey % 5 + 1) || ',"high_water_mark":'
              || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 83 ELSE 0 END || '}' END AS task_state
  FROM orders)
""".replace("{counters}", ",\n    ".join(
    f"CASE WHEN s.state = 4 THEN CAST(coalesce({c}, 0) AS BIGINT) END AS {c}" for c in (
        "file_count", "folder_count", "total_size", "new_hash_suspect_count",
        "new_val_invalid_count", "add_count", "modify_count", "delete_count", "val_unknown_count",
        "val_valid_count", "val_invalid_count", "val_no_validator_count", "hash_unknown_count",
        "hash_baseline_count", "hash_suspect_count")))


def on_store(body: str) -> str:
    return STORE + body
