"""Domain relations, filters, formats, grouping, order and paging."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.functions import filters as C
from tempora.functions import formats as D
from tempora.functions import paths as P
from tempora.operators import domains as dom
from tempora.operators.browse import directories_first
from tempora.operators.hashes import duplicate_content
from tempora.sources import feeds

store = feeds.activity_store


def hexed():
    return F.lower(F.hex("file_hash"))


def scalar(df, **cols):
    return df.select(*[c.alias(n) for n, c in cols.items()])


# ---- B: relations -----------------------------------------------------------------------------

@query("b1_roots_domain", on_store("SELECT root_id, root_path FROM roots"))
def b1(spark, sf):
    return dom.ROOTS.read(store(spark, sf))


@query("b2_scans_domain", on_store(
    "SELECT " + ", ".join(c.source + " AS " + n if c.source else n for n, c in dom.SCANS.columns.items())
    + " FROM scans"))
def b2(spark, sf):
    return dom.show(dom.SCANS.read(store(spark, sf)), dom.SCANS, "all")


@query("b3_items_domain", on_store(f"SELECT {', '.join(dom.ITEMS.columns)} FROM items"))
def b3(spark, sf):
    return dom.show(dom.ITEMS.read(store(spark, sf)), dom.ITEMS, "all")


B4 = """(SELECT v.*, item_path, item_name, file_extension, item_type, has_validator,
  first_scan_id = (SELECT max(first_scan_id) FROM versions w WHERE w.item_id = v.item_id) AS is_current
  FROM versions v JOIN items i USING (item_id)) b4"""


@query("b4_versions_domain", on_store(f"SELECT {', '.join(dom.VERSIONS.columns)} FROM {B4}"))
def b4(spark, sf):
    return dom.show(dom.VERSIONS.read(store(spark, sf)), dom.VERSIONS, "all")


@query("b5_hashes_domain", on_store(f"""SELECT {', '.join('x.' + c if c not in ('item_path', 'item_name')
    else c for c in dom.HASHES.columns)}
FROM hashes x JOIN versions v ON v.item_id = x.item_id AND v.item_version = x.item_version
JOIN items i ON i.item_id = x.item_id"""))
def b5(spark, sf):
    return dom.HASHES.read(store(spark, sf)).withColumn("file_hash", hexed())


@query("b6_column_selection", on_store("""
SELECT item_version, item_id, root_id, item_path, item_type, first_scan_id, last_scan_id, is_deleted,
       mod_date, size, val_error FROM versions JOIN items USING (item_id, root_id)"""))
def b6(spark, sf):
    return dom.show(dom.VERSIONS.read(store(spark, sf)), dom.VERSIONS, "default", "val_error")


# ---- C: filters -------------------------------------------------------------------------------

def versions_where(name, condition, *preds):
    """Register a filter over the versions domain."""
    @query(name, on_store(f"SELECT item_id, item_version FROM {B4} WHERE {condition}"))
    def run(spark, sf):
        st = store(spark, sf)
        df = dom.VERSIONS.read(st).join(st.items.select("item_id", "has_validator"), "item_id")
        return df.where(C.all_of(*[p() for p in preds])).select("item_id", "item_version")
    return run


versions_where("c1_id_filter", "(first_scan_id IN (101, 205) OR first_scan_id BETWEEN 1001 AND 1203) "
               "AND (val_scan_id IS NULL OR val_scan_id BETWEEN 1200 AND 1210)",
               lambda: C.id_filter(F.col("first_scan_id"), 101, 205, (1001, 1203), (9, 3)),
               lambda: C.id_filter(F.col("val_scan_id"), "null", (1200, 1210)))
versions_where("c2_date_filter", "mod_date BETWEEN epoch(TIMESTAMP '2024-01-02 00:00:00') "
               "AND epoch(TIMESTAMP '2024-01-04 23:59:59') "
               "OR mod_date BETWEEN epoch(TIMESTAMP '2024-01-06 12:00:00') AND 1704600000",
               lambda: C.date_filter(F.col("mod_date"), ("2024-01-02", "2024-01-04"),
                                     ("2024-01-06 12:00:00", 1704600000)))
versions_where("c5_bool_filter", "is_added AND NOT is_deleted AND is_current IN (true)",
               lambda: C.bool_filter(F.col("is_added"), True),
               lambda: C.bool_filter(F.col("is_deleted"), False, "null"),
               lambda: C.bool_filter(F.col("is_current"), True))
versions_where("c6_string_filter", "(contains(lower(file_extension), 'jp') OR file_extension IS NULL) "
               "AND (val_error IS NULL OR lower(val_error) LIKE '%after_1%')",
               lambda: C.string_filter(F.col("file_extension"), "JP", "null"),
               lambda: C.string_filter(F.col("val_error"), "AFTER_1", "null", wildcards=True))
versions_where("c8_path_filter", "contains(lower(item_path), '/b3/d1') OR contains(lower(item_path), 'u77')",
               lambda: C.path_filter(F.col("item_path"), "/B3/d1", "U77"))
versions_where("c9_enum_filter", "item_type = 0 AND access IN (1, 2) AND (val_state = 1 OR val_state IS NULL)",
               lambda: C.enum_filter(F.col("item_type"), "item_type", "f", "Symlink"),
               lambda: C.enum_filter(F.col("access"), "access", "MetaError", "R"),
               lambda: C.enum_filter(F.col("val_state"), "val_state", "valid", "null"))
versions_where("c10_val_state_filter", "item_type = 0 AND (NOT has_validator "
               "OR (has_validator AND val_state IS NULL) OR val_state = 2)",
               lambda: F.col("item_type") == 0,
               lambda: C.val_state_filter(F.col("val_state"), F.col("has_validator"), "N", "unknown", "I"))
versions_where("c11_int_compare", "size > 2 AND size < 40",
               lambda: C.compare_filter(F.col("size"), ">", 2),
               lambda: C.compare_filter(F.col("size"), "<", 40))
versions_where("c12_and_or", "(root_id IN (1, 3)) AND (is_deleted OR size IS NULL OR size BETWEEN 2 AND 3)",
               lambda: C.id_filter(F.col("root_id"), 1, 3),
               lambda: C.any_of([C.bool_filter(F.col("is_deleted"), True),
                                 C.int_filter(F.col("size"), "null", (2, 3))]))


@query("c7_hash_filter", on_store("""
SELECT item_id, item_version, first_scan_id FROM hashes
WHERE contains(file_hash, 'abc') OR contains(file_hash, '00f')"""))
def c7(spark, sf):
    return store(spark, sf).hashes.where(C.hash_filter(F.col("file_hash"), "aBc", "00F")).select(
        "item_id", "item_version", "first_scan_id")


@query("c9_scan_state_filter", on_store("SELECT scan_id FROM scans WHERE state IN (5, 6)"))
def c9_scan_state(spark, sf):
    return store(spark, sf).scans.where(
        C.enum_filter(F.col("state"), "scan_state", "Stopped", "E")).select("scan_id")


@query("c9_hash_state_filter", on_store("SELECT item_id, item_version, first_scan_id FROM hashes WHERE hash_state = 2"))
def c9_hash_state(spark, sf):
    return store(spark, sf).hashes.where(C.enum_filter(F.col("hash_state"), "hash_state", "suspect")).select(
        "item_id", "item_version", "first_scan_id")


# ---- D: formats -------------------------------------------------------------------------------

@query("d1_date_format", on_store("""
SELECT item_id, item_version, strftime(to_timestamp(mod_date)::TIMESTAMP, '%Y-%m-%d') AS short,
  strftime(to_timestamp(mod_date)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS long,
  CAST(mod_date AS VARCHAR) AS epoch,
  coalesce(strftime(to_timestamp(val_reviewed_at)::TIMESTAMP, '%Y-%m-%d'), '-') AS reviewed FROM versions"""))
def d1(spark, sf):
    m = F.col("mod_date")
    return scalar(store(spark, sf).versions, item_id=F.col("item_id"), item_version=F.col("item_version"),
                  short=D.format_date(m), long=D.format_date(m, "full"), epoch=D.format_date(m, "timestamp"),
                  reviewed=D.format_date(F.col("val_reviewed_at")))


@query("d2_bool_format", on_store("""
SELECT item_id, item_version, CASE WHEN is_added THEN 'T' ELSE 'F' END AS short,
  CASE WHEN is_deleted THEN 'True' ELSE 'False' END AS long FROM versions"""))
def d2(spark, sf):
    return scalar(store(spark, sf).versions, item_id=F.col("item_id"), item_version=F.col("item_version"),
                  short=D.format_bool(F.col("is_added")), long=D.format_bool(F.col("is_deleted"), "full"))


@query("d3_enum_labels", on_store("""
SELECT item_id, item_version, CASE item_type WHEN 0 THEN 'F' ELSE 'D' END AS type_short,
  CASE item_type WHEN 0 THEN 'File' ELSE 'Directory' END AS type_full,
  CASE access WHEN 0 THEN 'No Error' WHEN 1 THEN 'Meta Error' ELSE 'Read Error' END AS access_full,
  CASE val_state WHEN 1 THEN 'V' WHEN 2 THEN 'I' ELSE '' END AS val_short
FROM versions JOIN items USING (item_id)"""))
def d3(spark, sf):
    st = store(spark, sf)
    return scalar(st.versions.join(st.items, "item_id"), item_id=F.col("item_id"),
                  item_version=F.col("item_version"),
                  type_short=D.format_enum(F.col("item_type"), "item_type"),
                  type_full=D.format_enum(F.col("item_type"), "item_type", "full"),
                  access_full=D.format_enum(F.col("access"), "access", "full"),
                  val_short=D.format_enum(F.col("val_state"), "val_state", null=""))


@query("d3_scan_state_labels", on_store("""
SELECT scan_id, CASE state WHEN 4 THEN 'C' WHEN 5 THEN 'P' ELSE 'E' END AS short,
  CASE state WHEN 4 THEN 'Completed' WHEN 5 THEN 'Stopped' ELSE 'Error' END AS long FROM scans"""))
def d3_scans(spark, sf):
    return scalar(store(spark, sf).scans, scan_id=F.col("scan_id"),
                  short=D.format_enum(F.col("state"), "scan_state"),
                  long=D.format_enum(F.col("state"), "scan_state", "full"))


PAGE = """(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  '/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS root_path,
  '/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
      || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS item_path, length(html) AS size FROM pages) p"""


@query("d4_path_name", f"""
SELECT page_id, CASE WHEN regexp_extract(regexp_replace(item_path, '/+$', ''), '([^/]+)$', 1) IN ('', '..')
  THEN item_path ELSE regexp_extract(regexp_replace(item_path, '/+$', ''), '([^/]+)$', 1) END AS name FROM {PAGE}""")
def d4(spark, sf):
    return scalar(feeds.page_files(feeds.table(spark, sf, "pages")), page_id=F.col("page_id"),
                  name=P.path_name(F.col("item_path")))


@query("d5_short_path", f"""
SELECT page_id, array_to_string(list_concat(
  list_transform(string_split(item_path, '/')[:-2], lambda x: substr(x, 1, 1)),
  string_split(item_path, '/')[-1:]), '/') AS short FROM {PAGE}""")
def d5(spark, sf):
    return scalar(feeds.page_files(feeds.table(spark, sf, "pages")), page_id=F.col("page_id"),
                  short=P.short_path(F.col("item_path")))


@query("d6_null_placeholder", on_store("""
SELECT item_id, item_version, coalesce(CAST(val_scan_id AS VARCHAR), '-') AS scan,
  coalesce(val_error, '-') AS error FROM versions"""))
def d6(spark, sf):
    return scalar(store(spark, sf).versions, item_id=F.col("item_id"), item_version=F.col("item_version"),
                  scan=D.or_dash(F.col("val_scan_id")), error=D.or_dash(F.col("val_error")))


@query("d7_aggregate_cells", on_store("""
SELECT item_id, printf('%.2f', avg(size)) AS mean, CAST(max(size) AS VARCHAR) AS largest,
  coalesce(max(file_hash), '-') AS hash
FROM versions LEFT JOIN hashes USING (item_id, item_version) GROUP BY item_id"""))
def d7(spark, sf):
    st = store(spark, sf)
    out = st.versions.join(st.hashes, ["item_id", "item_version"], "left").groupBy("item_id").agg(
        F.avg("size").alias("a"), F.max("size").alias("m"), F.max("file_hash").alias("h"))
    return scalar(out, item_id=F.col("item_id"), mean=D.format_real(F.col("a")),
                  largest=D.or_dash(F.col("m")), hash=D.format_hash(F.col("h")))


def _size_sql(x, base, units, digits):
    parts = []
    for i, u in enumerate(units):
        up = 2 ** (digits + 1)
        value = f"({x} / {float(base ** i)!r}::DOUBLE)"
        tie = f"CASE WHEN ({value} * {up}) % 2 = 1 THEN {10.0 ** -(digits + 1)!r} ELSE 0 END"
        text = f"printf('%.{digits}f', {value} + {tie}) || ' {u}'"
        parts.append(f"WHEN {x} < {base ** (i + 1)} THEN {text}" if i < len(units) - 1 else f"ELSE {text}")
    return "CASE " + " ".join(parts) + " END"


BIG = "CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 1000) * (o_orderkey % 7)"


@query("d8_file_size", f"""
SELECT o_orderkey, CASE WHEN s < 1000 THEN s || ' B'
    ELSE {_size_sql('s', 1000, D.DECIMAL_UNITS, 1)} || ' (' || {_size_sql('s', 1024, D.BINARY_UNITS, 2)} || ')'
  END AS both, CASE WHEN s < 1000 THEN s || ' B' ELSE {_size_sql('s', 1000, D.DECIMAL_UNITS, 1)} END AS compact
FROM (SELECT o_orderkey, {BIG} // (CASE WHEN o_orderkey % 3 = 0 THEN 100000 ELSE 1 END) AS s FROM orders)""")
def d8(spark, sf):
    o = feeds.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = F.round(F.col("o_totalprice") * 100).cast("long") * (k % 1000) * (k % 7)
    o = o.withColumn("s", F.when(k % 3 == 0, F.floor(s / 100000)).otherwise(s))
    return scalar(o, o_orderkey=k, both=D.format_size(F.col("s")), compact=D.format_size_compact(F.col("s")))


@query("d9_parent_and_ancestors", f"""
SELECT page_id, CASE WHEN len(parts) > 1 THEN '/' || array_to_string(parts[:-2], '/') ELSE '/' END AS parent,
  len(parts) = 2 AS under_host,
  array_to_string(list_transform(range(2, len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/')), ' ') AS chain
FROM (SELECT *, list_filter(string_split(item_path, '/'), lambda x: x <> '') AS parts FROM {PAGE})""")
def d9(spark, sf):
    p = F.col("item_path")
    return scalar(feeds.page_files(feeds.table(spark, sf, "pages")), page_id=F.col("page_id"),
                  parent=P.parent_path(p), under_host=P.is_immediate_child(p, F.col("root_path")),
                  chain=F.array_join(P.ancestor_chain(F.col("root_path"), p), " "))


@query("d10_file_extension", on_store("SELECT item_id, file_extension FROM items"))
def d10(spark, sf):
    i = store(spark, sf).items
    return scalar(i, item_id=F.col("item_id"),
                  file_extension=P.file_extension(P.path_name(F.col("item_path")), F.col("item_type")))


@query("d11_has_validator", on_store("SELECT item_id, has_validator FROM items"))
def d11(spark, sf):
    i = store(spark, sf).items
    ext = P.file_extension(F.col("item_name"), F.col("item_type"))
    return scalar(i, item_id=F.col("item_id"), has_validator=P.has_validator(ext))


@query("d12_elapsed", on_store("""
SELECT scan_id, CASE WHEN ended_at - started_at < 60 THEN (ended_at - started_at) || 's'
  ELSE ((ended_at - started_at) // 60) || 'm ' || ((ended_at - started_at) % 60) || 's' END AS elapsed FROM scans"""))
def d12(spark, sf):
    return scalar(store(spark, sf).scans, scan_id=F.col("scan_id"),
                  elapsed=D.format_elapsed(F.col("ended_at") - F.col("started_at")))


@query("d13_hex_binary", """
SELECT doc_id, sha256(text) AS hex, upper(substr(sha256(text), 1, 8)) AS head FROM documents""")
def d13(spark, sf):
    blob = D.hex_to_binary(F.sha2("text", 256))
    return scalar(feeds.table(spark, sf, "documents"), doc_id=F.col("doc_id"), hex=D.binary_to_hex(blob),
                  head=F.hex(F.substring(blob, 1, 4)))


@query("d14_json_field", on_store("""
SELECT task_id, CAST(json_extract_string(task_state, '$.scan_id') AS BIGINT) AS scan_id,
  CAST(json_extract_string(task_state, '$.high_water_mark') AS BIGINT) AS mark FROM tasks"""))
def d14(spark, sf):
    return scalar(store(spark, sf).tasks, task_id=F.col("task_id"),
                  scan_id=D.json_long(F.col("task_state"), "scan_id"),
                  mark=D.json_long(F.col("task_state"), "high_water_mark"))


@query("d15_json_build", on_store("SELECT task_id, task_state FROM tasks"))
def d15(spark, sf):
    return feeds.order_tasks(feeds.table(spark, sf, "orders")).select("task_id", "task_state")


# ---- E: aggregation ---------------------------------------------------------------------------

def grouped(name, sql, domain, by, order=(), **aggs):
    @query(name, on_store(sql))
    def run(spark, sf):
        return dom.group(domain.read(store(spark, sf)), domain, by, order, **aggs)
    return run


grouped("e1_group_by", f"""SELECT root_id, item_type, is_current, count(*) AS n FROM {B4}
GROUP BY root_id, item_type, is_current""", dom.VERSIONS, ["root_id", "item_type", "is_current"], n="count(*)")
grouped("e2_count_rows", "SELECT file_extension, count(*) AS n FROM items GROUP BY file_extension",
        dom.ITEMS, ["file_extension"], n="count(*)")
grouped("e3_count_column", "SELECT root_id, count(val_error) AS errors, count(val_scan_id) AS checked "
        "FROM versions GROUP BY root_id", dom.VERSIONS, ["root_id"], errors="count(val_error)",
        checked="count(val_scan_id)")
grouped("e4_sum_avg", "SELECT item_id, CAST(sum(size) AS BIGINT) AS total, avg(size) AS mean FROM versions "
        "GROUP BY item_id", dom.VERSIONS, ["item_id"], total="sum(size)", mean="avg(size)")
grouped("e5_min_max", "SELECT root_id, min(mod_date) AS oldest, max(mod_date) AS newest, max(size) AS largest, "
        "min(first_scan_id) AS first_scan FROM versions GROUP BY root_id", dom.VERSIONS, ["root_id"],
        oldest="min(mod_date)", newest="max(mod_date)", largest="max(size)", first_scan="min(first_scan_id)")
grouped("e4_global_aggregate", "SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM versions",
        dom.VERSIONS, [], n="count(*)", total="sum(size)")


@query("e6_order_by_aggregate", on_store("""
SELECT item_path, count(*) AS n FROM versions JOIN items USING (item_id) GROUP BY item_path
ORDER BY sum(size) DESC, count(*) DESC, item_path LIMIT 25"""))
def e6(spark, sf):
    out = dom.group(dom.VERSIONS.read(store(spark, sf)), dom.VERSIONS, ["item_path"],
                    [("sum(size)", "desc"), ("n", "desc"), ("item_path", "asc")], n="count(*)")
    return out.limit(25)


@query("e7_count_of_result", on_store("""
SELECT count(*) AS count FROM (SELECT file_extension FROM items GROUP BY file_extension, root_id
  ORDER BY file_extension LIMIT 20 OFFSET 3)"""))
def e7(spark, sf):
    groups = dom.group(dom.ITEMS.read(store(spark, sf)), dom.ITEMS, ["file_extension", "root_id"], n="count(*)")
    return dom.count_result(groups, 20, 3)


@query("e8_conditional_aggregates", on_store("""
SELECT root_id, count_if(is_added) AS adds, count_if(is_deleted) AS deletes,
  count(*) FILTER (size > 2) AS large FROM versions GROUP BY root_id"""))
def e8(spark, sf):
    return store(spark, sf).versions.groupBy("root_id").agg(
        F.count_if("is_added").alias("adds"), F.count_if("is_deleted").alias("deletes"),
        F.count_if(F.col("size") > 2).alias("large"))


@query("e9_distinct_count", on_store("SELECT root_id, count(DISTINCT item_id) AS items FROM versions GROUP BY root_id"))
def e9(spark, sf):
    return store(spark, sf).versions.groupBy("root_id").agg(F.count_distinct("item_id").alias("items"))


@query("e10_duplicate_content", """
SELECT sha256(text) AS file_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def e10(spark, sf):
    docs = feeds.table(spark, sf, "documents")
    return duplicate_content(docs.select(F.sha2("text", 256).alias("file_hash")))


# ---- F: order and paging ----------------------------------------------------------------------

@query("f1_multi_key_order", on_store("""
SELECT item_id, item_version, val_scan_id, size FROM versions
ORDER BY val_scan_id DESC NULLS LAST, size ASC NULLS FIRST, item_id, item_version LIMIT 200"""))
def f1(spark, sf):
    df = dom.order_by(dom.VERSIONS.read(store(spark, sf)), dom.VERSIONS, ("val_scan_id", "desc"), "size",
                      "item_id", "item_version")
    return df.limit(200).select("item_id", "item_version", "val_scan_id", "size")


NATURAL = "list_transform(list_filter(string_split(lower({p}), '/'), lambda x: x <> ''), " \
          "lambda x: regexp_replace(x, '[0-9]+', lpad(regexp_extract(x, '[0-9]+'), 20, '0')))"


@query("f2_natural_path_order", on_store(f"""
SELECT item_id, item_path, rn FROM (SELECT item_id, item_path,
  row_number() OVER (ORDER BY {NATURAL.format(p='item_path')}, item_id) AS rn FROM items) WHERE rn <= 300"""))
def f2(spark, sf):
    top = dom.order_by(dom.ITEMS.read(store(spark, sf)), dom.ITEMS, "item_path", "item_id").limit(300)
    rank = F.row_number().over(Window.orderBy(P.natural_key(F.col("item_path")), "item_id"))
    return top.select("item_id", "item_path", rank.cast("long").alias("rn"))


@query("f3_limit_offset", on_store("SELECT item_id FROM items ORDER BY item_id LIMIT 40 OFFSET 25"))
def f3(spark, sf):
    df = dom.order_by(dom.ITEMS.read(store(spark, sf)), dom.ITEMS, "item_id").select("item_id")
    return dom.page(df, 40, 25)


@query("f4_page_override", on_store("SELECT item_id FROM items ORDER BY item_id LIMIT 20 OFFSET 35"))
def f4(spark, sf):
    df = dom.order_by(dom.ITEMS.read(store(spark, sf)), dom.ITEMS, "item_id").select("item_id")
    return dom.page_override(df, 50, 30, limit=50, offset=5)


@query("f6_directories_first", on_store("""
SELECT item_id, item_type, size FROM versions JOIN items USING (item_id)
WHERE first_scan_id = 101 ORDER BY item_type = 1 DESC, coalesce(size, -1) DESC, item_id LIMIT 60"""))
def f6(spark, sf):
    st = store(spark, sf)
    rows = st.versions.where(F.col("first_scan_id") == 101).join(st.items.drop("root_id"), "item_id")
    return directories_first(rows, "size", descending=True).limit(60).select("item_id", "item_type", "size")


@query("f7_latest_per_group", on_store("""
SELECT item_id, max(item_version) AS item_version, max_by(last_scan_id, item_version) AS last_scan_id,
  max_by(is_deleted, item_version) AS is_deleted FROM versions GROUP BY item_id"""))
def f7(spark, sf):
    from tempora.operators.asof import current_versions
    return current_versions(store(spark, sf).versions).select(
        "item_id", "item_version", "last_scan_id", "is_deleted")
