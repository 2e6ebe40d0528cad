"""Flagship, sources and sinks."""

from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.functions import paths as P
from tempora.operators.hashes import content_hash
from tempora.operators.history import build_history
from tempora.plans.sizing import scratch_path
from tempora.sources import commits, feeds, files, tables, walk
from tempora.sources.events import day_number, snapshots_from_events
from tempora.schemas import SCANS, VERSIONS


@query("flagship_alive_per_root", on_store("""
SELECT root_path, count(*) AS alive_items, CAST(sum(size) AS BIGINT) AS total_size
FROM versions JOIN items USING (item_id, root_id) JOIN roots USING (root_id)
WHERE item_type = 0 AND NOT is_deleted AND last_scan_id = (
  SELECT max(scan_id) FROM scans s WHERE s.root_id = versions.root_id AND state = 4)
GROUP BY root_path"""))
def flagship(spark, sf):
    scans = feeds.activity_scans(spark, sf)
    history = build_history(feeds.activity_files(spark, sf), scans)
    newest = scans.where("state = 4").groupBy("root_id").agg(F.max("scan_id").alias("last_scan_id"))
    alive = history.where(~F.col("is_deleted")).join(newest, ["root_id", "last_scan_id"])
    return alive.join(feeds.activity_roots(spark, sf), "root_id").groupBy("root_path").agg(
        F.count(F.lit(1)).alias("alive_items"), F.sum("size").alias("total_size"))


VERSION_COLS = [f.name for f in VERSIONS]


@query("a1_version_table", on_store(f"SELECT {', '.join(VERSION_COLS)} FROM versions"))
def a1_versions(spark, sf):
    return feeds.activity_store(spark, sf).versions.select(*VERSION_COLS)


@query("a1_scan_table", on_store(f"SELECT {', '.join(f.name for f in SCANS)} FROM scans"))
def a1_scans(spark, sf):
    return feeds.activity_store(spark, sf).scans


@query("a1_hash_table", on_store(
    "SELECT item_id, item_version, root_id, first_scan_id, last_scan_id, file_hash, hash_state FROM hashes"))
def a1_hashes(spark, sf):
    h = feeds.activity_store(spark, sf).hashes
    return h.withColumn("file_hash", F.lower(F.hex("file_hash")))


@query("a2_file_listing", """
SELECT '/lang=' || lang AS folder, count(*) > 0 AS has_files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size
FROM documents GROUP BY lang""")
def a2(spark, sf):
    """Documents written out as text files by language, listed again with folder sizes."""
    at = scratch_path(spark, "listing")
    feeds.table(spark, sf, "documents").select("text", "lang").write.partitionBy("lang").text(at)
    tree = files.list_tree(spark, at, 1, 1)
    folders = tree.where("item_type = 1")
    per = tree.where("item_type = 0").groupBy(F.regexp_replace("item_path", "/[^/]+$", "").alias("item_path")).agg(
        F.count(F.lit(1)).alias("n"))
    return folders.join(per, "item_path").select(
        F.substr("item_path", F.lit(len(at) + 1)).alias("folder"), (F.col("n") > 0).alias("has_files"), "size")


@query("a2_walked_tree", """
SELECT '/lang=' || lang AS folder, true AS has_files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size,
  true AS has_hidden FROM documents GROUP BY lang""")
def a2_walked(spark, sf):
    """The same folders walked level by level; the writer's hidden checksum files are listed too."""
    at = scratch_path(spark, "walking")
    feeds.table(spark, sf, "documents").select("text", "lang").write.partitionBy("lang").text(at)
    root = tables.qualified_path(spark, at)
    tree = walk.walk_tree(spark, at, 1, 1)
    below = tree.where("item_type = 0").withColumns({
        "folder": F.substr(P.parent_path(F.col("item_path")), F.lit(len(root) + 1)),
        "hidden": P.path_name(F.col("item_path")).rlike("^[._]")})
    folders = tree.where("item_type = 1").select(F.substr("item_path", F.lit(len(root) + 1)).alias("folder"))
    return below.groupBy("folder").agg(
        F.bool_or(~F.col("hidden")).alias("has_files"), F.sum(F.when(~F.col("hidden"), F.col("size"))).alias("size"),
        F.bool_or("hidden").alias("has_hidden")).join(folders, "folder")


@query("a3_content_hash", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def a3(spark, sf):
    return feeds.table(spark, sf, "pages").select("page_id", content_hash(F.col("html")).alias("file_hash"))


@query("a3_file_hashes")
def a3_files(spark, sf):
    at = scratch_path(spark, "hashing")
    feeds.table(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(at)
    return files.hash_files(spark, at).select(
        F.substr("item_path", F.lit(len(at) + 1)).alias("item_path"), "file_hash")


@query("a3_hashes_of_sorted_files", """
SELECT '/block=' || block AS folder, sha256(string_agg(text || chr(10), '' ORDER BY text)) AS file_hash
FROM (SELECT doc_id // 1000 AS block, coalesce(text, '') AS text FROM documents) GROUP BY block""")
def a3_sorted(spark, sf):
    """Documents in files of a thousand ids each, lines sorted, hashed as files."""
    at = scratch_path(spark, "sorted")
    feeds.table(spark, sf, "documents").select(
        F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 1000).alias("block")
    ).repartition("block").sortWithinPartitions("block", "text").write.partitionBy("block").text(at)
    path = F.substr("item_path", F.lit(len(tables.qualified_path(spark, at)) + 1))
    return files.hash_files(spark, at).select(P.parent_path(path).alias("folder"), "file_hash")


@query("a4_snapshots_from_events", """
SELECT event_type AS root, user_id AS key, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS period,
  count(*) AS size, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def a4(spark, sf):
    events = feeds.table(spark, sf, "events")
    return snapshots_from_events(
        events, F.col("event_type"), F.col("user_id"), day_number(F.col("ts")), size=F.count(F.lit(1)),
        cents=F.sum(F.round(F.col("value") * 100).cast("long")))


@query("a5_versioned_sink", on_store("""
SELECT 2 AS version, root_id, count(*) AS versions, (SELECT count(*) FROM hashes h WHERE h.root_id = v.root_id) AS hashes
FROM versions v WHERE is_deleted = false GROUP BY root_id"""))
def a5(spark, sf):
    """Publish the store, then a second version without deletions, and read the newest back."""
    st, at = feeds.activity_store(spark, sf), scratch_path(spark, "sink")
    tables.write_state(st, at, 1)
    tables.write_state(st.with_(versions=st.versions.where(~F.col("is_deleted"))), at, 2)
    new = tables.read_state(spark, at)
    version = tables.published_versions(spark, at)[-1]
    return new.versions.groupBy("root_id").agg(F.count(F.lit(1)).alias("versions")).join(
        new.hashes.groupBy("root_id").agg(F.count(F.lit(1)).alias("hashes")), "root_id", "left"
    ).withColumn("version", F.lit(version))


@query("a5_optimistic_commits", on_store("""
SELECT root_id, count(*) FILTER (root_id > 2 OR NOT is_deleted) AS versions,
  (SELECT count(*) FROM hashes h WHERE h.root_id = v.root_id) AS hashes, 3 AS version, 1 AS refused
FROM versions v GROUP BY root_id"""))
def a5_commits(spark, sf):
    """Three writers that read version 1: two touch different roots, the third is refused."""
    st, at = feeds.activity_store(spark, sf), scratch_path(spark, "commits")
    roots = [r[0] for r in st.roots.select("root_id").collect()]
    first = commits.commit(spark, at, st, [*roots, None], 0)
    seen = commits.read(spark, at, first)
    fewer = seen.with_(versions=seen.versions.where(~F.col("is_deleted")))
    commits.commit(spark, at, fewer, [1], first)
    commits.commit(spark, at, fewer, [2], first)
    refused = 0
    try:
        commits.commit(spark, at, seen, [2], first)
    except commits.CommitConflict:
        refused = 1
    new = commits.read(spark, at)
    return new.versions.groupBy("root_id").agg(F.count(F.lit(1)).alias("versions")).join(
        new.hashes.groupBy("root_id").agg(F.count(F.lit(1)).alias("hashes")), "root_id", "left"
    ).withColumns({"version": F.lit(commits.versions(spark, at)[-1]), "refused": F.lit(refused)})
