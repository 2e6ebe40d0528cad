"""Domains, hashes, checks, review, scans, tasks, tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, rows
from tempora.operators import asof, browse, checks, domains, hashes, review, scans, scanstats, tasks
from tempora.plans.sizing import scratch_path
from tempora.sources import feeds, files, tables


def test_domain_rules(store):
    v = domains.VERSIONS
    assert domains.show(v.read(store), v, "size", "item_id", "size").columns == ["size", "item_id", "size"]
    assert len(domains.SCANS.names("all")) == 26 and len(domains.SCANS.names()) == 15
    assert len(v.names("all")) == 24
    for bad in ("sum(*)", "avg(is_deleted)", "min(item_path)", "sum(item_id)", "median(size)", "count(nothing)"):
        with pytest.raises(ValueError):
            domains.aggregate_column(v, bad)
    with pytest.raises(ValueError):
        domains.group(v.read(store), v, ["item_type"], [("size", "asc")], n="count(*)")
    with pytest.raises(ValueError):
        domains.order_by(v.read(store), v, "size", ("size", "desc"))
    with pytest.raises(ValueError):
        domains.order_by(v.read(store), v, ("size", "sideways"))
    domains.order_by(v.read(store), v, ("size", "descending"))


def test_paging(spark):
    df = spark.range(100).orderBy("id")
    assert [r.id for r in domains.page(df, 3, 10).collect()] == [10, 11, 12]
    assert [r.id for r in domains.page_override(df, 10, 5, limit=8, offset=2).collect()] == [7, 8, 9]
    assert domains.page_override(df, 10, 20, limit=8).collect() == []
    assert domains.count_result(df, 40, 90).first()["count"] == 10


@pytest.mark.parametrize("text", ["", "hello world", "test"])
def test_content_hash(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(hashes.content_hash(F.col("t"))).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()


def observed(spark, values):
    return spark.createDataFrame([(1, 1, 1, n + 1, None if v is None else v.encode()) for n, v in enumerate(values)],
                                 "item_id long, item_version long, root_id long, scan_id long, file_hash binary")


@pytest.mark.parametrize("span", [None, 2])
def test_drift_reverting_hash_is_suspect_again(spark, span):
    out = hashes.drift_history(observed(spark, ["a", "a", "b", None, "b", "a"]), span)
    assert rows(out, "first_scan_id", "last_scan_id", "hash_state") == [(1, 2, 1), (3, 5, 2), (6, 6, 2)]


def test_merged_scans_equal_drift_history(spark):
    values = ["a", "b", "b", "a", "a", "c"]
    seen = observed(spark, values)
    table = hashes.drift_history(seen.where("scan_id = 1"))
    for scan in range(2, len(values) + 1):
        merged = hashes.merge_hashes(table, seen.where(F.col("scan_id") == scan), scan)
        table = spark.createDataFrame(merged.collect(), merged.schema)
    cols = ["first_scan_id", "last_scan_id", "file_hash", "hash_state"]
    assert rows(table, *cols) == rows(hashes.drift_history(seen), *cols)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("hello world")
    (tmp_path / "a" / "b" / "two.txt").write_text("test")
    tree = {r.item_path.removeprefix(str(tmp_path)): (r.item_type, r.size) for r in
            files.list_tree(spark, str(tmp_path), 1, 1).collect()}
    assert tree == {"/a/one.txt": (0, 11), "/a/b/two.txt": (0, 4), "/a": (1, 15), "/a/b": (1, 4)}
    got = {r.item_path.rsplit("/", 1)[1]: r.file_hash for r in files.hash_files(spark, str(tmp_path)).collect()}
    assert got["two.txt"] == hashlib.sha256(b"test").hexdigest()
    plan = files.list_files(spark, str(tmp_path), 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_content_rules(spark):
    df = spark.createDataFrame([("pdf", b"%PDF-1.4"), ("png", b"GIF89a"), ("jpg", b"\xff\xd8\xff\xe0"), ("txt", b"x")],
                               "ext string, content binary")
    got = df.select("ext", checks.has_magic(F.col("content"), F.col("ext")).alias("ok"))
    assert dict(rows(got)) == {"pdf": True, "png": False, "jpg": True, "txt": None}


def test_validation_is_written_once(spark):
    cols = "item_id long, item_version long, val_scan_id long, val_state int, val_error string"
    versions = spark.createDataFrame([(1, 1, None, None, None), (2, 1, 5, 1, None), (3, 1, None, None, None)], cols)
    results = spark.createDataFrame([(1, 1, 2, "bad"), (2, 1, 2, "late"), (3, 1, 3, "no validator")],
                                    "item_id long, item_version long, val_state int, val_error string")
    out = checks.merge_validation(versions, results, 9)
    assert rows(out) == [(1, 1, 9, 2, "bad"), (2, 1, 5, 1, None), (3, 1, None, None, None)]


def test_review_marks(store):
    f = review.IssueFilter("all", "unreviewed")
    before = review.count_issue_items(store, f).first()[0]
    versions, affected = review.review_by_filter(store, f, 77)
    assert before > 0 and affected.first()[0] >= before
    done = store.with_(versions=versions)
    assert review.count_issue_items(done, f).first()[0] == 0
    again, nothing = review.review(done, store.items.select("item_id"), 88)
    marks = {r[0] for r in again.where("val_reviewed_at is not null").select("val_reviewed_at").distinct().collect()}
    assert nothing.first()[0] == 0 and 88 not in marks


def test_scan_lookup(store):
    latest = scans.resolve_scan(store.scans, 2).first()[0]
    assert latest == store.scans.where("root_id = 2 and state = 4").agg(F.max("scan_id")).first()[0]
    assert scans.resolve_scan(store.scans, 2, "2023-01-01").first()[0] is None
    assert scans.scan_or_latest(store.scans, 103).count() == 1
    assert [r.started_at for r in scans.scan_history(store.scans, 1).collect()] == sorted(
        (r.started_at for r in store.scans.where("root_id = 1 and state = 4").collect()), reverse=True)


def test_local_days_follow_the_zone(spark):
    at = [(1, 1, 4, 1704067200 - 1800), (1, 2, 4, 1704067200 + 1800)]  # around 2024-01-01 00:00 UTC
    df = spark.createDataFrame(at, "root_id long, scan_id long, state int, started_at long")
    assert rows(scans.scan_dates_in_month(df, 1, 2024, 1)) == [("2024-01-01",)]
    assert rows(scans.scan_dates_in_month(df, 1, 2024, 1, "Europe/Berlin")) == [("2024-01-01",)]
    assert rows(scans.scan_dates_in_month(df, 1, 2023, 12, "America/New_York")) == [("2023-12-31",)]


def test_recount_reproduces_statistics(store):
    stored = store.scans.where("state = 4").select("scan_id", *scanstats.LEVELS)
    out = scanstats.scan_levels(store.versions, store.items, store.hashes, store.scans, span=4)
    assert rows(out, "scan_id", *scanstats.LEVELS) == rows(stored)
    population = ["scan_id", "file_count", "folder_count", "total_size", "hash_suspect_count"]
    again = scanstats.scan_levels(store.versions, store.items, store.hashes, store.scans, recount=True)
    assert rows(again, *population) == rows(stored, *population)


def test_unknown_item_has_false_flags(spark, store):
    ask = spark.createDataFrame([(-5,)], "item_id long")
    got = browse.integrity_state_at(store, ask, 1203).first()
    assert (got.has_validator, got.do_not_validate, got.hash_state, got.val_state) == (False, False, None, None)


def test_snapshots_at_equals_single_snapshots(store):
    wanted = store.scans.where("scan_id in (203, 1203, 3003)").select("root_id", "scan_id")
    many = asof.snapshots_at(store.versions, wanted, store.scans)
    for scan in (203, 1203, 3003):
        one = asof.snapshot_at(store.versions.where("root_id = 3"), scan)
        cols = ["item_id", "item_version", "is_deleted"]
        assert rows(many.where(F.col("scan_id") == scan), *cols) == rows(one, *cols)


def test_unpublished_versions_are_invisible(spark, store):
    at = scratch_path(spark, "sink")
    tables.write_state(store, at, 1)
    tables.write_table(store.versions.limit(1), "versions", at, 2)  # a writer that died half-way
    assert tables.published_versions(spark, at) == [1]
    assert tables.read_state(spark, at).versions.count() == store.versions.count()
    with pytest.raises(FileNotFoundError):
        tables.read_state(spark, at, 2)


def test_task_order(store):
    got = tasks.upcoming_tasks(store, 0, paused=True).collect()
    key = [(-r.status, r.source, r.run_at, r.task_id) for r in got]
    assert key == sorted(key)
    assert {r.status for r in tasks.upcoming_tasks(store, 0).collect()} <= {0}


def test_pushdown_and_pruning(store):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    one = plan(store.versions.where("root_id = 3 and last_scan_id = 3003").select("item_id"))
    assert "PartitionFilters: [isnotnull(root_id" in one and "EqualTo(last_scan_id,3003)" in one
    assert "val_error" not in one
    assert "BroadcastNestedLoopJoin" not in plan(asof.snapshot_at(store.versions, 1203))


def test_history_needs_one_shuffle_after_the_snapshots(spark):
    from tempora.operators.history import build_history
    obs = spark.createDataFrame([(1, 10, 1, 0, 0, 1)],
                                "root_id long, scan_id long, item_id long, access int, mod_date long, size long")
    scan_table = spark.createDataFrame([(1, 10, 4)], "root_id long, scan_id long, state int")
    plan = build_history(obs, scan_table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(root_id#") <= 2  # the items, and the tiny calendar
    assert "SinglePartition" not in plan and SMALL and feeds


def test_trend_bounds_apply_only_when_given(spark, store):
    from tempora.operators import scans as S

    late = store.scans.withColumn("started_at", F.lit(5_680_281_600).cast("long"))  # in 2150
    root = store.scans.where("state = 4").first().root_id
    n = S.trend(late, root).count()
    assert n > 0 and S.trend(late, root, first_day="2024-01-01").count() == n
    assert S.trend(late, root, last_day="2024-01-01").count() == 0


def test_search_page_and_count_agree(spark, store):
    from tempora.operators import browse as B

    scan = store.scans.where("state = 4").orderBy("scan_id").collect()[-1]
    found = B.search_at(store, scan.root_id, "u", scan.scan_id).collect()
    assert B.count_matches(store, scan.root_id, "u", scan.scan_id).first()[0] == len(found)
    first, second = (B.search_page(store, scan.root_id, "u", scan.scan_id, 3, o).collect() for o in (0, 3))
    assert len(first) == min(3, len(found)) and not {r.item_id for r in first} & {r.item_id for r in second}


def test_one_root_prunes_versions_and_hashes(spark, store):
    from tempora.operators import browse as B

    scan = store.scans.where("state = 4").orderBy("scan_id").first()
    df = B.search_at(store, scan.root_id, "u", scan.scan_id)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(root_id") >= 3, plan


def test_a_review_of_one_root_reads_and_returns_that_root(store):
    everything = review.IssueFilter("all", "all", show_deleted=True)
    root = review.issue_versions(store, everything).groupBy("root_id").count().orderBy(F.desc("count")).first()[0]
    f = review.IssueFilter("all", "unreviewed", root_id=root)
    whole, n = review.review_by_filter(store, f, 77)
    part, m = review.review_by_filter(store, f, 77, whole=False)
    assert n.first()[0] == m.first()[0] > 0
    assert rows(part) == rows(whole.where(F.col("root_id") == root))
    assert rows(whole.where(F.col("root_id") != root)) == rows(store.versions.where(F.col("root_id") != root))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(root_id"), plan


def test_state_of_few_items_aggregates_their_hashes_only(spark, store):
    ids = [r.item_id for r in store.items.where("root_id = 1").orderBy("item_id").limit(3).collect()]
    ask = spark.createDataFrame([(i,) for i in ids], "item_id long")
    df = browse.integrity_state_at(store, ask, 1203, 1)
    run = df._jdf.queryExecution()
    scans_of_root = run.executedPlan().toString().count("PartitionFilters: [isnotnull(root_id")
    assert run.optimizedPlan().toString().count("LeftSemi") == 2 and scans_of_root == 3
    assert len(ids) == 3 and rows(df) == rows(browse.integrity_state_at(store, ask, 1203))
