"""Histories against a step-by-step replay written from the rules alone."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SMALL, rows
from tempora.operators import history as H
from tempora.operators.tree import with_folder_counters
from tempora.schemas import ITEMS, VERSIONS
from tempora.sources import feeds

OUT = ["item_id", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "size"]


def replay(observed, scan_ids):
    """observed: {scan: {item: size}}; one scan after another, item by item."""
    versions = {}
    for scan in scan_ids:
        seen = observed.get(scan, {})
        for item, size in seen.items():
            mine = versions.setdefault(item, [])
            cur = mine[-1] if mine else None
            if cur is None or cur["gone"]:
                mine.append({"f": scan, "l": scan, "add": True, "gone": False, "size": size})
            elif cur["size"] != size:
                mine.append({"f": scan, "l": scan, "add": False, "gone": False, "size": size})
            else:
                cur["l"] = scan
        for item, mine in versions.items():
            if item not in seen and not mine[-1]["gone"]:
                mine.append({"f": scan, "l": scan, "add": False, "gone": True, "size": mine[-1]["size"]})
    return sorted(((i, n + 1, v["f"], v["l"], v["add"], v["gone"], v["size"])
                   for i, mine in versions.items() for n, v in enumerate(mine)), key=repr)


def frames(spark, observed, scan_ids):
    data = [(1, s, i, 0, 0, size) for s, seen in observed.items() for i, size in seen.items()]
    obs = spark.createDataFrame(data, "root_id long, scan_id long, item_id long, access int, mod_date long, size long")
    scans = spark.createDataFrame([(1, s, 4) for s in scan_ids] + [(1, 5, 6)], "root_id long, scan_id long, state int")
    return obs, scans


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.integers(1, 5), st.sampled_from([None, 1, 2]), max_size=5), min_size=2, max_size=9))
def test_history_equals_replay(spark, snapshots):
    scan_ids = [10 * (n + 1) for n in range(len(snapshots))]
    observed = dict(zip(scan_ids, snapshots))
    obs, scans = frames(spark, observed, scan_ids)
    want = replay(observed, scan_ids)
    assert rows(H.build_history(obs, scans), *OUT) == want
    assert rows(H.build_history(obs, scans, span=2), *OUT) == want


def test_empty_scan_tombstones_everything(spark):
    obs, scans = frames(spark, {10: {1: 5, 2: 6}}, [10, 20, 30])
    got = rows(H.build_history(obs, scans), *OUT)
    assert got == [(1, 1, 10, 10, True, False, 5), (1, 2, 20, 20, False, True, 5),
                   (2, 1, 10, 10, True, False, 6), (2, 2, 20, 20, False, True, 6)]


def test_feed_history_equals_replay(spark, store):
    files = feeds.activity_files(spark, SMALL)
    scans = feeds.activity_scans(spark, SMALL)
    got = H.build_history(files, scans)
    for root in (1, 3):
        observed = {}
        for r in files.where(F.col("root_id") == root).collect():
            observed.setdefault(r.scan_id, {})[r.item_id] = r.size
        ids = [r.scan_id for r in scans.where(f"root_id = {root} and state = 4").orderBy("scan_id").collect()]
        assert rows(got.where(F.col("root_id") == root), *OUT) == replay(observed, ids)


def test_segmented_feed_history_and_counters(spark, store):
    obs, scans = feeds.activity_observations(spark, SMALL), feeds.activity_scans(spark, SMALL)
    plain = H.build_history(obs, scans)
    assert rows(plain, *OUT) == rows(H.build_history(obs, scans, span=4), *OUT)
    cols = [*OUT, "add_count", "modify_count", "delete_count", "unchanged_count"]
    whole = with_folder_counters(plain, store.items, store.roots, scans)
    cut = with_folder_counters(plain, store.items, store.roots, scans, span=4)
    assert rows(whole, *cols) == rows(cut, *cols)


def test_extended_history_equals_one_pass(spark):
    rnd = random.Random(3)
    scan_ids = [10 * n for n in range(1, 16)]
    observed = {s: {i: rnd.choice([1, 1, 2]) for i in range(1, 30) if rnd.random() < 0.6} for s in scan_ids}
    want = replay(observed, scan_ids)
    closed, current = [], None
    for lo, hi in ((0, 4), (4, 5), (5, 11), (11, 15)):
        obs, scans = frames(spark, {s: observed[s] for s in scan_ids[lo:hi]}, scan_ids[:hi])
        if current is None:
            current = H.build_history(obs, scans).limit(0)
        new = H.extend_history(current, obs, scans)
        old = current.join(new.select("item_id").distinct(), "item_id", "left_anti")
        dead = current.where("is_deleted").join(new.select("item_id").distinct(), "item_id", "left_semi")
        merged = spark.createDataFrame(new.collect(), new.schema)
        top = merged.groupBy("item_id").agg(F.max("item_version").alias("t"))
        marked = merged.join(top, "item_id")
        closed += rows(marked.where("item_version < t"), *OUT) + rows(dead, *OUT)
        nxt = marked.where("item_version = t").select(*new.columns).unionByName(old.select(*new.columns))
        current = spark.createDataFrame(nxt.collect(), new.schema)
    assert sorted(closed + rows(current, *OUT), key=repr) == want


def test_repeated_merge_equals_history(spark):
    paths = {1: "/r/a.pdf", 2: "/r/b.txt", 3: "/r/c", 4: "/r/d.jpg"}
    snapshots = [{1: 5, 2: 6}, {1: 5, 3: 1}, {1: 7, 2: 6, 4: 2}, {}, {1: 7, 4: 2}]
    scan_ids = [10 * (n + 1) for n in range(len(snapshots))]
    items, versions = spark.createDataFrame([], ITEMS), spark.createDataFrame([], VERSIONS)
    for scan, seen in zip(scan_ids, snapshots):
        snap = spark.createDataFrame([(1, paths[i], 0, 0, 0, s) for i, s in seen.items()],
                                     "root_id long, item_path string, item_type int, access int, mod_date long, size long")
        items, versions = H.merge_snapshot(items, versions, snap, 1, scan)
        items, versions = (spark.createDataFrame(df.collect(), sch) for df, sch in ((items, ITEMS), (versions, VERSIONS)))
    got = versions.join(items, "item_id").select("item_path", *OUT[1:])
    want = [(paths[r[0]], *r[1:]) for r in replay(dict(zip(scan_ids, snapshots)), scan_ids)]
    assert rows(got) == sorted(want, key=repr)
    ids = {r.item_path: (r.item_id, r.file_extension, r.has_validator) for r in items.collect()}
    assert ids["/r/a.pdf"] == (1, "pdf", True) and ids["/r/c"][1:] == (None, False)
    assert sorted(i for i, _, _ in ids.values()) == [1, 2, 3, 4]


def test_next_access(spark):
    df = spark.createDataFrame([
        (0, 0, False, False, 0), (0, 1, False, False, 0), (0, 2, False, False, 2), (0, 0, False, True, 1),
        (1, 2, False, False, 0), (1, 0, True, False, 2), (1, 0, True, True, 1),
    ], "t int, old int, dir boolean, meta boolean, want int")
    got = df.select(H.next_access(F.col("t"), F.col("old"), F.col("dir"), F.col("meta")).alias("got"), "want")
    assert all(r.got == r.want for r in got.collect())


def test_versions_never_overlap_and_kinds_sum_to_population(spark, store):
    from tempora.operators.asof import snapshot_at, with_change_view
    from tempora.operators.repair import invariant_report
    report = {r.check: r.violations for r in invariant_report(store).collect()}
    for rule in ("first hash is not baseline", "baseline after suspect", "version numbers with gaps",
                 "interval ends before it starts", "overlapping versions", "negative folder counters"):
        assert report[rule] == 0, rule
    scan = store.scans.where("scan_id = 1203").first()
    typed = snapshot_at(store.versions.where("root_id = 3"), 1203).join(store.items.select("item_id", "item_type"), "item_id")
    kinds = {r.change_kind: r["count"] for r in with_change_view(typed, 1203).groupBy("change_kind").count().collect()}
    assert sum(v for k, v in kinds.items() if k != "deleted") == scan.file_count + scan.folder_count
    assert kinds.get("deleted", 0) == scan.delete_count and kinds.get("added", 0) == scan.add_count


def test_versions_are_found_on_one_sort_without_a_table_of_groups(spark):
    obs = spark.createDataFrame([(1, 10, 1, 0, 0, 1)],
                                "root_id long, scan_id long, item_id long, access int, mod_date long, size long")
    scan_table = spark.createDataFrame([(1, 10, 4)], "root_id long, scan_id long, state int")
    plan = H.build_history(obs, scan_table)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [root_id#") == 2  # the items, and the tiny calendar


def test_versions_that_carry_paths_are_not_joined_with_items(spark):
    from tempora.sources import feeds

    obs = spark.createDataFrame(
        [(1, s, 102 + 100 * (s % 3), f"/r/b1/d1/u{1 + s % 3}.jpg", 0, 0, s, 3 + s) for s in (101, 201, 301, 401)]
        + [(1, s, 10**12 + 1, "/r/b1", 1, 0, s, 3 + s) for s in (101, 201, 301, 401)]
        + [(1, 201, None, "/r/b1/d1/unull", 0, 0, 5, 5)],
        "root_id long, scan_id long, item_id long, item_path string, item_type int, access int, mod_date long, size long")
    scans = spark.createDataFrame([(1, s, 4, s != 101, s == 301) for s in (101, 201, 301, 401)],
                                  "root_id long, scan_id long, state int, is_hash boolean, is_val boolean")
    roots = spark.createDataFrame([(1, "/r")], "root_id long, root_path string")
    items = feeds.items_of(obs)
    plain = with_folder_counters(H.build_history(obs, scans), items, roots, scans)
    carried = with_folder_counters(H.build_history(obs, scans, carry=feeds.PATH), items, roots, scans)
    assert rows(carried, *plain.columns) == rows(plain) and set(carried.columns) - set(plain.columns) == set(feeds.PATH)
    # files are found without the items
    cols = ["item_id", "item_version", "scan_id", "file_hash"]
    assert rows(feeds.activity_hash_observations(carried, items.limit(0), scans), *cols) == rows(
        feeds.activity_hash_observations(plain, items, scans), *cols) != []
    # a version meets one row of the calendar, not each validating scan of its root
    met = feeds.activity_validation(carried, items, scans)
    assert rows(met, "item_id", "val_scan_id", "val_state") == [(202, 301, 1)]
    assert "= first_scan_id" in met._jdf.queryExecution().optimizedPlan().toString()


def test_versions_that_carry_paths_are_validated_and_marked_without_the_items(spark):
    from tempora.sources import feeds

    obs = spark.createDataFrame(
        [(1, s, 102 + 100 * u, f"/r/b1/d1/u{1 + u}.jpg", 0, 0, 7, 3 + u) for s in (101, 201, 301, 401) for u in (*range(12), 20)]
        + [(1, 201, None, "/r/b1/d1/unull.jpg", 0, 0, 5, 5)],
        "root_id long, scan_id long, item_id long, item_path string, item_type int, access int, mod_date long, size long")
    scans = spark.createDataFrame([(1, s, 4, True, s == 301) for s in (101, 201, 301, 401)],
                                  "root_id long, scan_id long, state int, is_hash boolean, is_val boolean")
    roots = spark.createDataFrame([(1, "/r")], "root_id long, root_path string")
    items = feeds.items_of(obs)
    carried = with_folder_counters(H.build_history(obs, scans, carry=feeds.PATH), items, roots, scans)
    observed = feeds.drift_history(feeds.activity_hash_observations(carried, items, scans))
    out = feeds.with_integrity(carried, observed, items.limit(0), scans)
    joined = feeds.with_integrity(carried.drop(*feeds.PATH), observed, items, scans)
    assert rows(out) == rows(joined) and out.where("val_state = 2").count() and out.where("hash_reviewed_at > 0").count()
    assert out.where("item_id is null and val_scan_id is not null").count() == 0
    # only versions whose suspects count as reviewed are exchanged for them
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "has_validator" not in plan


def test_hash_intervals_are_found_on_one_sort(spark):
    from tempora.operators.hashes import drift_history

    seen = spark.createDataFrame([(1, 1, 1, s, h) for s, h in enumerate("aabbab")] + [(1, 2, 1, 9, "a")],
                                 "item_id long, item_version long, root_id long, scan_id long, file_hash string")
    out = drift_history(seen, None)
    assert rows(out, "item_version", "first_scan_id", "last_scan_id", "file_hash", "hash_state") == [
        (1, 0, 1, "a", 1), (1, 2, 3, "b", 2), (1, 4, 4, "a", 2), (1, 5, 5, "b", 2), (2, 9, 9, "a", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [item_id#") == 1


def test_a_snapshot_is_read_from_what_the_build_wrote(spark, store):
    from catalog import h_history
    from helpers import SMALL
    from tempora.sources import feeds

    snap = h_history.before(spark, SMALL)[2]
    assert "events" not in " ".join(snap.inputFiles())
    cols = list(feeds.OBSERVED)
    assert rows(feeds.stored_observations(spark, SMALL), *cols) == rows(feeds.activity_observations(spark, SMALL), *cols)
