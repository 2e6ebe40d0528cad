"""Repair jobs against loops over a few generated items."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tempora.operators import repair

FIELDS = ("is_added", "is_deleted", "access", "mod_date", "size", "add_count", "modify_count", "delete_count",
          "unchanged_count")
SCHEMA = ("item_id long, item_version long, first_scan_id long, last_scan_id long, is_added boolean, "
          "is_deleted boolean, access int, mod_date long, size long, add_count long, modify_count long, "
          "delete_count long, unchanged_count long")
OUT = ["item_id", "first_scan_id", "last_scan_id", *FIELDS]


@pytest.fixture(scope="module")
def damaged():
    rnd = random.Random(11)
    data = []
    for item in range(40):
        scan = 0
        for n in range(rnd.randint(1, 12)):
            scan += rnd.randint(1, 2)
            counts = rnd.choice([(0, 0, 0, 3), (0, 0, 0, 2), (1, 0, 0, 2)])
            data.append((item, n + 1, scan, scan, n == 0, rnd.random() < 0.15, 0, rnd.choice([1, 1, 1, 2]),
                         rnd.choice([None, 5, 5]), *counts))
    return data


def loop(data, absorbs):
    out = []
    for item in sorted({d[0] for d in data}):
        keeper = None
        for d in [list(x) for x in data if x[0] == item]:
            if keeper is not None and absorbs(keeper, d):
                keeper[3] = d[3]
            else:
                keeper = d
                out.append(keeper)
    return sorted(((d[0], d[2], d[3], *d[4:]) for d in out), key=repr)


def same(a, b):
    return a[4:] == b[4:]


def noop(a, b):
    return same(a, b) or (not b[4] and not b[5] and b[9:12] == [0, 0, 0] and a[6:9] == b[6:9])


@pytest.mark.parametrize("span", [None, 3])
def test_collapse_identical(spark, damaged, span):
    df = spark.createDataFrame(damaged, SCHEMA)
    once = repair.collapse_identical(df, span=span)
    assert rows(once, *OUT) == loop(damaged, same)
    assert rows(repair.collapse_identical(once), *OUT) == rows(once, *OUT)


@pytest.mark.parametrize("span", [None, 3])
def test_collapse_noop_folders(spark, damaged, span):
    df = spark.createDataFrame(damaged, SCHEMA)
    out = repair.collapse_noop_folders(df, meta=("access", "mod_date", "size"), span=span)
    assert rows(out, *OUT) == loop(damaged, noop)


@pytest.mark.parametrize("span", [None, 3])
def test_overlaps(spark, span):
    rnd = random.Random(5)
    data = []
    for item in range(30):
        starts = sorted(rnd.sample(range(1, 40), 6))
        data += [(item, n + 1, s, s + rnd.randint(0, 9)) for n, s in enumerate(starts)]
    df = spark.createDataFrame(data, "item_id long, item_version long, first_scan_id long, last_scan_id long")
    want = sorted((a[:2] for a in data if any(b[0] == a[0] and b[2] < a[2] <= b[3] for b in data)), key=repr)
    assert rows(repair.overlapping(df, span), "item_id", "item_version") == want
    items = spark.createDataFrame([(i, i % 2) for i in range(30)], "item_id long, item_type int")
    fixed = repair.rechain_overlaps(df, items, span)
    assert repair.overlapping(fixed).count() == 0
    bad = {i for i, _ in want}
    expect = []
    for item in range(30):
        mine = [d for d in data if d[0] == item]
        for n, d in enumerate(mine):
            end = d[3]
            if item in bad:
                end = mine[n + 1][2] - 1 if n + 1 < len(mine) else max(m[3] for m in mine)
            expect.append((item, d[1], d[2], end))
    assert rows(fixed) == sorted(expect, key=repr)


LOG = ("item_id long, root_id long, scan_id long, change_type int, access_new int, meta_change boolean, "
       "mod_date_new long, size_new long, hash_change boolean, hash_new binary, val_change boolean, val_new int, "
       "val_error_new string")


@pytest.mark.parametrize("span", [None, 15])
def test_versions_from_changes(spark, span):
    log = spark.createDataFrame([
        (1, 1, 10, 1, None, True, 100, 5, True, b"a", None, None, None),
        (1, 1, 30, 2, None, None, None, None, None, None, True, 2, "bad"),
        (1, 1, 40, 3, None, None, None, None, None, None, None, None, None),
        (1, 1, 60, 1, 2, True, 101, 6, None, None, None, None, None),
        (2, 1, 20, 2, None, True, 100, 7, None, None, None, None, None),
    ], LOG)
    cols = ("item_id long, root_id long, last_scan long, is_deleted boolean, access int, mod_date long, size long, "
            "file_hash binary, val int, val_error string, last_hash_scan long, last_val_scan long")
    current = spark.createDataFrame([
        (1, 1, 70, False, 2, 101, 6, b"z", 1, None, 70, 70), (2, 1, 20, False, 0, 100, 7, None, 3, None, None, None),
        (3, 1, 50, True, 0, 9, 9, None, 3, None, None, None)], cols)
    scans = spark.createDataFrame([(1, s, 4) for s in range(10, 80, 10)], "root_id long, scan_id long, state int")
    out = repair.versions_from_changes(log, current, scans, span)
    got = rows(out, "item_id", "first_scan_id", "last_scan_id", "is_deleted", "access", "size", "file_hash", "val",
               "val_error", "last_hash_scan", "last_val_scan")
    assert got == sorted([
        (1, 10, 20, False, 0, 5, bytearray(b"a"), 3, None, 10, None),
        (1, 30, 30, False, 0, 5, bytearray(b"a"), 2, "bad", 10, 30),
        (1, 40, 50, True, 0, 5, bytearray(b"a"), 2, "bad", 10, 30),
        (1, 60, 70, False, 2, 6, bytearray(b"z"), 1, None, 70, 70),
        (2, 20, 20, False, 0, 7, None, 3, None, None, None),
        (3, 50, 50, True, 0, 9, None, 3, None, None, None),
    ], key=repr)


def test_same_scan_changes_fold(spark):
    log = spark.createDataFrame([
        (1, 1, 10, 0, 1, 5, None), (1, 1, 10, 1, 2, None, 9), (1, 1, 20, 0, 2, 6, None)],
        "item_id long, root_id long, scan_id long, seq int, change_type int, size_new long, val_new int")
    assert rows(repair.fold_same_scan(log)) == [(1, 1, 10, 1, 5, 9), (1, 1, 20, 2, 6, None)]


def test_deletion_repair_sees_only_overlaps(spark):
    roots = spark.createDataFrame([(1, "/r")], "root_id long, root_path string")
    items = spark.createDataFrame([(1, "/r/a", "/r", 1), (2, "/r/a/b/f", "/r/a/b", 0)],
                                  "item_id long, item_path string, parent_path string, item_type int")
    cols = "item_id long, item_version long, root_id long, first_scan_id long, last_scan_id long, is_deleted boolean"
    versions = spark.createDataFrame([
        (1, 1, 1, 1, 3, True), (1, 2, 1, 4, 6, True), (1, 3, 1, 9, 9, True), (2, 1, 1, 5, 8, False)], cols)
    wrong = repair.wrongly_deleted_folders(versions, items, roots)
    assert rows(wrong, "item_id", "item_version") == [(1, 2)]
    scans = spark.createDataFrame([(1, s, 4) for s in range(1, 10)], "root_id long, scan_id long, state int")
    assert rows(repair.affected_scans(wrong, scans), "scan_id") == [(4,), (5,), (6,)]
    assert F
