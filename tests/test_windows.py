import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tempora.operators import hashes, repair
from tempora.plans import sizing, windows
from tempora.plans.windows import PLAIN_WINDOW_LIMIT, choose_span, with_neighbours, with_running


@pytest.fixture(scope="module")
def ordered(spark):
    rnd = random.Random(7)
    data = []
    for key in range(12):
        for at in sorted(rnd.sample(range(200), 60 if key else 150)):
            data.append((key, at, rnd.choice([None, 1, 2, 3]), rnd.randint(0, 9)))
    return spark.createDataFrame(data, "k int, at long, v int, n int")


@pytest.mark.parametrize("span", [1, 7, 64, 1000])
def test_segmented_neighbours_equal_plain(ordered, span):
    plain = with_neighbours(ordered, ["k"], "at", ["at", "v"])
    cut = with_neighbours(ordered, ["k"], "at", ["at", "v"], span)
    assert rows(plain, *plain.columns) == rows(cut, *plain.columns)


@pytest.mark.parametrize("span", [1, 7, 64, 1000])
def test_segmented_running_equals_plain(ordered, span):
    spec = dict(sums={"s": F.col("v")}, maxes={"m": F.col("n")}, lasts={"l": F.col("v")})
    plain = with_running(ordered, ["k"], "at", **spec)
    cut = with_running(ordered, ["k"], "at", span, **spec)
    assert rows(plain, *plain.columns) == rows(cut, *plain.columns)


def test_span_depends_on_the_bound():
    assert choose_span(PLAIN_WINDOW_LIMIT) is None
    assert choose_span(PLAIN_WINDOW_LIMIT + 1) > 0


@pytest.mark.parametrize("limit", [1, 10_000])
def test_number_rows_is_dense_and_ordered(spark, monkeypatch, limit):
    monkeypatch.setattr(sizing, "RANGE_ROWS", limit)
    df = spark.range(5000).select(
        F.when(F.col("id") != 17, F.col("id") * 7919 % 5003).alias("a"), F.lit('say "x", \\').alias("b"))
    out = sizing.number_rows(df, ["a", "b"], "n", 100)
    got = sorted((-1 if r.a is None else r.a, r.n) for r in out.collect())
    assert [n for _, n in got] == list(range(101, 5101))


def test_broadcast_only_when_counted_small(spark):
    df = spark.range(100)
    assert "broadcast" in sizing.broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sizing.broadcast_if_small(df, 99)._jdf.queryExecution().logical().toString().lower()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_jobs_over_histories_measure_them(spark, monkeypatch):
    rnd = random.Random(3)
    fields = ["is_deleted", "size"]
    versions = spark.createDataFrame(
        [(item, item % 2, scan, scan + rnd.randint(0, 3), rnd.random() < 0.2, rnd.choice([None, 4, 5]))
         for item in range(20) for scan in sorted(rnd.sample(range(1, 80), 25))],
        "item_id long, root_id long, first_scan_id long, last_scan_id long, is_deleted boolean, size long")
    seen = versions.where("root_id = 1").select(
        "item_id", F.lit(1).alias("item_version"), "root_id", F.col("first_scan_id").alias("scan_id"),
        F.col("size").cast("string").cast("binary").alias("file_hash"))
    jobs = [lambda **k: repair.collapse_identical(versions, fields, **k), lambda **k: repair.overlapping(versions, **k),
            lambda **k: hashes.drift_history(seen, **k)]
    plain = [rows(job(span=None)) for job in jobs]
    assert all("_seg" not in plan(job()) for job in jobs)  # short histories
    monkeypatch.setattr(windows, "PLAIN_WINDOW_LIMIT", 30)
    monkeypatch.setattr(windows, "SEGMENT_SPAN", 7)
    assert all("_seg" in plan(job()) for job in jobs)
    assert [rows(job()) for job in jobs] == plain


def test_the_longest_calendar_of_a_root_decides(spark, monkeypatch):
    monkeypatch.setattr(windows, "PLAIN_WINDOW_LIMIT", 3)
    df = spark.createDataFrame([(r, s) for r in range(5) for s in (1, 2, 3, 3)], "root_id long, at long")
    assert windows.sized(windows.MEASURE, df, "at") is None
    more = df.union(spark.createDataFrame([(2, 9)], df.schema))
    assert windows.sized(windows.MEASURE, more, "at") == windows.SEGMENT_SPAN
    assert windows.sized(5, more, "at") == 5 and windows.sized(None, more, "at") is None
    assert windows.sized(windows.MEASURE, df.limit(0), "at") is None
    # without roots the ordinals of all rows count
    assert windows.sized(windows.MEASURE, more.drop("root_id"), "at") == windows.SEGMENT_SPAN


def test_numbering_looks_for_a_bucket_once_per_row(spark):
    keys = spark.range(500).select((F.col("id") % 400).alias("a")).distinct()
    text = plan(sizing.number_rows(keys, ["a"], "n"))
    assert not [line for line in text.splitlines() if "Filter" in line and "lambda" in line]
