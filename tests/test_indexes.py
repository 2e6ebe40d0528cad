"""Gram search, nested intervals and dyadic joins against the plain forms."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from tempora.functions.filters import text_match
from tempora.operators import intervals, search
from tempora.schemas import DIRECTORY, FILE


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names(spark):
    pick = random.Random(4)
    made = [(i, i % 3, "".join(pick.choices("abAB_%é./ x", k=pick.randrange(0, 24)))) for i in range(0, 200_000, 331)]
    return spark.createDataFrame([*made, (9, 1, None), (10, 1, "日本語の名前.PDF")], "item_id long, root_id long, item_name string")


def test_gram_search_finds_what_a_scan_finds(spark, names, tmp_path):
    index = search.write_index(names, "item_name", str(tmp_path / "grams"))
    assert index.groupBy("block").count().count() > 2  # long lists are cut
    pick = random.Random(9)
    values = [r[2] for r in names.collect() if r[2]]
    needles = ["a", "AB", "é", "日本", "前.pdf", "zz", "", "%", "_", "a%b", "a_b%x", "%é"]
    for n in range(1, 21):
        of = pick.choice([v for v in values if len(v) >= n])
        at = pick.randrange(len(of) - n + 1)
        needles.append(of[at:at + n])
    for needle in needles:
        for wild in (False, True):
            got = rows(search.search(index, names, "item_name", needle, wild), "item_id")
            assert got == rows(names.where(text_match(F.col("item_name"), needle, wild)), "item_id"), (needle, wild)
    only = search.search(index, names, "item_name", "ab", root_id=2)
    assert rows(only, "item_id") == rows(names.where((F.col("root_id") == 2) & text_match(F.col("item_name"), "ab")), "item_id")


def test_candidates_read_postings_of_their_grams_only(spark, names, tmp_path):
    index = search.write_index(names, "item_name", str(tmp_path / "grams"))
    plan = plan_of(search.candidates(index, "abab", root_id=1))
    assert "PartitionFilters: [isnotnull(root_id" in plan and "In(gram, [aba,bab])" in plan and plan.count("FileScan") == 1
    assert search.write_index(names.limit(0), "item_name", str(tmp_path / "none")).count() == 0


def random_tree(spark, seed):
    pick = random.Random(seed)
    folders, items = ["/r"], [("/r", DIRECTORY)]
    for _ in range(80):
        path = pick.choice(folders) + "/" + pick.choice(["a", "a b", "a!", "B", "é", "a.", "Z", "~"]) + str(pick.randrange(6))
        if pick.random() < 0.4 and path not in folders:
            folders.append(path)
            items.append((path, DIRECTORY))
        else:
            items.append((path + "f", FILE))
    items = sorted(set(items))
    made = [(i, 1, p, t) for i, (p, t) in enumerate(items)] + [(1000 + i, 2, p, t) for i, (p, t) in enumerate(items[:9])]
    return spark.createDataFrame(made, "item_id long, root_id long, item_path string, item_type int")


@pytest.mark.parametrize("span", [None, 3, intervals.SPAN])
def test_totals_equal_those_over_ancestors(spark, span):
    items = random_tree(spark, 5)
    values = items.where("item_id % 7 != 0").select("root_id", "item_id", (F.col("item_id") * 3 + 1).alias("size"), (F.col("item_id") % 2).alias("scan"))
    values = values.unionByName(values.limit(5))
    got = intervals.totals(items, values, {"n": F.lit(1), "size": F.col("size")}, span=span)
    held = values.join(items, ["root_id", "item_id"])
    below = items.where(F.col("item_type") == DIRECTORY).alias("f").join(
        held.alias("v"), F.expr("v.root_id = f.root_id and startswith(v.item_path, concat(f.item_path, '/'))"), "left")
    want = below.groupBy("f.root_id", "f.item_id").agg(F.count("v.item_id").alias("n"), F.coalesce(F.sum("v.size"), F.lit(0)).alias("size"))
    assert rows(got, "root_id", "item_id", "n", "size") == rows(want, "root_id", "item_id", "n", "size")
    per = intervals.totals(items, values, {"size": F.col("size")}, by=("scan",), span=span).where("size > 0")
    want = below.where("v.item_id is not null").groupBy("f.item_id", "f.root_id", "v.scan").agg(F.sum("v.size").alias("size"))
    assert rows(per, "item_id", "root_id", "scan", "size") == rows(want, "item_id", "root_id", "scan", "size")


def test_below_is_a_pushed_range(spark, tmp_path):
    items = random_tree(spark, 6)
    laid = intervals.write_intervals(items, str(tmp_path / "laid"))
    for folder in [r.item_path for r in items.where((F.col("item_type") == DIRECTORY) & (F.col("root_id") == 1)).collect()]:
        want = items.where((F.col("root_id") == 1) & F.col("item_path").startswith(folder + "/"))
        assert rows(intervals.below(laid, 1, folder), "item_id") == rows(want, "item_id")
    assert "GreaterThan(lo," in plan_of(intervals.below(laid, 1, "/r")) and intervals.below(laid, 1, "/none").count() == 0
    assert intervals.intervals(items.limit(0)).count() == 0


def test_dyadic_join_equals_containment(spark):
    pick = random.Random(3)
    made = []
    for i in range(300):
        first = pick.randrange(4000)
        made.append((i, i % 2, first, first + pick.choice([0, 1, 2, 7, 8, 100, 3999, pick.randrange(3000)])))
    versions = spark.createDataFrame([*made, made[0]], "item_id long, root_id long, first_scan_id long, last_scan_id long")
    scans = spark.createDataFrame([(s % 2, s) for s in {pick.randrange(8000) for _ in range(200)}] + [(0, 0)], "root_id long, scan_id long")
    got = intervals.containing_many(versions, scans)
    want = versions.join(scans, "root_id").where("scan_id between first_scan_id and last_scan_id")
    assert rows(got, "item_id", "root_id", "scan_id") == rows(want, "item_id", "root_id", "scan_id")
    # the join has keys only: nothing meets that is not in the result
    joined = [line for line in plan_of(got).splitlines() if "Join" in line]
    assert joined and all("scan_id" not in line.split("Inner")[-1] for line in joined)
    assert intervals.containing_many(versions.limit(0), scans).count() == 0
