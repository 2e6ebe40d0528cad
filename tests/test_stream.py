from helpers import SMALL, rows
from catalog.s_streaming import HISTORY, stream_history
from tempora.schemas import ROOTS
from tempora.sources import feeds
from tempora.streaming.incremental import apply_scans


def test_stream_equals_batch_and_replay_changes_nothing(spark, store):
    grown = stream_history(spark, SMALL, batches=2)
    want = rows(store.versions.join(store.items.select("item_id", "item_path"), "item_id"), *HISTORY)

    def history():
        return rows(grown.versions().join(grown.items().select("item_id", "item_path"), "item_id"), *HISTORY)

    assert grown.published() == [0, 1]
    assert history() == want
    # the last batch runs again, as after a driver failure between writing and the stream's commit
    announced = spark.createDataFrame(spark.read.parquet(f"{grown.base}/scans/v=1").collect(), grown.scans().schema)
    observed = feeds.activity_observations(spark, SMALL)
    roots = spark.createDataFrame(store.roots.collect(), ROOTS)
    apply_scans(grown, 1, announced, observed, roots)
    assert grown.published() == [0, 1]
    assert history() == want


def files_of(base, table, root):
    import glob
    import os

    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{base}/runs/{table}/*/root_id={root}/*.parquet")}


def test_untouched_roots_keep_their_files(spark, store, tmp_path):
    from pyspark.sql import functions as F
    from tempora.streaming.incremental import HistoryStore

    grown = HistoryStore(spark, str(tmp_path / "store"))
    feeds.activity_observations(spark, SMALL).write.parquet(str(tmp_path / "observed"))
    observed = spark.read.parquet(str(tmp_path / "observed"))
    roots = spark.createDataFrame(store.roots.collect(), ROOTS)
    scans = spark.createDataFrame(feeds.activity_scans(spark, SMALL).collect(), grown.scans().schema)
    one, other = sorted(r[0] for r in roots.select("root_id").collect())[:2]
    half = scans.where(F.col("root_id") == one).agg(F.percentile("scan_id", 0.5)).first()[0]
    apply_scans(grown, 0, scans.where((F.col("root_id") == other) | (F.col("root_id") == one) & (F.col("scan_id") <= half)), observed, roots)
    before = {t: files_of(grown.base, t, other) for t in ("items", "closed", "open")}
    apply_scans(grown, 1, scans.where((F.col("root_id") == one) & (F.col("scan_id") > half)), observed, roots)
    assert {t: files_of(grown.base, t, other) for t in before} == before and all(before.values())
    want = rows(store.versions.where(F.col("root_id").isin(one, other)).join(store.items.select("item_id", "item_path"), "item_id"), *HISTORY)
    read = lambda: rows(grown.versions().join(grown.items().select("item_id", "item_path"), "item_id"), *HISTORY)
    assert read() == want
    # runs that only the older version names go
    gone = grown.vacuum(keep=1)
    assert any(g.startswith("runs/open/v=0") for g in gone) and read() == want and grown.published() == [1] and grown.vacuum(keep=1) == []


def test_runs_of_a_root_are_merged_by_levels(spark, tmp_path):
    from tempora.streaming.incremental import FANOUT, HistoryStore

    grown, runs = HistoryStore(spark, str(tmp_path / "store")), []
    scans = spark.createDataFrame([(i, 7 if i % 3 else 8) for i in range(2 * FANOUT * FANOUT)], "scan_id long, root_id long")
    for v in range(2 * FANOUT):
        batch = scans.where(f"scan_id div {FANOUT} = {v}")
        whole = batch.selectExpr(*(f if f in batch.columns else f"cast(null as {t}) as {f}" for f, t in ((x.name, x.dataType.simpleString()) for x in grown.scans().schema)))
        runs = grown.compact("scans", runs + grown.write_run("scans", whole, v), v)
    assert max(r[3] for r in runs) == 1 and all(sum(r[1] == root and r[3] == level for r in runs) < FANOUT for root in (7, 8) for level in (0, 1))
    assert rows(grown.read_runs("scans", [(r[2], r[1]) for r in runs]), "scan_id", "root_id") == rows(scans.where(f"scan_id < {2 * FANOUT * FANOUT}"), "scan_id", "root_id")


def test_a_batch_opens_only_the_folders_of_its_scans(spark, tmp_path):
    from tempora.streaming.incremental import HistoryStore

    grown = HistoryStore(spark, str(tmp_path / "store"))
    fields = "root_id long, item_path string, item_type int, access int, mod_date long, size long, scan_id long"
    spark.createDataFrame([(1, "/r/a", 0, 0, 1, 2, s) for s in (101, 201, 301)], fields) \
        .write.partitionBy("scan_id").parquet(str(tmp_path / "observed"))
    for f in (tmp_path / "observed" / "scan_id=301").glob("*.parquet"):
        f.write_bytes(b"still being written")
    observed = spark.read.schema(fields).parquet(str(tmp_path / "observed"))
    roots = spark.createDataFrame([(1, "/r")], ROOTS)
    whole = [f"cast(null as {x.dataType.simpleString()}) as {x.name}" for x in grown.scans().schema if x.name not in ("root_id", "scan_id", "state")]
    scans = spark.createDataFrame([(1, s, 4) for s in (101, 201)], "root_id long, scan_id long, state int").selectExpr("*", *whole)
    apply_scans(grown, 0, scans, observed, roots)
    assert rows(grown.versions(), "first_scan_id", "last_scan_id", "size") == [(101, 201, 2)]
