"""Incremental maintenance of the history, compared with the batch history."""

from pyspark.sql import functions as F

from catalog.base import on_store, query
from tempora.plans.sizing import scratch_path
from tempora.sources import feeds
from tempora.streaming.incremental import HistoryStore, maintain_history

OBSERVED = ["root_id", "scan_id", "item_path", "item_type", "access", "mod_date", "size"]
HISTORY = ["item_path", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted", "access",
           "mod_date", "size", "add_count", "modify_count", "delete_count", "unchanged_count"]


def stream_history(spark, sf, batches=3):
    """Write the daily observations, announce their scans in a few files, and run the stream."""
    at = scratch_path(spark, "stream")
    feeds.activity_roots(spark, sf).drop("root").write.parquet(f"{at}/roots")
    feeds.activity_observations(spark, sf).select(*OBSERVED).repartition("scan_id") \
        .write.partitionBy("scan_id").parquet(f"{at}/observations")
    scans = feeds.activity_scans(spark, sf)
    last = scans.agg(F.max("scan_id")).first()[0]
    for i in range(batches):
        lo, hi = last * i // batches, last * (i + 1) // batches
        part = scans.where((F.col("scan_id") > lo) & (F.col("scan_id") <= hi))
        part.coalesce(1).write.mode("append").parquet(f"{at}/announced")  # one file per announcement

    def observations(session):
        return session.read.parquet(f"{at}/observations")

    job = maintain_history(spark, f"{at}/announced", observations, f"{at}/roots", f"{at}/store", f"{at}/checkpoint")
    job.awaitTermination()
    return HistoryStore(spark, f"{at}/store")


@query("s1_incremental_history", on_store(f"SELECT {', '.join(HISTORY)} FROM history"))
def s1(spark, sf):
    store = stream_history(spark, sf)
    return store.versions().join(store.items().select("item_id", "item_path"), "item_id").select(*HISTORY)
