"""Incremental history: a stream of finished scans folded into the stored history, exactly once.

A scan is announced (a row in the scans stream) after its observations are completely written.  Every
micro-batch is applied in one pass, however many scans it announces, and becomes version
``batch_id`` of the store.  The store is log-structured per root:

* ``runs/<table>/v=<n>-<level>/root_id=<r>`` holds a run of rows of one root: ``items`` (identities) and
  ``closed`` (finished versions) and ``scans`` get one more run with each batch that announces the root,
  ``open`` (the newest version of every item) is replaced by it;
* ``manifest/v=<n>`` names the runs of every root that make up version n.

A batch reads and writes the announced roots only; for all others the manifest goes on naming the
files they have.  ``FANOUT`` runs of one level of a root are merged into one of the next level in the
batch that completes them, so a root has at most ``FANOUT`` - 1 runs for each power of ``FANOUT`` in its
number of batches, and a row is rewritten once a level.

A marker published last makes version n visible.  A batch that is run again after a failure reads
version n-1, writes the same rows to the same folders and publishes the same marker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators.history import extend_history, new_items
from tempora.operators.tree import apply_folder_changes, folder_changes, own_flags
from tempora.plans.sizing import broadcast_if_small, write_and_read
from tempora.schemas import DIRECTORY, FOLDER_COUNTERS, ITEMS, META, ROOTS, SCANS, VERSIONS
from tempora.sources.tables import list_folder, publish, published_versions, remove

CORE = ["root_id", "item_id", "item_version", "first_scan_id", "last_scan_id", "is_added", "is_deleted",
        "access", "mod_date", "size", *FOLDER_COUNTERS]
BARE = T.StructType([VERSIONS[c] for c in CORE])
NATURAL = ["root_id", "item_path", "item_type"]


TABLES = {"items": ITEMS, "closed": BARE, "open": BARE, "scans": SCANS}
FANOUT = 4
MANIFEST = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("root_id", T.LongType()), T.StructField("run", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("top", T.LongType())])


@dataclass(frozen=True)
class HistoryStore:
    """The growing history under one folder of the shared file system."""

    spark: SparkSession
    base: str

    def published(self, before: int | None = None) -> list[int]:
        return [v for v in published_versions(self.spark, self.base) if before is None or v < before]

    def manifest(self, before: int | None = None) -> DataFrame:
        """The runs of the newest version: one row for each run of a root."""
        known = self.published(before)
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/v={known[-1]}")

    def read_runs(self, table: str, runs: list[tuple[str, int]]) -> DataFrame:
        """The rows of (run, root) pairs."""
        if not runs:
            return self.spark.createDataFrame([], TABLES[table])
        at = f"{self.base}/runs/{table}"
        found = self.spark.read.schema(TABLES[table]).option("basePath", at).parquet(*[f"{at}/{run}/root_id={root}" for run, root in runs])
        return found.select(*TABLES[table].fieldNames())

    def _read(self, table: str, before: int | None = None, roots: list[int] | None = None) -> DataFrame:
        named = self.manifest(before).where(F.col("table") == table)
        if roots is not None:
            named = named.where(F.col("root_id").isin(roots))
        return self.read_runs(table, [(r["run"], r["root_id"]) for r in named.collect()])

    def items(self, before: int | None = None, roots: list[int] | None = None) -> DataFrame:
        return self._read("items", before, roots)

    def scans(self, before: int | None = None, roots: list[int] | None = None) -> DataFrame:
        return self._read("scans", before, roots)

    def open(self, before: int | None = None, roots: list[int] | None = None) -> DataFrame:
        return self._read("open", before, roots)

    def closed(self, before: int | None = None, roots: list[int] | None = None) -> DataFrame:
        return self._read("closed", before, roots)

    def versions(self, roots: list[int] | None = None) -> DataFrame:
        return self.closed(roots=roots).unionByName(self.open(roots=roots))

    def write_run(self, table: str, df: DataFrame, version: int, level: int = 0) -> list[tuple]:
        """Write rows as one run for each of their roots; their manifest rows."""
        run = f"v={version}-{level}"
        at = f"{self.base}/runs/{table}/{run}"
        rows = df.select(*TABLES[table].fieldNames())
        rows.hint("rebalance", "root_id").write.mode("overwrite").partitionBy("root_id").parquet(at)
        read = self.spark.read.schema(TABLES[table]).parquet(at)
        top = F.max("item_id") if "item_id" in TABLES[table].fieldNames() else F.lit(0).cast("long")
        return [(table, r["root_id"], run, level, r["n"], r["top"]) for r in
                read.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).collect()]

    def compact(self, table: str, runs: list[tuple], version: int, fanout: int = FANOUT) -> list[tuple]:
        """Merge ``fanout`` runs of one level of a root into one of the next, all roots of a level at once."""
        level = 0
        while runs and level <= max(r[3] for r in runs):
            here: dict[int, list[tuple]] = {}
            for r in runs:
                if r[3] == level:
                    here.setdefault(r[1], []).append(r)
            full = [r for of_root in here.values() if len(of_root) >= fanout for r in of_root]
            if full:
                merged = self.write_run(table, self.read_runs(table, [(r[2], r[1]) for r in full]), version, level + 1)
                runs = [r for r in runs if r not in full] + merged
            level += 1
        return runs

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the runs that none of the newest ``keep`` versions names (readers of those go on), and the
        manifests and markers of older versions; returns what was deleted."""
        old = self.published()[:-keep]
        if not old:
            return []
        used = {(r["table"], r["run"], r["root_id"]) for v in self.published()[-keep:]
                for r in self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/v={v}").collect()}
        gone = []
        for table in TABLES:
            for run in list_folder(self.spark, f"{self.base}/runs/{table}"):
                if int(run[2:].split("-")[0]) > self.published()[-1]:
                    continue  # being written
                for part in list_folder(self.spark, f"{self.base}/runs/{table}/{run}"):
                    if part.startswith("root_id=") and (table, run, int(part[8:])) not in used:
                        gone.append(f"runs/{table}/{run}/{part}")
        gone = [f"published/{v}" for v in old] + [f"manifest/v={v}" for v in old] + gone
        for path in gone:  # markers first: no reader finds a version that is half gone
            remove(self.spark, f"{self.base}/{path}")
        return gone


def continue_folders(rows: DataFrame, current: DataFrame, paths: DataFrame, scans: DataFrame,
                     new_scans: DataFrame, span: int | None = None) -> DataFrame:
    """Folder counters for continued histories; file rows pass through."""
    typed = rows.join(paths, ["root_id", "item_id"])
    fresh = typed.join(new_scans.select(F.col("scan_id").alias("first_scan_id")), "first_scan_id", "left_semi")
    changes = folder_changes(own_flags(fresh), paths)
    is_dir = F.col("item_type") == DIRECTORY
    was = current.where(~F.col("is_deleted") & F.col("add_count").isNotNull()).select(
        "root_id", "item_id", "first_scan_id",
        F.col("add_count").alias("adds"), F.col("modify_count").alias("mods"), F.col("delete_count").alias("dels"),
        (F.col("add_count") + F.col("modify_count") + F.col("unchanged_count")).alias("alive_seed"))
    folders = typed.where(is_dir).join(
        was.drop("adds", "mods", "dels"), ["root_id", "item_id", "first_scan_id"], "left")
    known = was.join(paths.select("root_id", "item_id", F.col("item_path").alias("folder_path")),
                     ["root_id", "item_id"]).select(
        "root_id", F.col("first_scan_id").alias("scan_id"), "folder_path", "adds", "mods", "dels")
    offset = folders.groupBy("root_id", "item_id").agg(F.min("item_version").alias("_from"))
    done = apply_folder_changes(folders, changes.unionByName(known), scans, span)
    done = done.join(offset, ["root_id", "item_id"]).withColumn(
        "item_version", F.col("item_version") + F.col("_from") - 1)
    files = typed.where(~is_dir).withColumns({c: F.lit(None).cast("long") for c in FOLDER_COUNTERS})
    return files.select(*CORE).unionByName(done.select(*CORE))


def apply_scans(store: HistoryStore, version: int, announced: DataFrame, observations: DataFrame,
                roots: DataFrame, span: int | None = None) -> None:
    """Fold the announced scans into the store as the given version.

    ``observations``: root_id, scan_id, item_path, item_type, access, mod_date, size of all scans;
    only those of the announced scans are read when the table is partitioned by scan.
    """
    spark, at = store.spark, store.base
    announced.select(*SCANS.fieldNames()).write.mode("overwrite").parquet(f"{at}/scans/v={version}")
    new_scans = spark.read.schema(SCANS).parquet(f"{at}/scans/v={version}")
    touched_roots = [r["root_id"] for r in new_scans.select("root_id").distinct().collect()]  # as many as a batch announces
    scans = store.scans(version, touched_roots).unionByName(new_scans)
    new_ids = broadcast_if_small(new_scans.select("scan_id"))
    lo, hi = new_scans.agg(F.min("scan_id"), F.max("scan_id")).first()
    due = observations.where(F.col("scan_id").between(F.lit(lo), F.lit(hi)))  # folders outside are not opened
    seen = due.select(*NATURAL, "scan_id", *META).join(new_ids, "scan_id", "left_semi")

    before = store.manifest(version)
    known = store.items(version, touched_roots)
    step = f"{at}/step/v={version}"  # what is read several times is computed once
    unknown = write_and_read(
        seen.select(*NATURAL).distinct().join(known, NATURAL, "left_anti"), f"{step}/unknown")
    top = before.agg(F.max("top")).first()[0] or 0
    runs = {"items": store.write_run("items", new_items(unknown, top), version)}
    items = known.unionByName(store.read_runs("items", [(r[2], r[1]) for r in runs["items"]]))

    current = store.open(version, touched_roots)
    named = seen.join(items.select("item_id", *NATURAL), NATURAL)
    rows = write_and_read(extend_history(current, named, scans, span=span), f"{step}/rows")
    paths = items.select("item_id", "root_id", "item_path", "item_type", "parent_path").join(roots, "root_id")
    whole = continue_folders(rows, current, paths, scans, new_scans, span)
    touched = rows.select("root_id", "item_id").distinct()
    untouched = current.join(touched, ["root_id", "item_id"], "left_anti")
    returned = current.where(F.col("is_deleted")).join(touched, ["root_id", "item_id"], "left_semi")
    newest = F.max("item_version").over(Window.partitionBy("root_id", "item_id"))
    done = write_and_read(whole.withColumn("_open", F.col("item_version") == newest), f"{step}/done", ["_open"])
    runs["closed"] = store.write_run("closed", done.where(~F.col("_open")).select(*CORE).unionByName(returned.select(*CORE)), version)
    runs["open"] = store.write_run("open", done.where("_open").select(*CORE).unionByName(untouched.select(*CORE)), version)
    runs["scans"] = store.write_run("scans", new_scans, version)

    held = [tuple(r) for r in before.where(F.col("root_id").isin(touched_roots) & (F.col("table") != "open")).select(*MANIFEST.fieldNames()).collect()]
    entries = runs["open"]
    for table in ("items", "closed", "scans"):
        entries = entries + store.compact(table, [r for r in held if r[0] == table] + runs[table], version)
    others = before.where(~F.col("root_id").isin(touched_roots))
    others.unionByName(spark.createDataFrame(entries, MANIFEST)).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest/v={version}")
    publish(spark, at, version)


def maintain_history(
    spark: SparkSession, announcements: str, read_observations: Callable[[SparkSession], DataFrame],
    roots: str, base: str, checkpoint: str, files_per_batch: int = 1, span: int | None = None,
):
    """Start the streaming job over a folder of announced scans; processes what is there and stops."""
    stream = (spark.readStream.schema(SCANS).option("maxFilesPerTrigger", files_per_batch)
              .parquet(announcements))

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        apply_scans(HistoryStore(session, base), batch_id, batch, read_observations(session),
                    session.read.schema(ROOTS).parquet(roots), span)

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
