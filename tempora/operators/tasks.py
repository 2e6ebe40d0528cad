"""Task and schedule reports, and reshaping an old work queue into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.formats import json_long, task_state_json
from tempora.schemas import State

# Task states and types.
PENDING, RUNNING, DONE, STOPPED, FAILED = 0, 1, 2, 3, 4
SCAN_TASK = 0


def task_history(state: State, task_type: int | None = None, root_id: int | None = None) -> DataFrame:
    """Finished tasks with root, schedule and, through their JSON state, the scan they made."""
    rows = state.tasks.where(F.col("status").isin(DONE, STOPPED, FAILED))
    if task_type is not None:
        rows = rows.where(F.col("task_type") == task_type)
    if root_id is not None:
        rows = rows.where(F.col("root_id") == root_id)
    scans = state.scans.select(
        F.col("scan_id").alias("_made"), "scan_id", "add_count", "modify_count", "delete_count",
        "was_restarted", "new_val_invalid_count", "new_hash_suspect_count")
    rows = rows.withColumn("_made", F.when(
        F.col("task_type") == SCAN_TASK, json_long(F.col("task_state"), "scan_id")))
    return (
        rows.join(state.roots, "root_id", "left")
        .join(state.schedules.select("schedule_id", "schedule_name"), "schedule_id", "left")
        .join(scans, "_made", "left")
        .select("task_id", "task_type", "root_id", "root_path", "schedule_name", "source", "status",
                "started_at", "completed_at", "scan_id", "add_count", "modify_count", "delete_count",
                "was_restarted", "new_val_invalid_count", "new_hash_suspect_count")
    )


def newest_finished_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("completed_at"), F.desc("task_id"))


def upcoming_tasks(state: State, now: int, paused: bool = False) -> DataFrame:
    """Pending tasks (with the running ones while paused), in the order they will be taken."""
    wanted = (PENDING, RUNNING) if paused else (PENDING,)
    return (
        state.tasks.where(F.col("status").isin(*wanted))
        .join(state.roots, "root_id", "left")
        .join(state.schedules.select("schedule_id", "schedule_name"), "schedule_id", "left")
        .select("task_id", "task_type", "root_id", "root_path", "schedule_id", "schedule_name", "run_at",
                "source", "status", (F.col("run_at") <= now).alias("is_ready"))
        .orderBy(F.desc("status"), "source", "run_at", "task_id")
    )


def schedule_list(state: State) -> DataFrame:
    """Live schedules with their root and the time of each pending task, by name."""
    pending = state.tasks.where(F.col("status") == PENDING).select(
        "schedule_id", F.col("run_at").alias("next_scan_time"))
    return (
        state.schedules.where(F.col("deleted_at").isNull())
        .join(state.roots, "root_id")
        .join(pending, "schedule_id", "left")
        .select("schedule_id", "root_id", "root_path", "enabled", "schedule_name", "next_scan_time")
        .orderBy(F.lower("schedule_name"), "schedule_id")
    )


def queue_to_tasks(queue: DataFrame) -> DataFrame:
    """Old queue rows as tasks: activity as status, missing run time as 0, progress as JSON."""
    active = F.col("is_active")
    return queue.select(
        F.col("queue_id").alias("task_id"), F.lit(SCAN_TASK).alias("task_type"),
        F.when(active, RUNNING).otherwise(PENDING).alias("status"), "root_id", "schedule_id",
        F.coalesce("next_run_time", F.lit(0)).alias("run_at"), "source",
        task_state_json(F.col("scan_id"), F.col("analysis_hwm")).alias("task_state"),
        "created_at", F.when(active, F.col("created_at")).alias("started_at"),
        F.lit(None).cast("long").alias("completed_at"),
    )
