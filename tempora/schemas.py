"""Table schemas and the fixed enum codes of the snapshot-history data model."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Enum codes, with their short and full labels.
ITEM_TYPE = {0: ("F", "File"), 1: ("D", "Directory"), 2: ("S", "Symlink"), 3: ("U", "Unknown")}
SCAN_STATE = {
    1: ("S", "Scanning"),
    2: ("W", "Sweeping"),
    3: ("AF", "Analyzing Files"),
    7: ("AS", "Analyzing Scan"),
    4: ("C", "Completed"),
    5: ("P", "Stopped"),
    6: ("E", "Error"),
}
VAL_STATE = {0: ("U", "Unknown"), 1: ("V", "Valid"), 2: ("I", "Invalid"), 3: ("N", "No Validator")}
HASH_STATE = {0: ("U", "Unknown"), 1: ("B", "Baseline"), 2: ("S", "Suspect")}
ACCESS = {0: ("N", "No Error"), 1: ("M", "Meta Error"), 2: ("R", "Read Error")}
ENUMS = {
    "item_type": ITEM_TYPE,
    "scan_state": SCAN_STATE,
    "val_state": VAL_STATE,
    "hash_state": HASH_STATE,
    "access": ACCESS,
}
FILE, DIRECTORY = 0, 1
COMPLETED, STOPPED, ERRORED = 4, 5, 6
VALID, INVALID = 1, 2
BASELINE, SUSPECT = 1, 2
ACCESS_OK, META_ERROR, READ_ERROR = 0, 1, 2
VALIDATED_EXTENSIONS = ("flac", "jpg", "jpeg", "png", "gif", "tiff", "bmp", "pdf")

SCAN_COUNTERS = (
    "file_count", "folder_count", "total_size", "new_hash_suspect_count", "new_val_invalid_count",
    "add_count", "modify_count", "delete_count", "val_unknown_count", "val_valid_count",
    "val_invalid_count", "val_no_validator_count", "hash_unknown_count", "hash_baseline_count",
    "hash_suspect_count",
)
FOLDER_COUNTERS = ("add_count", "modify_count", "delete_count", "unchanged_count")
META = ("access", "mod_date", "size")


def _schema(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "s": T.StringType(), "b": T.BooleanType(), "x": T.BinaryType(),
             "i": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


ROOTS = _schema("root_id:l root_path:s")
SCANS = _schema(
    "scan_id:l root_id:l schedule_id:l started_at:l ended_at:l was_restarted:b state:i is_hash:b "
    "hash_all:b is_val:b " + " ".join(f"{c}:l" for c in SCAN_COUNTERS) + " error:s"
)
ITEMS = _schema(
    "item_id:l root_id:l item_path:s item_name:s parent_path:s file_extension:s item_type:i "
    "has_validator:b do_not_validate:b"
)
VERSIONS = _schema(
    "item_id:l item_version:l root_id:l first_scan_id:l last_scan_id:l is_added:b is_deleted:b "
    "access:i mod_date:l size:l add_count:l modify_count:l delete_count:l unchanged_count:l "
    "val_scan_id:l val_state:i val_error:s val_reviewed_at:l hash_reviewed_at:l"
)
HASHES = _schema(
    "item_id:l item_version:l root_id:l first_scan_id:l last_scan_id:l file_hash:x hash_state:i"
)
SCHEDULES = _schema(
    "schedule_id:l root_id:l enabled:b schedule_name:s schedule_type:i time_of_day:s "
    "days_of_week:s day_of_month:i interval_value:l interval_unit:i hash_mode:i is_val:b "
    "created_at:l updated_at:l deleted_at:l"
)
TASKS = _schema(
    "task_id:l task_type:i status:i root_id:l schedule_id:l run_at:l source:i task_settings:s "
    "task_state:s created_at:l started_at:l completed_at:l"
)
TABLES = {
    "roots": ROOTS, "scans": SCANS, "items": ITEMS, "versions": VERSIONS, "hashes": HASHES,
    "schedules": SCHEDULES, "tasks": TASKS,
}


@dataclass(frozen=True)
class State:
    """One immutable version of the whole store: a DataFrame per table."""

    roots: DataFrame
    scans: DataFrame
    items: DataFrame
    versions: DataFrame
    hashes: DataFrame
    schedules: DataFrame | None = None
    tasks: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> "State":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES if getattr(self, n) is not None}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a DataFrame onto a table's schema; absent columns become typed nulls."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[table]
    ])
