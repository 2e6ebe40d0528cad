"""The five query domains: their joined relations, column registries, grouping, order and paging."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.paths import natural_key
from tempora.operators.asof import with_is_current
from tempora.schemas import SCAN_COUNTERS, State

ID, INT, DATE, BOOL, TEXT, PATH, HASH, ENUM = "id", "int", "date", "bool", "text", "path", "hash", "enum"
SUMMABLE = (INT,)
ORDERABLE = (INT, DATE, ID)


@dataclass(frozen=True)
class Col:
    """A domain column: its type class, and whether it belongs to the default selection."""

    kind: str
    default: bool = True
    source: str | None = None


@dataclass(frozen=True)
class Domain:
    name: str
    columns: dict[str, Col]
    relation: Callable[[State], DataFrame]

    def check(self, name: str) -> Col:
        if name not in self.columns:
            raise ValueError(f"no column {name!r} in domain {self.name}")
        return self.columns[name]

    def read(self, state: State) -> DataFrame:
        """The whole relation; Catalyst prunes what a query does not use."""
        df = self.relation(state)
        return df.select(*[F.col(c.source or n).alias(n) for n, c in self.columns.items()])

    def names(self, *wanted: str) -> list[str]:
        """Expand "default" and "all"; order and repeats are kept; nothing means default."""
        out: list[str] = []
        for w in wanted or ("default",):
            if w == "all":
                out += list(self.columns)
            elif w == "default":
                out += [n for n, c in self.columns.items() if c.default]
            else:
                self.check(w)
                out.append(w)
        return out


def _cols(spec: str) -> dict[str, Col]:
    """``name:kind`` entries; a trailing ``-`` keeps a column out of the default selection."""
    out = {}
    for entry in spec.split():
        name, kind = entry.rstrip("-").split(":")
        kind, _, source = kind.partition("=")
        out[name] = Col(kind, not entry.endswith("-"), source or None)
    return out


_VISIBLE_COUNTERS = {"file_count", "folder_count", "total_size", "add_count", "modify_count", "delete_count"}

ROOTS = Domain("roots", _cols("root_id:id root_path:path"), lambda s: s.roots)
SCANS = Domain(
    "scans",
    _cols("scan_id:id root_id:id schedule_id:id started_at:date ended_at:date was_restarted:bool "
          "scan_state:enum=state is_hash:bool hash_all:bool- is_val:bool "
          + " ".join(f"{c}:int{'' if c in _VISIBLE_COUNTERS else '-'}" for c in SCAN_COUNTERS)
          + " error:text-"),
    lambda s: s.scans,
)
ITEMS = Domain(
    "items",
    _cols("item_id:id root_id:id item_path:path item_name:path file_extension:text item_type:enum "
          "has_validator:bool- do_not_validate:bool-"),
    lambda s: s.items,
)
VERSIONS = Domain(
    "versions",
    _cols("item_version:id item_id:id root_id:id item_path:path item_name:path- file_extension:text- "
          "item_type:enum first_scan_id:id last_scan_id:id is_added:bool- is_deleted:bool "
          "is_current:bool- access:enum- mod_date:date size:int add_count:int- modify_count:int- "
          "delete_count:int- unchanged_count:int- val_scan_id:id- val_state:enum- val_error:text- "
          "val_reviewed_at:date- hash_reviewed_at:date-"),
    lambda s: with_is_current(s.versions).join(
        s.items.select("item_id", "item_path", "item_name", "file_extension", "item_type"), "item_id"),
)
HASHES = Domain(
    "hashes",
    _cols("item_id:id item_version:id item_path:path item_name:path- first_scan_id:id "
          "last_scan_id:id file_hash:hash hash_state:enum"),
    lambda s: s.hashes.join(s.versions.select("item_id", "item_version"), ["item_id", "item_version"])
    .join(s.items.select("item_id", "item_path", "item_name"), "item_id"),
)
DOMAINS = {d.name: d for d in (ROOTS, SCANS, ITEMS, VERSIONS, HASHES)}


def show(df: DataFrame, domain: Domain, *names: str) -> DataFrame:
    """Column selection: explicit names, "default" or "all"."""
    return df.select(*domain.names(*names))


# ---- grouping ---------------------------------------------------------------------------------

_FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate_column(domain: Domain, call: str) -> Column:
    """``count(*)``, ``count(c)``, ``sum(c)``, ``avg(c)``, ``min(c)``, ``max(c)`` with type rules."""
    fn, _, rest = call.partition("(")
    arg = rest.rstrip(")")
    if fn not in _FUNCTIONS:
        raise ValueError(f"unknown aggregate {call!r}")
    if arg == "*":
        if fn != "count":
            raise ValueError(f"{fn}(*) has no meaning")
        return F.count(F.lit(1))
    kind = domain.check(arg).kind
    if fn in ("sum", "avg") and kind not in SUMMABLE:
        raise ValueError(f"{fn} needs an integer column, {arg} is {kind}")
    if fn in ("min", "max") and kind not in ORDERABLE:
        raise ValueError(f"{fn} needs an integer, date or id column, {arg} is {kind}")
    return _FUNCTIONS[fn](arg)


def group(
    df: DataFrame,
    domain: Domain,
    by: Sequence[str],
    order: Sequence[tuple[str, str]] = (),
    **aggregates: str,
) -> DataFrame:
    """Group by domain columns; ``aggregates`` maps output names to calls like ``sum(size)``.

    ``order`` may name group columns, outputs or further aggregate calls, which are then computed
    for the sort and dropped.  Without ``by`` it is a global aggregate.
    """
    for b in by:
        domain.check(b)
    hidden: dict[str, str] = {}
    keys = []
    for name, direction in order:
        if name in by or name in aggregates:
            keys.append((name, direction))
        elif "(" in name:
            hidden[f"_o{len(hidden)}"] = name
            keys.append((f"_o{len(hidden) - 1}", direction))
        else:
            raise ValueError(f"{name!r} is neither grouped nor aggregated")
    calls = [aggregate_column(domain, c).alias(n) for n, c in {**aggregates, **hidden}.items()]
    out = df.groupBy(*by).agg(*calls) if by else df.agg(*calls)
    if keys:
        out = out.orderBy(*[_sorted(F.col(n), d) for n, d in keys])
    return out.drop(*hidden)


# ---- order and paging -------------------------------------------------------------------------


def _sorted(c: Column, direction: str) -> Column:
    """Nulls come first ascending and last descending."""
    if direction.lower() in ("asc", "ascending"):
        return c.asc_nulls_first()
    if direction.lower() in ("desc", "descending"):
        return c.desc_nulls_last()
    raise ValueError(f"unknown direction {direction!r}")


def order_by(df: DataFrame, domain: Domain, *keys: str | tuple[str, str]) -> DataFrame:
    """Multi-key sort; paths compare in natural order."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    names = [n for n, _ in pairs]
    if len(set(names)) < len(names):
        raise ValueError("a column is ordered twice")
    cols = []
    for name, direction in pairs:
        kind = domain.check(name).kind
        cols.append(_sorted(natural_key(F.col(name)) if kind == PATH else F.col(name), direction))
    return df.orderBy(*cols)


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def page_override(df: DataFrame, page_limit: int, page_offset: int,
                  limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page inside the user's own limit and offset."""
    room = page_limit if limit is None else max(0, min(limit - page_offset, page_limit))
    return page(df, room, (offset or 0) + page_offset)


def count_result(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows (groups, when grouped) inside the limit and offset, as a one-row DataFrame."""
    return page(df, limit, offset).agg(F.count(F.lit(1)).alias("count"))
