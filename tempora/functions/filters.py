"""Row predicates over the domains, each a boolean Column.

Values inside one filter are OR-ed; ``all_of`` ANDs several filters.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.paths import ascii_lower
from tempora.schemas import ENUMS, INVALID, VALID

NULL, NOT_NULL = "null", "not null"


def any_of(preds: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, preds, F.lit(False))


def all_of(*preds: Column) -> Column:
    return functools.reduce(operator.and_, preds, F.lit(True))


def _null_form(c: Column, value) -> Column | None:
    if isinstance(value, str) and value.lower() in (NULL, "-"):
        return c.isNull()
    if isinstance(value, str) and value.lower() == NOT_NULL:
        return c.isNotNull()
    return None


def id_filter(c: Column, *values) -> Column:
    """Ids, inclusive ``(lo, hi)`` ranges, "null" and "not null"."""
    points = [v for v in values if isinstance(v, int)]
    preds = [c.isin(*points)] if points else []
    for v in values:
        if isinstance(v, tuple):
            preds.append(c.between(*v))
        elif not isinstance(v, int):
            pred = _null_form(c, v)
            if pred is None:
                raise ValueError(f"not an id value: {v!r}")
            preds.append(pred)
    return any_of(preds)


int_filter = id_filter


def _instant(wall: datetime, zone: ZoneInfo, latest: bool) -> int:
    """Epoch second of a wall time; ambiguous times take the wanted side, gaps are errors."""
    aware = wall.replace(tzinfo=zone, fold=1 if latest else 0)
    back = aware.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None)
    if back != wall:
        raise ValueError(f"local time {wall} does not exist in {zone.key}")
    return int(aware.timestamp())


def date_bounds(value, zone: str = "UTC") -> tuple[int, int]:
    """Inclusive epoch bounds of a day, a second, an epoch, or a (from, to) pair of them."""
    tz = ZoneInfo(zone)

    def edge(v, end: bool) -> int:
        if isinstance(v, int):
            return v
        if len(v) == 10:
            day = datetime.strptime(v, "%Y-%m-%d")
            return _instant(day + timedelta(days=1, seconds=-1) if end else day, tz, end)
        return _instant(datetime.strptime(v, "%Y-%m-%d %H:%M:%S"), tz, end)

    lo, hi = value if isinstance(value, tuple) else (value, value)
    bounds = edge(lo, False), edge(hi, True)
    if bounds[0] > bounds[1]:
        raise ValueError(f"start is after end: {value!r}")
    return bounds


def date_filter(c: Column, *values, zone: str = "UTC") -> Column:
    preds = []
    for v in values:
        pred = _null_form(c, v)
        preds.append(pred if pred is not None else c.between(*date_bounds(v, zone)))
    return any_of(preds)


def bool_filter(c: Column, *values) -> Column:
    preds = []
    for v in values:
        pred = _null_form(c, v)
        preds.append(pred if pred is not None else c == F.lit(bool(v)))
    return any_of(preds)


def text_match(c: Column, value: str, wildcards: bool = False) -> Column:
    """ASCII-case-blind substring; ``wildcards`` lets % and _ act as in SQL LIKE."""
    folded = "".join(ch.lower() if ch.isascii() else ch for ch in value)
    if not wildcards:
        return ascii_lower(c).contains(folded)
    pattern = "%" + folded.replace("\x1b", "\x1b\x1b") + "%"
    return F.like(ascii_lower(c), F.lit(pattern), F.lit("\x1b"))


def string_filter(c: Column, *values: str, wildcards: bool = False) -> Column:
    preds = []
    for v in values:
        pred = _null_form(c, v)
        preds.append(pred if pred is not None else text_match(c, v, wildcards))
    return any_of(preds)


def path_filter(c: Column, *values: str, wildcards: bool = False) -> Column:
    """As ``string_filter`` but without the null forms."""
    return any_of([text_match(c, v, wildcards) for v in values])


def hash_filter(c: Column, *values: str) -> Column:
    preds = []
    for v in values:
        pred = _null_form(c, v)
        preds.append(pred if pred is not None else F.hex(c).contains(v.upper()))
    return any_of(preds)


def enum_code(kind: str, token: str) -> int:
    """Code of a label: short, full, or full without blanks, whatever the case."""
    want = token.strip().lower()
    for code, (short, full) in ENUMS[kind].items():
        if want in (short.lower(), full.lower(), full.lower().replace(" ", "")):
            return code
    if kind == "hash_state" and want in ("v", "valid"):
        return 1
    raise ValueError(f"not a {kind}: {token!r}")


def enum_filter(c: Column, kind: str, *values: str) -> Column:
    preds, codes = [], []
    for v in values:
        pred = _null_form(c, v)
        if pred is not None:
            preds.append(pred)
        else:
            codes.append(enum_code(kind, v))
    return any_of(preds + ([c.isin(*codes)] if codes else []))


def val_state_filter(val_state: Column, has_validator: Column, *values: str) -> Column:
    """Unknown and no-validator are not stored: they follow from the item's validator flag."""
    forms = {
        0: has_validator & val_state.isNull(),
        1: val_state == VALID,
        2: val_state == INVALID,
        3: ~has_validator,
    }
    preds = []
    for v in values:
        pred = _null_form(val_state, v)
        preds.append(pred if pred is not None else forms[enum_code("val_state", v)])
    return any_of(preds)


def compare_filter(c: Column, op: str, value: int) -> Column:
    if op not in (">", "<"):
        raise ValueError("only > and < compare integers")
    return c > value if op == ">" else c < value
