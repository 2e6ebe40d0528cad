"""Display formats: typed values to text, applied only where a report asks for them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.schemas import ENUMS

DASH = "-"
# Date patterns and size units.
DATE_PATTERNS = {"short": "yyyy-MM-dd", "full": "yyyy-MM-dd HH:mm:ss"}
DECIMAL_UNITS = ("B", "KB", "MB", "GB", "TB")
BINARY_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def or_dash(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(DASH))


def format_date(epoch: Column, style: str = "short") -> Column:
    if style == "timestamp":
        return or_dash(epoch)
    return or_dash(F.date_format(F.timestamp_seconds(epoch), DATE_PATTERNS[style]))


def format_bool(flag: Column, style: str = "short") -> Column:
    yes, no = ("T", "F") if style == "short" else ("True", "False")
    return or_dash(F.when(flag, yes).when(~flag, no))


def format_enum(code: Column, kind: str, style: str = "short", null: str = DASH) -> Column:
    at = 0 if style == "short" else 1
    pairs = [(F.lit(k), F.lit(v[at])) for k, v in ENUMS[kind].items()]
    labels = F.create_map(*itertools.chain.from_iterable(pairs))
    return F.coalesce(F.element_at(labels, code.cast("int")), F.lit(null))


def format_hash(value: Column) -> Column:
    return or_dash(F.lower(F.hex(value)))


def _fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, without thousands marks."""
    return F.translate(F.format_number(value.cast("double"), digits), ",", "")


def _fixed_up(value: Column, digits: int) -> Column:
    """As ``_fixed``, but an exact tie goes up instead of to the even digit."""
    grid = 2.0 ** (digits + 1)
    tie = F.pmod(value * grid, F.lit(2.0)) == 1.0
    return _fixed(value + F.when(tie, 10.0 ** -(digits + 1)).otherwise(0.0), digits)


def format_real(value: Column) -> Column:
    return or_dash(_fixed(value, 2))


def _scaled(size: Column, base: int, units: tuple[str, ...], digits: int) -> Column:
    out = F.when(size < base, F.concat(_fixed(size, digits), F.lit(f" {units[0]}")))
    for power in range(1, len(units)):
        text = F.concat(
            _fixed_up(size.cast("double") / float(base**power), digits), F.lit(f" {units[power]}"))
        last = power == len(units) - 1
        out = out.otherwise(text) if last else out.when(size < base ** (power + 1), text)
    return out


def _plain_bytes(size: Column) -> Column:
    return F.concat(size.cast("string"), F.lit(" B"))


def format_size(size: Column) -> Column:
    """Decimal and binary unit together; plain bytes below 1000."""
    both = F.concat(_scaled(size, 1000, DECIMAL_UNITS, 1), F.lit(" ("),
                    _scaled(size, 1024, BINARY_UNITS, 2), F.lit(")"))
    return F.when(size.isNull(), "N/A").when(size < 1000, _plain_bytes(size)).otherwise(both)


def format_size_compact(size: Column) -> Column:
    return F.when(size.isNull(), "\u2014").when(size < 1000, _plain_bytes(size)).otherwise(
        _scaled(size, 1000, DECIMAL_UNITS, 1))


def format_elapsed(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%ds", seconds)).otherwise(
        F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60))


def hex_to_binary(text: Column) -> Column:
    return F.unhex(text)


def binary_to_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def json_long(text: Column, field: str) -> Column:
    return F.get_json_object(text, f"$.{field}").try_cast("long")


def task_state_json(scan_id: Column, high_water_mark: Column) -> Column:
    """Null where neither is known; the mark defaults to 0, an unknown scan is left out.  Both are whole numbers."""
    scan = F.concat(F.lit('"scan_id":'), scan_id.cast("string"), F.lit(","))
    mark = F.coalesce(high_water_mark, F.lit(0)).cast("string")
    body = F.concat(F.lit("{"), F.coalesce(scan, F.lit("")), F.lit('"high_water_mark":'), mark, F.lit("}"))
    return F.when(scan_id.isNotNull() | high_water_mark.isNotNull(), body)
