"""Path, extension and text-key expressions; all plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.schemas import FILE, VALIDATED_EXTENSIONS

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def _one_line(text: Column) -> Column:
    """No line ends, of which patterns have notions of their own; such texts need no pattern to be cut."""
    out = F.lit(True)
    for end in ("\n", "\r", "\x85", "\u2028", "\u2029"):
        out = out & ~F.contains(text, F.lit(end))
    return out


def path_name(path: Column) -> Column:
    """Last component; the whole text where there is none (root, or '..')."""
    trimmed = F.regexp_replace(path, "/+$", "")
    found = F.regexp_extract(trimmed, "([^/]+)$", 1)
    name = F.when(_one_line(path) & ~F.endswith(path, F.lit("/")), F.substring_index(path, "/", -1)).otherwise(found)
    return F.when(name.isin("", ".."), path).otherwise(name)


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parent_path(path: Column) -> Column:
    """Everything before the last component; "/" where there is none.  No arrays: it runs on every observation."""
    plain = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("//")) & ~F.endswith(path, F.lit("/"))
    tidy = F.concat(F.lit("/"), F.btrim(F.regexp_replace(path, "/+", "/"), F.lit("/")))
    whole = F.when(plain, path).otherwise(tidy)
    above = F.substr(whole, F.lit(1), F.length(whole) - F.length(F.substring_index(whole, "/", -1)) - 1)
    return F.when(F.length(above) > 0, above).otherwise("/")


def short_path(path: Column) -> Column:
    """Parents abbreviated to their first character, the name kept whole."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i < last, F.substring(p, 1, 1)).otherwise(p)), "/")


def is_immediate_child(child: Column, parent: Column) -> Column:
    up = F.regexp_replace(parent, "/$", "")
    down = F.regexp_replace(child, "/$", "")
    rest = F.substr(down, F.length(up) + 1)
    return F.startswith(down, up) & (F.size(components(rest)) == 1)


def ancestor_chain(root: Column, path: Column) -> Column:
    """Folders strictly below ``root`` down to the parent of ``path``."""
    base = F.regexp_replace(root, "/$", "")
    below = components(F.substr(path, F.length(base) + 1))
    chain = F.transform(
        F.sequence(F.lit(1), F.size(below) - 1),
        lambda n: F.concat_ws("/", base, F.array_join(F.slice(below, 1, n), "/")),
    )
    return F.when(F.size(below) > 1, chain).otherwise(F.array().cast("array<string>"))


def file_extension(name: Column, item_type: Column | None = None) -> Column:
    """Lower-case text after the last dot; null for dot-files, no dot, or non-files."""
    tail = F.substring_index(name, ".", -1)
    short = F.when(F.length(name) - F.length(tail) > 1, F.lower(tail))
    found = F.rlike(name, F.lit(r"^.+\.[^.]*$"))
    ext = F.when(_one_line(name), short).when(found, F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))
    return ext if item_type is None else F.when(item_type == FILE, ext)


def has_validator(extension: Column) -> Column:
    return F.coalesce(extension.isin(*VALIDATED_EXTENSIONS), F.lit(False))


def _natural(component: Column) -> Column:
    def run(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        # the number of digits first, so that longer numbers sort behind shorter ones at any length
        return F.when(F.rlike(part, F.lit(r"^\d")), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(part)

    runs = F.transform(F.regexp_extract_all(component, F.lit(r"\d+|\D+"), F.lit(0)), run)
    return F.collate(F.array_join(runs, ""), "UNICODE_CI_AI")


def natural_key(path: Column) -> Column:
    """Sort key: component by component, case- and accent-blind, digit runs by value."""
    return F.transform(components(path), _natural)
