"""Snapshot dates, table names and column names as pure Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date shapes a dump name may carry, in the order they are tried. Each is the
# regular expression that finds it and the order of its parts.
LENIENT_PATTERNS = [
    (r"[0-9]{2}[_-][0-9]{2}[_-][0-9]{4}", "dmy"),
    (r"[0-9]{4}[_-][0-9]{2}[_-][0-9]{2}", "ymd"),
    (r"[0-9]{8}", "compact dmy"),
    (r"[0-9]{8}", "compact ymd"),
]
STRICT_PATTERNS = [
    (r"[0-9]{2}_[0-9]{2}_[0-9]{4}", "dmy"),
    (r"[0-9]{4}_[0-9]{2}_[0-9]{2}", "ymd"),
    (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "dmy"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "ymd"),
]
# How the parts of a hit are put in the order year, month, day.
REORDER = {
    "dmy": (r"^(..).(..).(....)$", "$3-$2-$1"),
    "ymd": (r"^(....).(..).(..)$", "$1-$2-$3"),
    "compact dmy": (r"^(..)(..)(....)$", "$3-$2-$1"),
    "compact ymd": (r"^(....)(..)(..)$", "$1-$2-$3"),
}

DATE_MODES = ("valid", "compat", "strict")
# Years a date in a name may have where digits can be read more than one way.
PLAUSIBLE_YEARS = (1900, 2100)


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _date_text(name: Column, pattern: tuple[str, str]) -> Column:
    """``yyyy-mm-dd`` text of the first hit, empty without one."""
    find, order = pattern
    return F.regexp_replace(F.regexp_extract(name, find, 0), *map(F.lit, REORDER[order]))


def _real_date(text: Column) -> Column:
    # Each text is worked out once here: no NULL tests around it that would repeat its regular
    # expressions. Year 0 is a date to Spark but to no source we load, hence the second replacement.
    return F.regexp_replace(text, F.lit("^0000-"), F.lit("-")).try_cast("date")


def date_text_compat(name: Column | str) -> Column:
    """First pattern that hits wins, and its text is not checked (``0115-24-20`` can come out)."""
    column = _as_column(name)
    return F.coalesce(*[F.nullif(_date_text(column, p), F.lit("")) for p in LENIENT_PATTERNS])


def snapshot_date(name: Column | str, mode: str = "valid",
                  override: str | None = None, default: str | None = None,
                  years: tuple[int, int] = PLAUSIBLE_YEARS) -> Column:
    """Date of a dump: ``override``, else the date in its name, else ``default``.

    ``valid``   separated or compact forms; the first one that is a real date in one of the ``years``
                (20101231 is of 2010, not of 1231).
    ``compat``  the first form that hits; NULL when that is not a real date.
    ``strict``  separated forms with equal separators; the first one that is a real date.

    There is no clock in here: a caller who wants "today" passes it as ``default``.
    """
    if mode not in DATE_MODES:
        raise ValueError(f"unknown date mode {mode!r}; use one of {DATE_MODES}")
    column = _as_column(name)
    if mode == "compat":
        text = date_text_compat(column)
        # A hit that is no date stays NULL: falling back to the default would hide a broken name.
        found = F.when(text.isNotNull(), _real_date(text)).otherwise(F.lit(default).cast("date"))
        return F.coalesce(F.lit(override).cast("date"), found) if override else found
    patterns = STRICT_PATTERNS if mode == "strict" else LENIENT_PATTERNS
    options = [_real_date(_date_text(column, pattern)) for pattern in patterns]
    if mode == "valid":
        options = [F.when(F.year(date).between(*years), date) for date in options]
    if override:
        options.insert(0, F.lit(override).cast("date"))
    if default:
        options.append(F.lit(default).cast("date"))
    return F.coalesce(*options)


def sanitize_name(name: Column | str) -> Column:
    """Identifier-safe form: other characters become ``_`` and a leading digit gets ``T_``."""
    clean = F.regexp_replace(_as_column(name), "[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("T_"), clean)).otherwise(clean)


def sanitize_text(name: str) -> str:
    """`sanitize_name` for one Python string (table and column names on the driver)."""
    clean = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    return "T_" + clean if clean[:1].isdigit() else clean


def unique_names(names: list[str]) -> list[str]:
    """Sanitised column names; names that meet (ignoring case) get ``_2``, ``_3`` ..."""
    clean = [sanitize_text(name) or "_" for name in names]
    taken = {name.lower() for name in clean}
    seen: set[str] = set()
    result = []
    for name in clean:
        candidate, number = name, 1
        while candidate.lower() in seen or (number > 1 and candidate.lower() in taken):
            number += 1
            candidate = f"{name}_{number}"
        seen.add(candidate.lower())
        result.append(candidate)
    return result


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns safely; also returns ``{new name: original}`` for those that changed."""
    names = unique_names(df.columns)
    changed = {new: old for old, new in zip(df.columns, names) if new != old}
    return df.toDF(*names), changed


def snapshot_table_name(table: Column | str, date: Column | str) -> Column:
    """``<table>_<yyyymmdd>``, the name one dated copy of a table goes by."""
    return F.concat(_as_column(table), F.lit("_"), F.date_format(_as_column(date), "yyyyMMdd"))


def quoted(name: str) -> str:
    """A column name as a reference to just that column, dots and all."""
    return "`" + name.replace("`", "``") + "`"
