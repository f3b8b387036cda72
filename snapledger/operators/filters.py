"""Conditions from nested AND/OR specifications."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.naming import quoted
from snapledger.functions.types import literal

COMPARISONS = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt,
    "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def condition(spec: dict, columns: list[str] | None = None) -> Column:
    """Column for ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}`` or one test.

    A test is ``{"column": c, "op": o, "value": v}`` with ``= <> < <= > >= in between like contains
    is_null is_not_null``. Values are literals, never text that is parsed. A name among ``columns`` means
    that column, dots and all; any other may lead into a nested one.
    """
    if "and" in spec or "or" in spec:
        key = "and" if "and" in spec else "or"
        parts = [condition(part, columns) for part in spec[key]]
        if not parts:
            # No criteria restrict nothing; no alternatives allow nothing.
            return F.lit(key == "and")
        return functools.reduce(operator.and_ if key == "and" else operator.or_, parts)
    if "not" in spec:
        return ~condition(spec["not"], columns)
    name = spec["column"]
    return _test(F.col(quoted(name) if name in (columns or ()) else name), spec["op"].lower(), spec.get("value"))


def _test(column: Column, op: str, value) -> Column:
    if op in COMPARISONS:
        return COMPARISONS[op](column, literal(value))
    if op == "in":
        return column.isin([literal(item) for item in value])
    if op == "between":
        low, high = value
        return column.between(literal(low), literal(high))
    if op == "like":
        return column.like(value)
    if op == "contains":
        return column.contains(value)
    if op == "is_null":
        return column.isNull()
    if op == "is_not_null":
        return column.isNotNull()
    raise ValueError(f"unknown filter operator: {op}")


def filter_rows(df: DataFrame, spec: dict | None) -> DataFrame:
    return df.where(condition(spec, df.columns)) if spec else df
