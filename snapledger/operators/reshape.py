"""Column blocks to rows, derived columns, columns by role."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("id_fields", "principal_fields", "metadata_fields")


def columns_to_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a block whose columns are arrays; the other columns repeat on each row.

    A shorter array is filled up with NULL.
    """
    others = [name for name in df.columns if name not in columns]
    return df.select(*others, F.inline(F.arrays_zip(*[F.col(name) for name in columns])))


def is_ragged(columns: list[str]) -> Column:
    """Whether the arrays of a block differ in length."""
    first, *rest = [F.size(F.col(name)) for name in columns]
    return functools.reduce(operator.or_, [size != first for size in rest], F.lit(False))


def derived_columns(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Add columns declared as SQL expressions over the stored ones; earlier ones may be used."""
    for name, expression in declared.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def select_by_role(df: DataFrame, mapping: dict | None, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """The columns a mapping gives those roles, in order of role; all of them without a mapping."""
    if not mapping:
        return df
    wanted = [name for role in roles for name in mapping.get(role, []) if name in df.columns]
    return df.select(*dict.fromkeys(wanted))
