"""Comparable forms and fixed-width digests of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.naming import quoted

# 22 + 22 + 20 bits: sums of 2^41 such pieces still fit in a bigint.
PIECES = [(0, 22), (22, 22), (44, 20)]
SEEDS = (17, 40503)


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be grouped and compared (maps become sorted entry arrays)."""
    return _comparable(F.col(quoted(field.name)), field.dataType)


def _comparable(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.MapType):
        entries = F.map_entries(value)
        entries = F.transform(entries, lambda e: F.struct(
            _comparable(e["key"], data_type.keyType).alias("key"),
            _comparable(e["value"], data_type.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(data_type, T.ArrayType) and _has_map(data_type.elementType):
        return F.transform(value, lambda e: _comparable(e, data_type.elementType))
    if isinstance(data_type, T.StructType) and _has_map(data_type):
        inner = F.struct(*[_comparable(value[f.name], f.dataType).alias(f.name) for f in data_type])
        return F.when(value.isNotNull(), inner)
    return value


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type)
    return False


def _has_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def row_hashes(fields: list[T.StructField]) -> list[Column]:
    """Two independent 64-bit hashes of a row.

    Hashing skips NULLs, so a bit string of which columns are NULL goes in front; nested values go
    in as JSON, which spells inner NULLs out.
    """
    if not fields:
        return [F.lit(seed).cast("bigint") for seed in SEEDS]
    values, nulls = [], []
    for field in fields:
        value = comparable(field)
        nulls.append(F.when(value.isNull(), F.lit("1")).otherwise(F.lit("0")))
        if _has_nested(field.dataType):
            value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        values.append(value)
    marks = F.concat(*nulls)
    return [F.xxhash64(F.lit(seed), marks, *values) for seed in SEEDS]


def hash_pieces(hashes: list[Column]) -> list[Column]:
    """The hashes cut into pieces small enough that their sums over a huge group do not overflow."""
    pieces = []
    for value in hashes:
        for shift, width in PIECES:
            shifted = F.shiftrightunsigned(value, shift) if shift else value
            pieces.append(shifted.bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
    return pieces
