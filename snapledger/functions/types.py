"""Type names, declared types and the ladder that types text columns."""

from __future__ import annotations

import datetime
import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type name -> Spark type.
DECLARED_TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int",
    "BIGINT": "bigint", "FLOAT": "float", "REAL": "float", "DOUBLE": "double",
    "TEXT": "string", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "BLOB": "binary",
}
# Spark type -> the name a catalogue listing shows.
SHOWN_TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "binary": "BLOB",
}


def spark_type(declared: str) -> str:
    """Spark's type for a declared one; the length of a text type is not part of it."""
    name = re.sub(r"^((?:N|BP)?(?:VAR)?CHAR|TEXT|STRING)\s*(\(\s*\d+\s*\))?$", "VARCHAR", declared.strip().upper())
    if name in DECLARED_TYPES:
        return DECLARED_TYPES[name]
    if name.startswith(("DECIMAL", "NUMERIC")):
        return name.lower().replace("numeric", "decimal")
    raise ValueError(f"unknown declared type: {declared}")


def shown_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return shown_type(data_type.elementType) + "[]"
    if isinstance(data_type, T.StructType):
        fields = ", ".join(f"{f.name} {shown_type(f.dataType)}" for f in data_type)
        return f"STRUCT({fields})"
    if isinstance(data_type, T.MapType):
        return f"MAP({shown_type(data_type.keyType)}, {shown_type(data_type.valueType)})"
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    return SHOWN_TYPES.get(data_type.simpleString(), data_type.simpleString().upper())


def literal(value) -> Column:
    """A Python value as a literal. A time without zone is a wall-clock time in any session zone."""
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


# The ladder, narrowest type first.
LADDER = ("boolean", "bigint", "double", "date", "timestamp_ntz")

# The shape a value must have: it keeps out texts that casts accept but a reader would not call such
# a value ('2020' as a date, '1d' as a number).
INTEGER_SHAPE = r"^[+-]?[0-9]+$"
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME_SHAPE = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
              r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$")


def fit_mask(value: Column) -> Column:
    """Bit i is set when the value fits rung i of the ladder; NULL for NULL.

    A value takes one branch: text is told by its first character, numbers and dates by one
    regular expression each.
    """
    first = F.ascii(value)
    boolean, bigint, double, date, timestamp = (F.lit(1 << i) for i in range(len(LADDER)))
    none = F.lit(0)
    # Digits that are an identifier rather than a number stay text: with a leading zero, or too many
    # for a bigint. Beyond 15 digits a double would change them. A failing cast costs an exception,
    # so only integers long enough to be out of range are tried.
    whole = (F.when(value.rlike("^[+-]?0[0-9]"), none)
             .when(F.length(value) <= 15, bigint.bitwiseOR(double))
             .when((F.length(value) <= 18) | value.try_cast("bigint").isNotNull(), bigint).otherwise(none))
    # A date is a timestamp too, so columns that mix both become timestamps.
    time = (F.when(value.try_cast("timestamp_ntz").isNull(), none)
            .when(F.length(value) == 10, date.bitwiseOR(timestamp)).otherwise(timestamp))
    digit = first.between(ord("0"), ord("9"))
    numeric = digit | first.isin(*map(ord, "+-."))
    return (F.when(value.isNull(), F.lit(None).cast("int"))
            .when(numeric & value.rlike(INTEGER_SHAPE), whole)
            .when(numeric & value.rlike(NUMBER_SHAPE), double)
            .when(digit & value.rlike(TIME_SHAPE), time)
            .when(first.isin(*map(ord, "tTfF")) & F.lower(value).isin("true", "false"), boolean)
            .otherwise(none))


def text_masks(df: DataFrame, columns: list[str] | None = None) -> dict[str, int | None]:
    """Per text column the rungs that hold all of its values, as one mask; None without values.

    Per value a bit mask of the rungs it fits, per column the AND of the masks: one int of state
    per column in each task, and one row per column back to the driver. Columns are turned to rows
    first, so that the compiled expression is one, and small, however wide the table is. Masks of
    several loads are merged by AND, so no load needs to be read again for the types of all.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = [name for name in names if columns is None or name in columns]
    if not names:
        return {}
    rows = text_cells(df, names).groupBy("column_name").agg(
        F.bit_and(fit_mask(F.col("value"))).alias("mask")).collect()
    masks = {row["column_name"]: row["mask"] for row in rows}
    return {name: masks.get(name) for name in names}


def infer_text_types(df: DataFrame, columns: list[str] | None = None,
                     without_values: str | None = "string") -> dict[str, str | None]:
    """Narrowest type that holds every value of each text column, from one aggregate over all rows.

    A column without values is of the type ``without_values``.
    """
    return {name: without_values if mask is None else type_of_mask(mask) for name, mask in text_masks(df, columns).items()}


def text_cells(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"`{name}`").alias("value"))
        for name in names])))


def type_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: its values, how many fit each type, and the type that holds them all."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    masks = text_cells(df, names).select("column_name", fit_mask(F.col("value")).alias("mask"))
    counts = masks.groupBy("column_name").agg(
        F.count("mask").alias("n_values"), F.bit_and("mask").alias("mask"),
        *[F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n_{rung}")
          for i, rung in enumerate(LADDER)])
    inferred = F.lit("string")
    for i, rung in reversed(list(enumerate(LADDER))):
        inferred = F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, rung).otherwise(inferred)
    return counts.withColumn("inferred_type", inferred).drop("mask")


def type_of_mask(mask: int) -> str:
    """First rung of an AND-ed mask; text when none fits."""
    for i, type_name in enumerate(LADDER):
        if mask & (1 << i):
            return type_name
    return "string"


def type_mask(kind: str) -> int:
    """The rungs that hold whatever a column of a type may hold."""
    if kind not in LADDER:
        return 0
    # A double does not hold every bigint.
    return sum(1 << LADDER.index(rung) for rung in {kind, "timestamp_ntz" if kind == "date" else kind})


def misfits(types: dict[str, str]) -> Column:
    """Whether a row of text has a value that is not of the type named for its column."""
    found = F.lit(False)
    for name, kind in types.items():
        if kind != "string":
            mask = fit_mask(F.col(f"`{name}`"))
            found = found | (mask.bitwiseAND(F.lit(1 << LADDER.index(kind))) == 0)
    return F.coalesce(found, F.lit(False))


WIDENING = ["tinyint", "smallint", "int", "bigint", "float", "double"]


# Decimal digits that the integer types need.
INTEGER_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _digits(kind: str) -> tuple[int, int] | None:
    """Digits before and after the point of a decimal or integer type."""
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    if found:
        return int(found[1]) - int(found[2]), int(found[2])
    return (INTEGER_DIGITS[kind], 0) if kind in INTEGER_DIGITS else None


FLOATING = ("float", "double")


def wider_type(left: str, right: str) -> str:
    """Type that holds the values of both without loss, for columns whose type differs between snapshots.

    A double does not hold every bigint, so these two become text (see `common_form`). Raises where a
    decimal meets a type with which it has no lossless one in common.
    """
    if left == right:
        return left
    if "decimal" in left + right and "string" not in (left, right):
        a, b = _digits(left), _digits(right)
        whole, scale = (max(a[0], b[0]), max(a[1], b[1])) if a and b else (39, 0)
        if whole + scale > 38:
            raise ValueError(f"no type holds both {left} and {right} without loss")
        return f"decimal({whole + scale},{scale})"
    if left in WIDENING and right in WIDENING:
        floating = left in FLOATING or right in FLOATING
        if floating and "bigint" in (left, right):
            return "string"
        # A float cannot hold every int: go to double.
        return "double" if floating else WIDENING[max(WIDENING.index(left), WIDENING.index(right))]
    if "date" in (left, right) and {left, right} & {"timestamp_ntz", "timestamp"}:
        return left if right == "date" else right
    return "string"


def exact_text(value: Column, kind: str) -> Column:
    """A number as text: the same for equal numbers, whatever integer or floating type holds them."""
    if kind not in FLOATING:
        return value.cast("string")
    double = value.cast("double")
    whole = (F.rint(double) == double) & (double >= -2.0 ** 63) & (double < 2.0 ** 63)
    return F.when(whole, double.try_cast("bigint").cast("string")).otherwise(double.cast("string"))


def common_form(value: Column, own: str, kinds: set[str]) -> Column:
    """A column of one type in the type that holds all of several without loss, equal for equal values."""
    if "bigint" in kinds and kinds & set(FLOATING) and own in WIDENING:
        return exact_text(value, own)
    wide = functools.reduce(wider_type, sorted(kinds))
    return value if own == wide else value.cast(wide)
