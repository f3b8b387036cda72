"""Forms a viewer shows rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.text import display_text
from snapledger.sources.dataset import shown_limit

# The columns a viewer takes as identity of a row, in order of preference.
KEY_COLUMNS = ("UNIQID", "id")


def display_rows(df: DataFrame) -> DataFrame:
    """Every cell as text, NULL as the empty string."""
    return df.select(*[display_text(F.col(f"`{name}`"), kind).alias(name) for name, kind in df.dtypes])


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with typed values; NULLs are kept."""
    columns = [F.col(f"`{name}`") for name in df.columns]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json"))


def _filled(name: str, data_type: T.DataType) -> Column:
    """The value as text, NULL for what counts as absent: NULL, empty text, zero, false."""
    value = F.col(f"`{name}`")
    if isinstance(data_type, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(data_type, T.BooleanType):
        return F.when(value, F.lit("true"))
    if isinstance(data_type, T.NumericType):
        return F.when((value != 0) & ~F.isnan(value.cast("double")), value.cast("string"))
    return value.cast("string")


def row_keys(df: DataFrame, table: str, order_by: list[str], rows: int | None = None) -> DataFrame:
    """Preview with a ``row_key``: an id column's value, else ``<table>_<position from 0>``.

    Positions exist only within a preview, so the one ordering is over at most that many rows.
    """
    preview = df.orderBy(*order_by).limit(shown_limit(rows))
    types = {f.name: f.dataType for f in df.schema}
    options = [_filled(name, types[name]) for name in KEY_COLUMNS if name in types]
    position = F.row_number().over(Window.orderBy(*order_by)) - 1
    return preview.withColumn(
        "row_key", F.coalesce(*options, F.concat(F.lit(f"{table}_"), position.cast("string"))))


def default_view(df: DataFrame, view: dict | None) -> DataFrame:
    """Columns and order of a declared view: ``visible_columns, column_order, sort_by, sort_order``.

    Without a declaration the table is shown as it is.
    """
    if not view:
        return df
    visible = view.get("visible_columns") or df.columns
    order = view.get("column_order") or []
    names = [name for name in order if name in visible]
    names += [name for name in visible if name not in names]
    # Ties in the sort column are left open, as in the declaration.
    if view.get("sort_by"):
        column = F.col(view["sort_by"])
        descending = str(view.get("sort_order", "ASC")).upper() == "DESC"
        df = df.orderBy(column.desc() if descending else column.asc())
    return df.select(*names)
