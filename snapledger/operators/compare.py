"""Comparing two databases: tables, schemas, keyed rows, cells, rows without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.digest import comparable, hash_pieces, row_hashes
from snapledger.functions.naming import quoted
from snapledger.functions.types import common_form, shown_type
from snapledger.sources.dataset import Dataset
from snapledger.sources.local import local_frame
from snapledger.storage import materialized

ADDED, REMOVED, CHANGED, SAME = "added", "removed", "changed", "same"


def _both_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    left = left.withColumn("__in_left", F.lit(True))
    right = right.withColumn("__in_right", F.lit(True))
    return left.join(right, keys, "full_outer")


def _presence(changed: Column | None = None) -> Column:
    status = F.when(F.col("__in_left").isNull(), ADDED).when(F.col("__in_right").isNull(), REMOVED)
    return (status.when(changed, CHANGED) if changed is not None else status).otherwise(SAME)


def compare_tables(left: Dataset, right: Dataset, counts: bool = True) -> DataFrame:
    """Which tables are only in one database or in both, with their row counts.

    Without ``counts`` only names are compared: no table is opened, and the counts are NULL.
    """
    def counted(dataset: Dataset, side: str) -> DataFrame:
        if not counts:
            return dataset.list_tables().withColumn(f"{side}_rows", F.lit(None).cast("bigint"))
        return dataset.row_counts().withColumnRenamed("row_count", f"{side}_rows")

    return _both_sides(counted(left, "left"), counted(right, "right"), ["table_name"]).select(
        "table_name",
        F.when(F.col("__in_left").isNull(), "only_right").when(F.col("__in_right").isNull(), "only_left")
        .otherwise("both").alias("presence"), "left_rows", "right_rows")


def schema_rows(df: DataFrame) -> DataFrame:
    return local_frame(df.sparkSession, [(f.name, shown_type(f.dataType)) for f in df.schema],
                       "column_name string, column_type string")


def compare_schemas(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that were added, removed or retyped, from metadata alone."""
    old = schema_rows(left).withColumnRenamed("column_type", "left_type")
    new = schema_rows(right).withColumnRenamed("column_type", "right_type")
    retyped = F.col("left_type") != F.col("right_type")
    status = _presence(retyped)
    return _both_sides(old, new, ["column_name"]).select(
        "column_name", F.when(status == CHANGED, "retyped").otherwise(status).alias("status"),
        "left_type", "right_type")


def _common_columns(left: DataFrame, right: DataFrame, keys: list[str],
                    columns: list[str] | None) -> list[str]:
    if columns is not None:
        return columns
    there = set(right.columns)
    return [name for name in left.columns if name in there and name not in keys]


def _aligned(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the columns, those whose types differ in a form that is equal for equal values only."""
    def cut(df: DataFrame, other: DataFrame) -> DataFrame:
        columns = []
        for name in names:
            own, there = (d.schema[name].dataType.simpleString() for d in (df, other))
            columns.append(common_form(F.col(quoted(name)), own, {own, there}).alias(name))
        return df.select(*columns)

    return cut(left, right), cut(right, left)


def compare_rows(left: DataFrame, right: DataFrame, keys: list[str],
                 columns: list[str] | None = None) -> DataFrame:
    """Status of every key: added, removed, changed or same, with its rows on each side.

    Both sides are stacked and aggregated by key on signed sums of row-hash pieces: rows that
    agree cancel out, and what is shuffled is the key and eight longs instead of two whole rows.
    Map tasks sum first, so a key with very many rows arrives as one row per task. A key that is
    not unique is the same when both sides hold the same rows the same number of times.
    """
    names = _common_columns(left, right, keys, columns)
    left, right = _aligned(left, right, keys + names)

    def digested(df: DataFrame, sign: int) -> DataFrame:
        fields = [df.schema[name] for name in names]
        pieces = [(piece * sign).alias(f"__h{i}")
                  for i, piece in enumerate(hash_pieces(row_hashes(fields)))]
        return df.select(*map(quoted, keys), F.lit(int(sign < 0)).cast("bigint").alias("n_left"),
                         F.lit(int(sign > 0)).cast("bigint").alias("n_right"), *pieces)

    stacked = digested(left, -1).unionByName(digested(right, 1))
    sums = [name for name in stacked.columns if name not in keys]
    totals = stacked.groupBy(*map(quoted, keys)).agg(*[F.sum(name).alias(name) for name in sums])
    equal = F.col("n_left") == F.col("n_right")
    for name in sums:
        if name.startswith("__h"):
            equal = equal & (F.col(name) == 0)
    status = (F.when(F.col("n_left") == 0, ADDED).when(F.col("n_right") == 0, REMOVED)
              .when(equal, SAME).otherwise(CHANGED))
    return totals.select(*map(quoted, keys), status.alias("status"), "n_left", "n_right")


def compare_summary(left: DataFrame, right: DataFrame, keys: list[str],
                    columns: list[str] | None = None) -> DataFrame:
    """Number of keys per status."""
    return compare_rows(left, right, keys, columns).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_keys"))


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str],
                  columns: list[str] | None = None) -> DataFrame:
    """Changed cells ``(key, column_name, old_value, new_value, n_cells)``, values as text.

    The keys that changed are found first, on digests, and written out (so this runs a job); only
    their rows go on to be unpivoted.
    Equal cells cancel out per (key, column, value). For a key that is unique on both sides the two
    remaining values form one row; for one that is not there is no telling which cells belong
    together, so each surplus value is a row of its own with how often it is in surplus.
    """
    names = _common_columns(left, right, keys, columns)
    left, right = _aligned(left, right, keys + names)
    changed = materialized(
        compare_rows(left, right, keys, names).where(F.col("status") == CHANGED).select(
            *[F.col(quoted(key)).alias(f"__key_{i}") for i, key in enumerate(keys)],
            ((F.col("n_left") == 1) & (F.col("n_right") == 1)).alias("__unique")), "changed")

    def cells(df: DataFrame, sign: int) -> DataFrame:
        # Null-safe: a key value may be NULL like any other.
        match = F.lit(True)
        for i, key in enumerate(keys):
            match = match & df[quoted(key)].eqNullSafe(changed[f"__key_{i}"])
        hit = df.join(changed, match, "inner")
        pairs = F.array(*[F.struct(F.lit(name).alias("column_name"),
                                   _cell_text(df, name).alias("value")) for name in names])
        return hit.select(*[df[quoted(key)] for key in keys], "__unique", F.lit(sign).cast("bigint").alias("n"),
                          F.inline(pairs))

    net = (cells(left, -1).unionByName(cells(right, 1))
           .groupBy(*map(quoted, keys), "__unique", "column_name", "value").agg(F.sum("n").alias("n"))
           .where("n <> 0"))
    apart = F.when(~F.col("__unique"), F.struct("value"))
    return (net.withColumn("__apart", apart).groupBy(*map(quoted, keys), "column_name", "__apart").agg(
        F.max(F.when(F.col("n") < 0, F.col("value"))).alias("old_value"),
        F.max(F.when(F.col("n") > 0, F.col("value"))).alias("new_value"),
        F.max(F.abs("n")).alias("n_cells")).drop("__apart"))


def _cell_text(df: DataFrame, name: str) -> Column:
    field = df.schema[name]
    value = comparable(field)
    if field.dataType.typeName() in ("array", "map", "struct"):
        return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))
    return value.cast("string")


def compare_multiset(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that one side has more often than the other, without a key.

    One aggregation answers both directions; a row's surplus is a count, not that many copies.
    """
    names = columns or [name for name in left.columns if name in right.columns]
    left, right = _aligned(left, right, names)

    def counted(df: DataFrame, sign: int) -> DataFrame:
        values = [comparable(df.schema[name]).alias(name) for name in names]
        return df.select(*values, F.lit(sign).cast("bigint").alias("__n"))

    net = (counted(left, -1).unionByName(counted(right, 1)).groupBy(*map(quoted, names))
           .agg(F.sum("__n").alias("__n")).where("__n <> 0"))
    return net.select(*map(quoted, names), F.when(F.col("__n") > 0, ADDED).otherwise(REMOVED).alias("status"),
                      F.abs("__n").alias("n_copies"))
