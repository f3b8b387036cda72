"""Checks of tables against declared schemas, keys and foreign keys.

Declarations are the dictionaries of the JSON configuration files. A missing declaration is no
error: there is then nothing to check.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.naming import quoted
from snapledger.functions.types import INTEGER_SHAPE, NUMBER_SHAPE, TIME_SHAPE, spark_type
from snapledger.operators.reshape import derived_columns
from snapledger.sources.config import Config
from snapledger.sources.dataset import Dataset
from snapledger.sources.local import local_frame
from snapledger.storage import materialized

# Levels of a cascade within a table that one job follows.
LEVELS = 4
REPORT_SCHEMA = "table_name string, rule string, column_name string, n_violations bigint"


def declared_columns(schemas: dict | None, table: str) -> dict[str, dict]:
    return ((schemas or {}).get("tables", {}).get(table, {})).get("columns", {})


def apply_schema(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """Cast the declared columns; a value that does not fit becomes NULL. Others stay as they are."""
    def declared(name: str) -> Column:
        kind = spark_type(columns[name]["type"])
        return F.when(fits(df, name, kind), F.col(f"`{name}`").try_cast(kind)).alias(name)

    return df.select(*[
        declared(name)
        if name in columns and "type" in columns[name] else F.col(f"`{name}`")
        for name in df.columns])


def declared_table(dataset: Dataset, table: str, config: Config) -> DataFrame:
    """A table as the configuration declares it: its types, and the columns derived from its own."""
    return derived_columns(apply_schema(dataset.table(table), config.columns(table)), config.derived(table))


# The texts a declared type can hold, by what Spark calls it; casts alone would take more.
TEXT_SHAPES = {"tinyint": INTEGER_SHAPE, "smallint": INTEGER_SHAPE, "int": INTEGER_SHAPE, "bigint": INTEGER_SHAPE,
               "float": NUMBER_SHAPE, "double": NUMBER_SHAPE, "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
               "timestamp_ntz": TIME_SHAPE}


def fits(df: DataFrame, name: str, kind: str) -> Column:
    """Whether a value survives being stored as a type: read as text it has its shape, else it can be cast back."""
    value, own = F.col(f"`{name}`"), dict(df.dtypes)[name]
    cast = value.try_cast(kind)
    if own == "string":
        shape = NUMBER_SHAPE if kind.startswith("decimal") else TEXT_SHAPES.get(kind)
        return cast.isNotNull() & value.rlike(shape) if shape else cast.isNotNull()
    if kind in (own, "string", "float", "binary"):
        return cast.isNotNull()
    return cast.isNotNull() & cast.try_cast(own).eqNullSafe(value)


def _stack(counts: DataFrame, rows: list[tuple[list, str]], names: list[str], last: str) -> DataFrame:
    """One aggregate row to one row per check."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)], F.col(c).alias(last))
               for values, c in rows]
    return counts.select(F.inline(F.array(*structs)))


def schema_conformance(df: DataFrame, table: str, columns: dict[str, dict]) -> DataFrame:
    """Per declared column: values, and those that the declared type cannot hold. One pass.

    A declared column that the table lacks has NULL counts.
    """
    aggregates, structs = _type_counts(df, table, columns)
    counted = df.agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
    return counted.select(F.inline(F.array(*structs)))


def _type_counts(df: DataFrame, table: str, columns: dict[str, dict]) -> tuple[list[Column], list[Column]]:
    """The aggregates that count a column's values and misfits, and per column the row they make."""
    present = set(df.columns)
    aggregates, structs = [], []
    for i, (name, spec) in enumerate(columns.items()):
        kind = spec["type"].upper()
        if name in present:
            value = F.col(quoted(name))
            aggregates.append(F.count(value).alias(f"n{i}"))
            aggregates.append(F.count_if(
                value.isNotNull() & ~fits(df, name, spark_type(kind))).alias(f"f{i}"))
            counts = [F.col(f"n{i}"), F.col(f"f{i}")]
        else:
            counts = [F.lit(None).cast("bigint"), F.lit(None).cast("bigint")]
        structs.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(name).alias("column_name"),
            F.lit(kind).alias("declared_type"), counts[0].alias("n_values"),
            counts[1].alias("n_failed")))
    return aggregates, structs


def _table_report(df: DataFrame, table: str, columns: dict[str, dict]) -> DataFrame:
    """Types, required columns and key of a table: one aggregate for whatever is counted row by row, and one
    by key."""
    typed = {name: spec for name, spec in columns.items() if "type" in spec}
    key = primary_key(columns)
    required = [name for name, spec in columns.items() if spec.get("nullable") is False or spec.get("primary_key")]
    present = set(df.columns)
    row = lambda rule, column, count: F.struct(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"),
        count.cast("bigint").alias("n_violations"))
    aggregates, structs = _type_counts(df, table, typed)
    rows = [row("type", name, s["n_failed"]) for name, s in zip(typed, structs, strict=True)]
    for i, name in enumerate(required):
        if name in present:
            aggregates.append(F.count_if(F.col(quoted(name)).isNull()).alias(f"null{i}"))
        rows.append(row("not_null", name, F.col(f"null{i}")) if name in present else row("missing_column", name, F.lit(1)))
    counted = df.agg(*aggregates) if aggregates else local_frame(df.sparkSession, [(0,)], "n bigint")
    report = counted.select(F.inline(F.array(*rows))) if rows else local_frame(df.sparkSession, [], REPORT_SCHEMA)
    if key and set(key) <= present:
        surplus = duplicate_keys(df, key).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n"))
        report = report.unionByName(surplus.select(F.inline(F.array(row("primary_key", ",".join(key), F.col("n"))))))
    return report


def primary_key(columns: dict[str, dict]) -> list[str]:
    return [name for name, spec in columns.items() if spec.get("primary_key")]


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once, with how often. Counted map-side before the shuffle."""
    return df.groupBy(*[F.col(f"`{name}`") for name in key]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def null_and_key_check(df: DataFrame, table: str, columns: dict[str, dict]) -> DataFrame:
    """Violations of ``nullable: false`` and ``primary_key: true`` as ``(table, rule, column, n)``.

    For the key, ``n_violations`` counts the surplus rows (all but one of each key value). A required
    column that the table lacks is a row of rule ``missing_column``, and a key with such a column is not counted.
    """
    names = ["table_name", "rule", "column_name"]
    key = primary_key(columns)
    required = [name for name, spec in columns.items()
                if spec.get("nullable") is False or spec.get("primary_key")]
    absent = [name for name in required if name not in df.columns]
    required = [name for name in required if name not in absent]
    if absent:
        lacking = local_frame(df.sparkSession, [(table, "missing_column", name, 1) for name in absent], REPORT_SCHEMA)
        rest = null_and_key_check(df, table, {
            name: spec if set(key) <= set(df.columns) else {**spec, "primary_key": False, "nullable": name not in required}
            for name, spec in columns.items() if name not in absent})
        return lacking.unionByName(rest)
    report = None
    if required:
        counts = df.agg(*[F.count_if(F.col(f"`{name}`").isNull()).alias(f"n{i}")
                          for i, name in enumerate(required)])
        report = _stack(counts, [([table, "not_null", name], f"n{i}")
                                 for i, name in enumerate(required)], names, "n_violations")
    if key:
        surplus = duplicate_keys(df, key).agg(
            F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n"))
        unique = _stack(surplus, [([table, "primary_key", ",".join(key)], "n")], names,
                        "n_violations")
        report = unique if report is None else report.unionByName(unique)
    if report is None:
        return local_frame(df.sparkSession, [], REPORT_SCHEMA)
    return report


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str
    on_delete: str = "NO ACTION"

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}"


def foreign_keys(rules: dict | None) -> list[ForeignKey]:
    keys = []
    for table, columns in (rules or {}).get("foreign_keys", {}).items():
        for column, spec in columns.items():
            parent, _, parent_column = spec["references"].rpartition(".")
            keys.append(ForeignKey(table, column, parent, parent_column,
                                   spec.get("on_delete", "NO ACTION").upper()))
    return keys


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Foreign-key values without a parent, and how many rows have each.

    The child is counted per value first, so what is joined is distinct values: a value that a
    third of all rows share is one row by then. NULL refers to nothing and is no orphan.
    """
    value = F.col(quoted(column))
    values = child.where(value.isNotNull()).groupBy(value.alias("fk_value")).agg(F.count(F.lit(1)).alias("n_rows"))
    parents = parent.select(F.col(quoted(parent_column)).alias("fk_value"))
    return values.join(parents, "fk_value", "left_anti")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The rows without a parent, whole. Runs a job that finds the orphan values first."""
    missing = materialized(orphan_keys(child, column, parent, parent_column).select(
        F.col("fk_value").alias("__fk")), "orphans")
    return child.join(missing, F.col(quoted(column)) == F.col("__fk"), "left_semi")


def orphan_report(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """Per foreign key: orphan rows and distinct orphan values.

    The keys of a table are counted in one scan of it (a job, where there are several), and their distinct
    values looked up among the parents.
    """
    if not keys:
        raise ValueError("no foreign keys declared")
    parts = []
    for table in dict.fromkeys(key.table for key in keys):
        own = [key for key in keys if key.table == table]
        if len(own) == 1:
            found = [orphan_keys(tables[table], own[0].column, tables[own[0].parent], own[0].parent_column)]
        else:
            counted = materialized(_counted_values(tables[table], [key.column for key in own]), "fk-values")
            found = [counted.where(F.col("key") == i).select(F.col(f"v{i}").alias("fk_value"), "n_rows").join(
                tables[key.parent].select(F.col(quoted(key.parent_column)).alias("fk_value")), "fk_value", "left_anti")
                for i, key in enumerate(own)]
        parts += [orphans.agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(
            F.lit(key.table).alias("table_name"), F.lit(key.column).alias("column_name"),
            F.lit(f"{key.parent}.{key.parent_column}").alias("parent"), "n_values", "n_rows")
            for key, orphans in zip(own, found, strict=True)]
    return functools.reduce(DataFrame.unionByName, parts)


def _counted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of several columns occurs: ``key`` (which column), ``v<key>`` (its value), ``n_rows``.

    Every column keeps its type; the others are NULL in its rows. Counted map-side before the shuffle.
    """
    kinds = [df.schema[name].dataType for name in columns]

    def of(i: int) -> Column:
        values = [F.col(quoted(columns[j])) if i == j else F.lit(None).cast(kind) for j, kind in enumerate(kinds)]
        return F.struct(F.lit(i).alias("key"), *[value.alias(f"v{j}") for j, value in enumerate(values)])

    stacked = df.select(F.inline(F.array(*[of(i) for i in range(len(columns))])))
    names = [f"v{j}" for j in range(len(columns))]
    there = functools.reduce(operator.or_, [F.col(name).isNotNull() for name in names])
    return stacked.where(there).groupBy("key", *names).agg(F.count(F.lit(1)).alias("n_rows"))


def _cascade_order(keys: list[ForeignKey], roots: set[str]) -> list[str]:
    """Tables the deletion reaches, parents before children."""
    children: dict[str, set[str]] = {}
    for key in keys:
        children.setdefault(key.parent, set()).add(key.table)
    reached, pending = set(), list(roots)
    while pending:
        table = pending.pop()
        if table not in reached:
            reached.add(table)
            pending.extend(children.get(table, ()))
    parents = {t: {k.parent for k in keys if k.table == t and k.parent in reached} - {t} for t in reached}
    order: list[str] = []
    while len(order) < len(reached):
        ready = sorted(t for t in reached if t not in order and parents[t] <= set(order))
        if not ready:
            raise ValueError(f"foreign keys form a cycle: {sorted(reached - set(order))}")
        order.extend(ready)
    return order


def cascade_delete(tables: dict[str, DataFrame], keys: list[ForeignKey],
                   deleted: dict[str, DataFrame | str]) -> dict[str, DataFrame]:
    """Mark the rows that fall when the given ones are deleted, through all CASCADE levels.

    ``deleted`` maps a table to a condition. Each table comes back whole with a boolean ``deleted``
    column. The keys of fallen parents are written out level by level (one job each), and a child
    is joined with nothing else.
    """
    cascading = [k for k in keys if k.on_delete == "CASCADE"]
    marked: dict[str, DataFrame] = {}
    for table in _cascade_order(cascading, set(deleted)):
        df = tables[table]
        falls = [F.coalesce(F.expr(deleted[table]), F.lit(False))] if table in deleted else []
        for i, key in enumerate(k for k in cascading if k.table == table and k.parent in marked and k.parent != table):
            fallen = marked[key.parent].where("deleted").select(
                F.col(quoted(key.parent_column)).alias(f"__gone{i}"))
            gone = materialized(fallen.where(F.col(f"__gone{i}").isNotNull()).distinct(), "fallen")
            df = df.join(gone, F.col(quoted(key.column)) == F.col(f"__gone{i}"), "left")
            falls.append(F.col(f"__gone{i}").isNotNull())
        names = [F.col(quoted(name)) for name in tables[table].columns]
        marked[table] = df.select(*names, functools.reduce(operator.or_, falls).alias("deleted"))
        for key in cascading:
            if key.table == key.parent == table:
                marked[table] = _fall_within(marked[table], key)
    return marked


def _fall_within(df: DataFrame, key: ForeignKey) -> DataFrame:
    """Deletion along a key that refers to its own table: a fixed point over its key columns alone.

    A round joins only the keys that fell in the one before, a few levels at a time, so the table itself is
    read twice, whatever the depth: for the two columns, and for the result. Rounds write what is new in them;
    a row whose key is NULL refers to nothing.
    """
    parent, child = F.col(quoted(key.parent_column)), F.col(quoted(key.column))
    links = materialized(df.select(parent.alias("__id"), child.alias("__of"), "deleted").where("__id IS NOT NULL"), "links")
    fallen = frontier = materialized(links.where("deleted").select("__id").distinct(), "fallen")
    links = links.where("__of IS NOT NULL AND NOT deleted").select("__id", "__of")
    while frontier.limit(1).count():
        level, levels = frontier, []
        for i in range(LEVELS):
            level = links.join(level.withColumnRenamed("__id", "__gone"), F.col("__of") == F.col("__gone")).select("__id").distinct()
            levels.append(level.withColumn("__level", F.lit(i)))
        found = functools.reduce(DataFrame.unionByName, levels).groupBy("__id").agg(F.min("__level").alias("__level"))
        found = materialized(found.join(fallen, "__id", "left_anti"), "fallen")
        fallen = fallen.unionByName(found.select("__id"))
        frontier = found.where(F.col("__level") == LEVELS - 1).select("__id")
    names = [F.col(quoted(name)) for name in df.columns if name != "deleted"]
    gone = materialized(fallen.select(F.col("__id").alias("__gone")), "all-fallen")
    return df.join(gone, child == F.col("__gone"), "left").select(
        *names, (F.col("deleted") | F.col("__gone").isNotNull()).alias("deleted"))


def cascade_summary(marked: dict[str, DataFrame]) -> DataFrame:
    """Rows that fall and rows that stay, per table."""
    report = None
    for table, df in marked.items():
        part = df.agg(F.count_if("deleted").alias("n_deleted"),
                      F.count_if(~F.col("deleted")).alias("n_kept"))
        part = part.select(F.lit(table).alias("table_name"), "n_deleted", "n_kept")
        report = part if report is None else report.unionByName(part)
    return report


def validation_report(dataset: Dataset, schemas: dict | None, rules: dict | None) -> DataFrame:
    """All declared checks of a dataset as ``(table_name, rule, column_name, n_violations)``.

    Tables and columns that a declaration names and the dataset lacks are rows of the report themselves.
    """
    parts = []
    missing = []
    for table in (schemas or {}).get("tables", {}):
        columns = declared_columns(schemas, table)
        if table not in dataset.tables:
            missing.append((table, "missing_table", None, 1))
            continue
        if columns:
            parts.append(_table_report(dataset.table(table), table, columns))
    keys = []
    for key in foreign_keys(rules):
        lost = [(key.table, "missing_table" if name not in dataset.tables else "missing_column",
                 column if name in dataset.tables else None, 1)
                for name, column in ((key.table, key.column), (key.parent, key.parent_column))
                if name not in dataset.tables or column not in dataset.table(name).columns]
        missing += [row for row in lost if row not in missing]
        keys += [] if lost else [key]
    if missing:
        parts.append(local_frame(dataset.spark, missing, REPORT_SCHEMA))
    if keys:
        tables = {name: dataset.table(name) for key in keys for name in (key.table, key.parent)}
        parts.append(orphan_report(tables, keys).select(
            "table_name", F.lit("foreign_key").alias("rule"), "column_name",
            F.col("n_rows").alias("n_violations")))
    if not parts:
        return local_frame(dataset.spark, [], REPORT_SCHEMA)
    return functools.reduce(DataFrame.unionByName, parts)
