"""A dataset: a folder with one file or folder per table, opened for reading only."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.types import shown_type
from snapledger.sources.csv import read_table_dump
from snapledger.sources.local import local_frame
from snapledger.storage import exists, list_children

FORMATS = ("parquet", "orc", "json", "csv")
DATASET_VARIABLE = "SNAPLEDGER_DATASET"
DEFAULT_ROWS = 100


class UnknownTable(ValueError):
    """The dataset has no table of that name."""


def shown_limit(rows: int | None) -> int:
    """The number of rows a preview shows: 100 unless a positive number is asked for."""
    return rows if rows is not None and rows > 0 else DEFAULT_ROWS


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One table, by the extension of its path."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_table_dump(spark, [path])
    if suffix not in FORMATS:
        raise ValueError(f"only {', '.join(FORMATS)} are supported, got: {path}")
    return spark.read.format(suffix).load(path)


class Dataset:
    """Tables by name. Nothing here writes, and every result stays a DataFrame.

    A table may be given as a path; it is then looked at when it is first used.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | str], prefix: str = ""):
        self.spark = spark
        self.prefix = prefix
        self._tables = dict(sorted(tables.items()))

    @property
    def tables(self) -> list[str]:
        return list(self._tables)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise UnknownTable(f"Table not found: {name}")
        if isinstance(self._tables[name], str):
            self._tables[name] = read_table(self.spark, self._tables[name])
        return self._tables[name]

    def list_tables(self) -> DataFrame:
        return local_frame(self.spark, [(name,) for name in self._tables], "table_name string")

    def describe(self, name: str) -> DataFrame:
        """Columns of a table from its metadata alone."""
        rows = [(name, i, f.name, shown_type(f.dataType), "YES" if f.nullable else "NO")
                for i, f in enumerate(self.table(name).schema)]
        return local_frame(self.spark, rows,
                           "table_name string, position int, column_name string, "
                           "column_type string, is_nullable string")

    def preview(self, name: str, rows: int | None = None,
                order_by: list[str] | None = None) -> DataFrame:
        """First rows of a table, all columns; without ``order_by`` in whatever order Spark reads."""
        df = self.table(name)
        if order_by:
            df = df.orderBy(*order_by)
        return df.limit(shown_limit(rows))

    def count(self, name: str) -> DataFrame:
        """One row ``(table_name, row_count)``; reads no column."""
        return self.table(name).groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")

    def row_counts(self, names: list[str] | None = None) -> DataFrame:
        """Row-count report over several tables."""
        counts = [self.count(name) for name in (self.tables if names is None else names)]
        report = counts[0]
        for part in counts[1:]:
            report = report.unionByName(part)
        return report

    def view_summary(self, name: str, rows: int | None = None) -> DataFrame:
        """"Showing n of N" for a preview of the table."""
        shown = F.least(F.lit(shown_limit(rows)).cast("bigint"), F.col("row_count"))
        return self.count(name).select(
            "table_name", shown.alias("shown"), F.col("row_count").alias("total"),
            F.format_string("Showing %d of %d rows", shown, "row_count").alias("summary"))

    def filled_counts(self, name: str) -> DataFrame:
        """Per column the number of values that are not NULL, in one pass over the table."""
        df = self.table(name)
        filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_filled"))
                          for i, c in enumerate(df.columns)])
        return filled.select(F.lit(name).alias("table_name"), F.inline(pairs))

    def sql(self, query: str, **parameters) -> DataFrame:
        """Any query over the tables, with ``:name`` parameters.

        The text runs as a subquery, where only queries parse: no statement can change anything.
        Tables are known by their name, with the dataset's prefix in front.
        """
        text = query.strip().rstrip(";")
        words = set(re.findall(r"\w+", text.lower()))
        catalog, made = self.spark.catalog, []
        known = {view.name.lower(): view.name for view in catalog.listTables() if view.isTemporary}
        hidden = {}
        for name in self._tables:
            view = self.prefix + name
            if set(re.findall(r"\w+", view.lower())) <= words:
                if view.lower() in known:
                    hidden[view] = self.spark.table(known[view.lower()])
                self.table(name).createOrReplaceTempView(view)
                made.append(view)
        # The query is analysed here and holds its tables from then on, so their names can go again:
        # another dataset's query must not find them.
        try:
            return self.spark.sql(f"SELECT * FROM (\n{text}\n)", args=parameters or None)
        finally:
            for view in made:
                catalog.dropTempView(view)
                if view in hidden:
                    hidden[view].createOrReplaceTempView(view)


def open_dataset(spark: SparkSession, path: str | None = None, default: str | None = None,
                 prefix: str = "") -> Dataset:
    """Open a folder of tables: ``path``, else the environment variable, else ``default``.

    Queries see the tables of the dataset they are put to. With a ``prefix`` the tables of several
    datasets can be told apart in a session.
    """
    root = path or os.environ.get(DATASET_VARIABLE) or default
    if not root:
        raise ValueError(f"no dataset given: pass a path or set {DATASET_VARIABLE}")
    if not exists(spark, root):
        raise FileNotFoundError(f"Dataset not found: {root}")
    tables: dict[str, DataFrame | str] = {}
    for name, entry, _ in list_children(spark, root):
        stem, dot, suffix = name.rpartition(".")
        if not dot or suffix.lower() not in FORMATS:
            continue
        if stem in tables:
            raise ValueError(f"table {stem} is there in two formats in {root}")
        tables[stem] = entry
    if not tables:
        raise ValueError(f"no {', '.join(FORMATS)} tables in {root}")
    return Dataset(spark, tables, prefix)
