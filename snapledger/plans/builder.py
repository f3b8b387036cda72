"""Query builder: a declarative specification becomes DataFrame calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.operators.filters import filter_rows
from snapledger.operators.reshape import derived_columns
from snapledger.sources.dataset import Dataset

AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "count_distinct": F.count_distinct,
}
PARTS = {"table", "columns", "derive", "filter", "group_by", "aggregates", "having", "sort", "limit"}


def _aggregate(name: str, spec: dict) -> Column:
    function = spec["function"]
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function}")
    if "column" not in spec:
        if function != "count":
            raise ValueError(f"{function} needs a column")
        return F.count(F.lit(1)).alias(name)
    return AGGREGATES[function](F.col(spec["column"])).alias(name)


def build_query(dataset: Dataset, spec: dict) -> DataFrame:
    """DataFrame for a specification::

        {"table": t, "derive": {name: expression}, "filter": {...},
         "columns": [...]  |  "group_by": [...], "aggregates": {name: {"function": f, "column": c}},
         "having": {...}, "sort": [[column, "asc" | "desc"], ...], "limit": n}
    """
    unknown = set(spec) - PARTS
    if unknown:
        raise ValueError(f"unknown parts in the query: {sorted(unknown)}")
    df = dataset.table(spec["table"])
    df = derived_columns(df, spec.get("derive", {}))
    df = filter_rows(df, spec.get("filter"))
    if spec.get("group_by") or spec.get("aggregates"):
        aggregates = [_aggregate(name, a) for name, a in spec.get("aggregates", {}).items()]
        groups = df.groupBy(*spec.get("group_by", []))
        df = groups.agg(*aggregates) if aggregates else df.select(*spec["group_by"]).distinct()
        df = filter_rows(df, spec.get("having"))
    if spec.get("sort"):
        df = df.orderBy(*[F.col(name).desc() if way.lower() == "desc" else F.col(name).asc()
                          for name, way in spec["sort"]])
    if spec.get("columns"):
        df = df.select(*spec["columns"])
    if spec.get("limit") is not None:
        df = df.limit(spec["limit"])
    return df
