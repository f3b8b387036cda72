"""Queries over the given tables, one or more per operator, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Workload:
    name: str
    run: Query
    sql: str | None


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL whose result it must equal."""
    def register(run: Query) -> Query:
        if name in WORKLOADS:
            raise ValueError(f"two workloads are called {name}")
        WORKLOADS[name] = Workload(name, run, sql)
        return run
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def all_workloads() -> dict[str, Workload]:
    from snapledger.workloads import (catalogue, comparing, conformance, ingest,  # noqa: F401
                                      reporting, rules, searching)
    return WORKLOADS
