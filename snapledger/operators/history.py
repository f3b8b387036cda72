"""Many dated copies of a table: as one table, the newest state, the history of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.digest import hash_pieces, row_hashes
from snapledger.plans.load import unite


def union_snapshots(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Dated copies as one table with ``snapshot_date``; a column one of them lacks is NULL there."""
    return unite([df.withColumn("snapshot_date", F.lit(date).cast("date"))
                  for date, df in snapshots.items()])


def record_history(snapshots: DataFrame, keys: list[str], columns: list[str] | None = None,
                   date: str = "snapshot_date") -> DataFrame:
    """Per record: first and last date seen, number of dates, and how often it changed in between.

    Each (record, date) is reduced to a digest before the window, map-side first, so a window
    group holds at most one row per date however many rows share a key.
    """
    names = columns or [n for n in snapshots.columns if n not in keys and n != date]
    pieces = hash_pieces(row_hashes([snapshots.schema[name] for name in names]))
    digested = snapshots.select(*keys, date, *[p.alias(f"__h{i}") for i, p in enumerate(pieces)])
    states = digested.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(f"__h{i}").alias(f"__h{i}") for i in range(len(pieces))])
    state = F.struct("__n", *[f"__h{i}" for i in range(len(pieces))])
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(date))
    changed = before.isNotNull() & (before != state)
    return states.select(*keys, date, changed.alias("__changed")).groupBy(*keys).agg(
        F.min(date).alias("first_seen"), F.max(date).alias("last_seen"),
        F.count(F.lit(1)).alias("n_snapshots"), F.count_if("__changed").alias("n_changes"))
