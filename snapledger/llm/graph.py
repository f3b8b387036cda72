"""Connected components of a graph that is only ever held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component`` (its smallest id) for all ends of the given edges of long ids.

    Large star and small star in turn: every id links its larger neighbours, then its smaller ones,
    to the smallest id it sees, until nothing changes, which takes about the logarithm of the size
    rounds. An id with very many edges is pre-aggregated for its minimum and split when joined. Each
    round is written to the shared folder; only a count and a checksum reach the driver.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    state = _checksum(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(lowest, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = written(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .union(lowest.select("u", F.col("m").alias("v"))).distinct())
        now, before = written(small, "small-star"), state
        state = _checksum(now)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
