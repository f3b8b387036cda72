"""Placement of keys on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: an offset and a
step, both hashed from the shard's name. Shards take turns, each claiming its most preferred slot
that is still free, until the table is full. All shards then hold nearly the same number of slots,
and losing one shard moves few keys of the others. A key hashes to a slot, and the slot names the
shard: one lookup, no shuffle. The table's size is a parameter and does not depend on the data, so
it can be broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col

#: Slots; a prime at least a hundred times the number of shards keeps the shares within about 1 %.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots; with a prime size it meets every slot."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For every slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or size < len(shards):
        raise ValueError(f"the table size must be a prime of at least {len(shards)}: {size}")
    walks = [preference(shard, size) for shard in shards]
    at = [offset for offset, _ in walks]
    table, left = [-1] * size, size
    while left:
        for index, (_, step) in enumerate(walks):
            slot = at[index]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot] = index
            at[index] = (slot + step) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the table's size. Null is the empty key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], *, size: int = TABLE_SIZE,
                  slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """The rows with slot and shard added; columns of these names are replaced.

    Rows with equal keys (null is the empty key) go to the same shard. Repeated rows stay, an empty
    table gives an empty result. Nothing is shuffled: the table of ``size`` rows is broadcast.
    """
    spark = df.sparkSession
    rows = [(slot, shards[index]) for slot, index in enumerate(lookup_table(shards, size))]
    table = spark.createDataFrame(rows, f"`{slot_column}` int, `{shard_column}` string")
    placed = df.withColumn(slot_column, slot_of(col(key), size))
    if shard_column in placed.columns:
        placed = placed.drop(shard_column)
    return placed.join(F.broadcast(table), slot_column)


def write_shards(df: DataFrame, path: str, shard_column: str = "shard") -> None:
    """Write one folder per shard; a shard with a large part of the rows is split over many tasks."""
    df.hint("rebalance", shard_column).write.partitionBy(shard_column).parquet(path)
