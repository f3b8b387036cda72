import hashlib
from collections import Counter

import pytest

from snapledger.llm import sharding
from tests.llm.odd import ROWS, frame


def test_table_is_filled_in_turns_by_preference():
    shards, size = ["a", "b", "c"], 13
    orders = []
    for shard in shards:
        offset, step = sharding.preference(shard, size)
        orders.append([(offset + j * step) % size for j in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    want = [-1] * size
    while -1 in want:
        for i, order in enumerate(orders):
            free = next((slot for slot in order if want[slot] < 0), None)
            if free is not None:
                want[free] = i
    assert sharding.lookup_table(shards, size) == want


def test_shares_are_even_and_a_lost_shard_moves_little():
    shards = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(shards)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19)
    assert moved < 0.15 * len(table)


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_wrong_parameters(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_odd_rows(spark):
    shards = ["a", "b", "c"]
    table = sharding.lookup_table(shards)
    got = sharding.assign_shards(frame(spark), "doc_id", shards).collect()
    assert len(got) == len(ROWS)
    for row in got:
        slot = int(hashlib.md5(str("" if row["doc_id"] is None else row["doc_id"]).encode()).hexdigest()[:15], 16) % len(table)
        assert (row["slot"], row["shard"]) == (slot, shards[table[slot]])
    assert sharding.assign_shards(frame(spark, []), "doc_id", shards).count() == 0


def test_written_folders_hold_all_rows(spark, tmp_path):
    placed = sharding.assign_shards(spark.range(1000), "id", ["a", "b"])
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard").collect())) == sorted(map(tuple, placed.select("id", "shard").collect()))
