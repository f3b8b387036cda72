"""Near duplicates by SimHash: fingerprints within a Hamming distance are found by vantage-point trees.

A document's fingerprint has a bit set where more than half of its shingles' hashes have. Equal
fingerprints are taken once. Trees over whole fingerprints would hardly prune: distances from any vantage
point crowd around half the bits, and a ball of radius 4 meets more than half of all rings. But of two
fingerprints that differ in at most 4 bits, one of the four quarters differs in at most 1. So each quarter
has a tree of its own, searched with the quarter of the radius, in which most branches are pruned:

1. A vantage-point tree splits all values of a quarter by their Hamming distance from a vantage point into
   an inner and an outer half, and so on until a leaf holds few values. It depends on no data and has a
   fixed size, so all tasks have it.
2. A leaf of a quarter's tree is a shard: fingerprints whose quarter falls into it are at home there. By the
   triangle inequality a ball goes into the inner half only if its centre is at most radius outside, and into
   the outer half only if at most radius inside. Fingerprints visit the shards that their ball overlaps, of
   two shards that of the lower number, so that every pair meets.
3. In a shard whole fingerprints are compared where the quarters' values are close enough. A shard of many
   rows is cut into tiles of two blocks. A tile returns a spanning forest of its links, at most a row per
   fingerprint, whatever the number of pairs.
4. Components of the links have the smallest key of their documents.

Nothing is approximate: every pair within the radius is compared. Comparisons still grow with the square of
the number of different fingerprints, at about a thousandth of all pairs for fingerprints without structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, shuffled, sorted_groups, text_or_empty, written
from snapledger.llm.graph import components

WORDS, SEED, RADIUS = 4, 42, 4
QUARTERS, QUARTER_BITS = 4, 16
#: Most values of a quarter in a leaf, vantage points tried for a split, rows of a tile's block, pairs held at once.
LEAF_VALUES, TRIED, BLOCK, PAIRS = 256, 24, 1 << 14, 1 << 20


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if it is in more than half of the hashes of the text's word shingles, repeats included.

    A-Z are lower-cased; words are what white space (\\x20, \\x09 to \\x0D) separates. A text of fewer words
    is one shingle, a text without words has no bit set.
    """
    parts = text.encode().lower().split()  # both touch ASCII bytes only
    if not parts:
        return 0
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(parts))
    spans = zip((ends - lengths)[:len(parts) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    hashes = map(xxhash.xxh64_intdigest, (line[a:b] for a, b in spans), repeat(SEED))
    counts, total = np.zeros(64, np.int64), len(parts) - size + 1
    while len(block := np.fromiter(islice(hashes, 1 << 16), np.uint64)):
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > total).tolist())


@dataclass(frozen=True)
class Tree:
    """Per node its vantage point, the largest distance of its inner half, and both children; a leaf has its number."""

    vantage: np.ndarray
    limit: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    leaf: np.ndarray

    def reached(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: all leaves that may hold a value within the radius of the row's value."""
        row, node, rows, leaves = np.arange(len(values)), np.zeros(len(values), np.int64), [], []
        while len(row):
            end = self.leaf[node] >= 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node = row[~end], node[~end]
            distance = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int64)
            into, out = distance - radius <= self.limit[node], distance + radius > self.limit[node]
            row, node = np.concatenate([row[into], row[out]]), np.concatenate([self.inner[node[into]], self.outer[node[out]]])
        return np.concatenate(rows or [row]), np.concatenate(leaves or [node])


@lru_cache
def tree(radius: int, leaf_values: int = LEAF_VALUES, bits: int = QUARTER_BITS) -> Tree:
    """A vantage-point tree over all values of so many bits; the same at every call.

    Of a few vantage points and distances, a split takes those that leave the fewest values within the
    radius of the boundary, as these are searched for on both sides, and next to it the evenest.
    """
    rng = np.random.default_rng(20_240_613)
    nodes: list[list[int]] = []

    def grow(values: np.ndarray) -> int:
        at = len(nodes)
        nodes.append([0, 0, -1, -1, -1])
        best = None
        for vantage in rng.integers(0, 1 << bits, TRIED).tolist() if len(values) > leaf_values else []:
            counts = np.bincount(np.bitwise_count(values ^ vantage), minlength=bits + 1) / len(values)
            for limit, share in enumerate(np.cumsum(counts).tolist()):
                if 0.25 <= share <= 0.75:
                    cost = counts[max(0, limit + 1 - radius):limit + 1 + radius].sum() + abs(share - 0.5) / 2
                    best = min(best or (cost, vantage, limit), (cost, vantage, limit))
        if best:
            distance = np.bitwise_count(values ^ best[1])
            nodes[at][:2] = best[1:]
            nodes[at][2] = grow(values[distance <= best[2]])
            nodes[at][3] = grow(values[distance > best[2]])
        return at

    grow(np.arange(1 << bits))
    columns = np.array(nodes, np.int64).T.copy()
    leaves = np.flatnonzero(columns[2] < 0)
    columns[4][leaves] = np.arange(len(leaves))
    return Tree(*columns)


def _quarter(fingerprints: np.ndarray, part: int) -> np.ndarray:
    return ((fingerprints.astype(np.int64).view(np.uint64) >> np.uint64(QUARTER_BITS * part)) & np.uint64((1 << QUARTER_BITS) - 1)).astype(np.int64)


def _placed(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``_fp`` once in its home shard (``_part``, ``_leaf``) of every quarter, and in all lower ones its ball overlaps."""
    reach = radius // QUARTERS
    plan = tree(reach)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for part in range(QUARTERS):
                quarter = _quarter(values, part)
                row, leaf = plan.reached(quarter, 0)
                home = np.empty(len(values), np.int64)
                home[row] = leaf
                row, leaf = plan.reached(quarter, reach)
                use = leaf <= home[row]
                row, leaf = row[use], leaf[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[row]), pa.array(np.full(len(row), part, np.int8)), pa.array(leaf.astype(np.int32)),
                     pa.array(leaf == home[row])], ["_fp", "_part", "_leaf", "_home"])

    return fingerprints.select("_fp").mapInArrow(place, "_fp bigint, _part tinyint, _leaf int, _home boolean")


def _close(left: np.ndarray, right: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in two sorted arrays of values that differ in at most ``reach`` bits, some at a time."""
    ours, a, n = np.unique(left, return_index=True, return_counts=True)
    theirs, b, m = np.unique(right, return_index=True, return_counts=True)
    x, y = np.nonzero(np.bitwise_count(ours[:, None] ^ theirs[None, :]) <= reach)
    # One entry for each row of the left and group of the right.
    group = np.repeat(np.arange(len(x)), n[x])
    row = a[x][group] + np.arange(len(group)) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
    begin, size = b[y][group], m[y][group]
    done = np.cumsum(size)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(done, done[at] - size[at] + PAIRS, "right")))
        sizes = size[at:end]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield np.repeat(row[at:end], sizes), np.repeat(begin[at:end], sizes) + inside
        at = end


def _united(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after all pairs of rows have got the same one, the lowest of their set."""
    top = np.arange(len(label))
    while True:
        a, b = top[label[left]], top[label[right]]
        apart = a != b
        if not apart.any():
            return top[label]
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def linked_in_tile(values: np.ndarray, left: np.ndarray, right: np.ndarray, part: int, radius: int) -> np.ndarray:
    """Label of each fingerprint: the place of one that it is linked with, directly or by others in the tile."""
    label, bits = np.arange(len(values)), values.astype(np.int64).view(np.uint64)  # the count ignores signs
    quarter = _quarter(values, part)
    left, right = left[np.argsort(quarter[left], kind="stable")], right[np.argsort(quarter[right], kind="stable")]
    for a, b in _close(quarter[left], quarter[right], radius // QUARTERS):
        a, b = left[a], right[b]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        near = np.bitwise_count(bits[a] ^ bits[b]) <= radius
        if near.any():
            label = _united(label, a[near], b[near])
    return label


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that connect whatever distinct fingerprints ``_fp`` are connected within the radius."""
    placed = _placed(fingerprints, radius)
    shard = ["_part", "_leaf"]
    # At most a row for each leaf of the four trees, whose number is fixed.
    sizes = written(placed.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "shards")
    block = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int").alias("_block")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    as_left = F.transform(others, lambda j: F.struct(F.col("_block").alias("_row"), j.alias("_column"), F.lit(True).alias("_left")))
    as_right = F.transform(others, lambda i: F.struct(i.alias("_row"), F.col("_block").alias("_column"), F.lit(False).alias("_left")))
    tiles = F.when(F.col("_home"), F.concat(as_left, F.filter(as_right, lambda t: t["_row"] < t["_column"]))).otherwise(as_right)
    keys = [*shard, "_row", "_column"]
    dealt = (placed.join(F.broadcast(sizes), shard).select("_fp", *shard, "_home", "_blocks", block)
             .select("_fp", *shard, F.explode(tiles).alias("_tile")).select("_fp", *shard, "_tile.*"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, keys):
            values, left = group["_fp"], np.flatnonzero(group["_left"])
            # On the diagonal the left block is also the right one.
            right = np.arange(len(values)) if group["_row"][0] == group["_column"][0] else np.flatnonzero(~group["_left"].astype(bool))
            label = linked_in_tile(values, left, right, int(group["_part"][0]), radius)
            tied = np.flatnonzero(label != np.arange(len(values)))
            if len(tied):
                yield pd.DataFrame({"a": values[label[tied]], "b": values[tied]})

    return (dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a bigint, b bigint").distinct())


def near_duplicates(df: DataFrame, key: str, text: str, *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row its key, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    Rows are linked whose fingerprints differ in at most ``radius`` bits (below 64); ``component_id`` is the
    smallest key that links lead to, the row's own included. Null text: the empty text, whose fingerprint is
    zero and is linked as any other. A null key is never the smallest unless a component has no other; then
    ``component_id`` is null. Texts of any length are read whole, a block of shingles at a time. Repeated
    rows have equal results; an empty table gives an empty one; other columns are ignored.
    """
    @F.pandas_udf("bigint")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, words) for x in batch], np.uint64).view(np.int64))

    rows = written(df.select(col(key).alias("_key"), sign(text_or_empty(text)).alias("_fp")), "fingerprints")
    distinct = written(rows.groupBy("_fp").agg(F.min("_key").alias("_low")), "distinct-fingerprints")
    found = written(components(written(links(distinct, radius), "fingerprint-links")), "components")
    lows = (found.join(shuffled(distinct), found["id"] == distinct["_fp"]).groupBy("component").agg(F.min("_low").alias("_least")))
    known = written(found.join(lows, "component").select(F.col("id").alias("_of"), "_least", F.lit(True).alias("_linked")), "lowest-keys")
    lowest = written(distinct.join(shuffled(known), F.col("_fp") == F.col("_of"), "left").select(
        F.col("_fp").alias("_of"), F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("_low")).alias("_component")), "of-fingerprint")
    return rows.join(shuffled(lowest), F.col("_fp") == F.col("_of")).select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
