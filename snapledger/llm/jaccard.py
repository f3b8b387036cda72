"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification.

1. Texts that are equal are one node, so copies cost nothing further. Every node gets a MinHash
   signature of its word 5-grams.
2. Nodes that agree on all values of a band of the signature meet in a bucket. Buckets of the same
   members are kept once. In a bucket the signatures are compared a few values at a time; a pair is
   dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
   threshold falls below the tolerance. The pairs left over tie nodes into clusters. A bucket of more
   than ``BLOCK`` nodes is tied together as it is, which only makes its cluster larger.
3. All pairs of a cluster are compared again in tiles of two blocks of about ``BLOCK`` nodes, so a
   cluster of any size is dealt over many tasks: pruned in the same way, and the rest verified on the
   exact sets of n-grams. A tile returns how many links each node has and a spanning forest of them,
   so rows grow with the nodes and not with the pairs.
4. Classes are the connected components of the verified links.

With 24 bands of 5 values a pair at 0.8 is missed by all bands with probability 7e-5, and by pruning
with about the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, shuffled, sorted_groups, text_or_empty, written
from snapledger.llm.graph import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
BANDS, ROWS = 24, 5
#: Signature values compared before a pair is judged again.
STEP = 24
BLOCK = 256
_MULTIPLIERS = np.random.default_rng(20_240_601).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(20_240_602).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word n-grams, lower case, split at white space.

    A text of fewer words has one, made of all its words; a text without words has none.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = min(words, len(parts))
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ ids[i:len(ids) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray) -> bytes | None:
    """MinHash values (4 bytes each) of a set of hashes; none for the empty set."""
    if not len(grams):
        return None
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 1024):
        hashed = np.multiply.outer(_MULTIPLIERS, grams[at:at + 1024])
        hashed += _SHIFTS[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def fewest_matches(threshold: float, tolerance: float, values: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """After so many values, the fewest matches at which a pair stays: (values, matches) pairs.

    With a uniform prior, P(similarity >= t | m of n match) is the binomial P(X <= m) for n + 1
    trials of chance t.
    """
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs whose posterior never fell below the tolerance."""
    alive, matches, at = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in limits:
        matches += (signatures[left[alive], at:n] == signatures[right[alive], at:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of a star for each connected set of the given pairs, from its smallest member."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return [(find(x), x) for x in list(top) if find(x) != x]


def verified(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have an exact Jaccard similarity of at least the threshold."""
    sizes = np.array([len(g) for g in grams])
    if len(left) <= 64:
        both = np.array([len(np.intersect1d(grams[a], grams[b], assume_unique=True))
                         for a, b in zip(left, right, strict=True)], dtype=np.int64)
    else:
        used = np.unique(np.concatenate([left, right]))
        place = np.zeros(len(grams), np.int64)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, column, seen = np.unique(np.concatenate([grams[i] for i in used]), return_inverse=True, return_counts=True)
        shared = seen[column] > 1  # an n-gram of one text only is in no intersection
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        table = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            begin, end = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(used), 4096), np.float32)
            part[owner[begin:end], column[begin:end] - at] = 1
            table += part @ part.T
        both = table[place[left], place[right]].astype(np.int64)
    return both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9


def _signatures(blobs: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u4").reshape(len(blobs), -1)


def _tied_in_buckets(nodes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """Edges ``a``, ``b`` that hold every candidate pair in one connected set."""
    bands = nodes.where("_signature IS NOT NULL").select("_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substr("_signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("_bucket"))
    buckets = (bands.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"),
                                            F.bit_xor(F.xxhash64("_id")).alias("_members"))
               .where("_n > 1").groupBy("_n", "_low", "_members").agg(F.min("_bucket").alias("_bucket")))
    buckets = written(buckets.select("_bucket", "_n", "_low"), "buckets")
    members = written(bands.join(shuffled(buckets), "_bucket"), "bucket-members")
    large = members.where(F.col("_n") > BLOCK).select(F.col("_low").alias("a"), F.col("_id").alias("b"))
    small = shuffled(members.where(F.col("_n") <= BLOCK).select("_bucket", "_id")).join(nodes.select("_id", "_signature"), "_id")

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["_bucket"]):
            ids = group["_id"]
            left, right = np.triu_indices(len(ids), 1)
            alive = surviving(_signatures(group["_signature"]), left, right, limits)
            found += forest(ids[left[alive]].tolist(), ids[right[alive]].tolist())
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    ties = small.repartition("_bucket").sortWithinPartitions("_bucket").mapInPandas(tie, "a bigint, b bigint")
    return ties.union(large)


def _verified_in_tiles(texts: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, threshold: float,
                       limits: list[tuple[int, int]]) -> DataFrame:
    """``a``, ``b``: links of a spanning forest; ``a``, ``n`` with null ``b``: how many links a node has in a tile."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    blocks = F.ceil(F.col("_size") / BLOCK)
    members = (clusters.join(sizes, "component")
               .select(F.col("id").alias("_id"), "component", blocks.alias("_blocks"),
                       F.pmod(F.xxhash64("id"), blocks).alias("_block")))
    described = written(shuffled(members).join(nodes.select("_id", "_node", "_first", "_signature"), "_id"), "cluster-members")
    # The first row of each text, by text and key, so that a text with many copies is not gathered.
    full = (texts.join(shuffled(described), (texts["_hash"] == described["_node"])
                       & texts["_key"].eqNullSafe(described["_first"]))
            .select("_id", "component", "_blocks", "_block", "_signature", "_text").dropDuplicates(["_id"]))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    tiles = (full.withColumn("_other", other)
             .withColumns({"_row": F.least("_block", "_other"), "_column": F.greatest("_block", "_other")}))
    keys = ["component", "_row", "_column"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in sorted_groups(batches, keys):
            ids, block = group["_id"], group["_block"]
            if group["_row"][0] == group["_column"][0]:
                left, right = np.triu_indices(len(ids), 1)
            else:
                first, second = np.flatnonzero(block == group["_row"][0]), np.flatnonzero(block == group["_column"][0])
                left, right = np.repeat(first, len(second)), np.tile(second, len(first))
            alive = surviving(_signatures(group["_signature"]), left, right, limits)
            left, right = left[alive], right[alive]
            needed = set(left.tolist()) | set(right.tolist())
            grams = [shingles(text, words) if i in needed else np.zeros(0, np.uint64)
                     for i, text in enumerate(group["_text"])]
            good = verified(grams, left, right, threshold)
            left, right = left[good], right[good]
            links = np.bincount(np.concatenate([left, right]), minlength=len(ids))
            out += [(a, None, n) for a, n in zip(ids.tolist(), links.tolist(), strict=True) if n]
            out += [(a, b, 0) for a, b in forest(ids[left].tolist(), ids[right].tolist())]
            if len(out) > 10_000:
                yield _frame(out)
                out = []
        yield _frame(out)

    return (tiles.select("_id", *keys, "_block", "_signature", "_text").repartition(*keys).sortWithinPartitions(*keys)
            .mapInPandas(verify, "a bigint, b bigint, n bigint"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.array([row[i] for row in rows], dtype="Int64") for i, name in enumerate("abn")})


def similarity_classes(df: DataFrame, key: str, text: str, *, words: int = WORDS, threshold: float = THRESHOLD,
                       tolerance: float = TOLERANCE) -> DataFrame:
    """Per row its key, ``class_id`` (smallest key of its class), ``n_links`` and ``n_copies``.

    ``n_links``: other texts that are at least ``threshold`` similar; ``n_copies``: rows of this very
    text. Null text: the empty text. Texts without words have no links, but equal ones are copies of
    each other. Texts of fewer than ``words`` words are compared as a whole. Repeated rows are copies;
    a null key sorts first. Texts of any length are read whole; a task holds those of two blocks, in a
    tile as their n-grams' hashes. An empty table gives an empty result. Other columns are ignored.
    """
    rows = keyed_texts(df, key, text)
    per_text = text_classes(rows, words, threshold, tolerance)
    return rows.select("_key", "_hash").join(per_text, "_hash").select(F.col("_key").alias(key), "class_id", "n_links", "n_copies")


def text_hash(text: str) -> Column:
    """What texts are told apart by."""
    return F.md5(text_or_empty(text))


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text`` and ``_hash`` of the rows."""
    return df.select(col(key).alias("_key"), text_or_empty(text).alias("_text"), text_hash(text).alias("_hash"))


def text_classes(rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per ``_hash`` of ``keyed_texts`` its ``class_id``, ``n_links``, ``n_copies``, and ``class_hash``.

    The class is represented by its row with the smallest key (``class_id``) and, among texts with that
    key, the smallest hash (``class_hash``); no two classes have the same hash.
    """
    @F.pandas_udf("binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([signature(shingles(x, words)) for x in batch], dtype=object)

    limits = fewest_matches(threshold, tolerance)
    order = F.struct(F.col("_key").isNotNull(), "_key")
    nodes = (rows.select("_hash", "_key", sign("_text").alias("_signature")).groupBy(F.col("_hash").alias("_node"))
             .agg(F.min(order)["_key"].alias("_first"), F.count(F.lit(1)).alias("_copies"),
                  F.first("_signature").alias("_signature")))
    nodes = written(nodes.withColumn("_id", F.monotonically_increasing_id()), "nodes")
    clusters = written(components(_tied_in_buckets(nodes, limits)), "clusters")
    found = written(_verified_in_tiles(rows, nodes, clusters, words, threshold, limits), "links")
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("n_links"))
    linked = written(shuffled(classes.withColumnRenamed("id", "_id").join(links, "_id"))
                     .join(nodes.select("_id", "_node", "_first"), "_id"), "linked")
    first = F.min(F.struct(F.col("_first").isNotNull(), "_first", "_node"))
    firsts = linked.groupBy("component").agg(first.alias("_f")).select(
        "component", F.col("_f._first").alias("class_id"), F.col("_f._node").alias("class_hash"))
    known = nodes.select("_node", "_first", "_copies").join(
        shuffled(linked.join(firsts, "component").select("_node", "class_id", "class_hash", "n_links", F.lit(True).alias("_in"))),
        "_node", "left")
    return written(known.select(
        F.col("_node").alias("_hash"), F.when(F.col("_in"), F.col("class_id")).otherwise(F.col("_first")).alias("class_id"),
        F.coalesce("class_hash", "_node").alias("class_hash"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("_copies").alias("n_copies")), "classes")
