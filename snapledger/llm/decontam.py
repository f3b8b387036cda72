"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

1. Windows. A window of an item's length can only be as similar as the threshold if enough of its
   n-grams are the benchmark's, whatever their order. Per document and item length, windows are laid
   at every start that has so many n-grams of items of that length. This loses no window that
   can match, wherever words were inserted, lost or moved.
2. Fingerprints. Every window and every item gets a SimHash of 128 bits of its n-grams, each counted as
   often as it occurs.
3. Search. The 128 bits are 8 blocks of 16. Two fingerprints within ``RADIUS`` = 31 bits agree in
   some block up to 3 bits (31 // 8), so items are filed under all values within 3 bits of each of
   their blocks, windows look up their 8 values, and no pair within the radius is missed. A pair
   at a similarity of 0.8 is beyond the radius with probability 0.002, at 0.85 below 0.0001.
4. Check. Pairs within the radius are kept if the weighted Jaccard similarity of their n-grams,
   as words and with multiplicities, reaches the threshold.

Everything is built-in functions. The benchmark's n-grams are broadcast in parts of at most
``PART`` rows, however large the benchmark is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, let, shuffled, text_or_empty, written

WORDS, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, RADIUS = 8, 16, 31
PART = 500_000


#: What stands between words: all ASCII characters but letters and digits.
BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words_of(text: Column) -> Column:
    """Words of a text, lower case, without ASCII punctuation."""
    return F.array_remove(F.split(F.lower(text), BETWEEN, -1), "")


def grams(words: Column, n: int, as_hash: bool = False) -> Column:
    """All word n-grams in order of a column of words, as text or as hashes; none for fewer words."""
    made = lambda i: F.slice(words, i, F.lit(n))
    one = (lambda i: F.xxhash64(made(i))) if as_hash else (lambda i: F.array_join(made(i), " "))
    kind = "array<bigint>" if as_hash else "array<string>"
    return F.when(F.size(words) < n, F.array().cast(kind)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), one))


def simhash(parts: Column, seed: int) -> Column:
    """64 bits, each the majority of that bit over the hashes of the parts."""
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long"))
    votes = lambda hashes, b: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + bit(h, b))
    return let(F.transform(parts, lambda x: F.xxhash64(x, F.lit(seed))), lambda hashes: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: out.bitwiseOR(
            F.call_function("shiftleft", F.when(2 * votes(hashes, b) > F.size(hashes), F.lit(1).cast("long"))
                            .otherwise(F.lit(0).cast("long")), b))))


def blocks(low: Column, high: Column) -> Column:
    """The fingerprint's blocks: number and value."""
    per = BLOCKS // 2
    return F.array(*[F.struct(F.lit(half * per + i).alias("block"), F.shiftrightunsigned(part, BLOCK_BITS * i).bitwiseAND(
        F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int").alias("value"))
        for half, part in enumerate((low, high)) for i in range(per)])


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two lists of n-grams counted with multiplicity."""
    times = lambda parts, x: F.size(F.filter(parts, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def benchmark_items(items: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """Items that have words: ``item``, ``words``, ``n`` and the size ``gram`` of their n-grams."""
    return (items.select(col(key).alias("item"), words_of(text_or_empty(text)).alias("words"))
            .withColumn("n", F.size("words")).where("n > 0")
            .withColumn("gram", F.least("n", F.lit(words))))


def starts(places: Column, total: Column, size: Column, threshold: float) -> Column:
    """Starts of windows of ``size`` n-grams that can reach the threshold, of a document of ``total`` n-grams.

    ``places``: sorted places of the document's n-grams that are the benchmark's. A whole window at the
    threshold has ``2 * threshold / (1 + threshold)`` of ``size`` of them, one that is cut at an edge of the
    document at least ``threshold``. Starts before the document are negative.
    """
    whole = lambda s: (s >= 0) & (s + size <= total)

    def having(share: float) -> Column:
        least = F.greatest(F.lit(1), F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int"))
        return let(least, lambda k: F.flatten(F.transform(F.filter(F.zip_with(
            F.slice(places, F.lit(1), F.greatest(F.lit(0), F.size(places) - k + 1)),
            F.slice(places, k, F.size(places)), lambda first, last: F.struct(first.alias("first"), last.alias("last"))),
            lambda x: x["last"] - x["first"] < size), lambda x: F.sequence(x["last"] - size + 1, x["first"]))))

    cut = F.filter(F.array_distinct(having(threshold)), lambda s: ~whole(s))
    return F.concat(F.filter(F.array_distinct(having(2 * threshold / (1 + threshold))), whole), cut)


def windows(documents: DataFrame, items: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    """``key``, ``hash``, ``start``, ``length`` (in words) of the windows laid in documents (``key``, ``text``)."""
    found = None
    for size in sizes:
        filed = written(items.where(F.col("gram") == size).select(
            "n", F.explode(grams(F.col("words"), size, True)).alias("h")).distinct(), "benchmark-grams")
        parts = filed.count() // PART + 1
        placed = (documents.select("key", F.xxhash64("text").alias("hash"),
                                   let(words_of(F.col("text")), lambda words: grams(words, size, True)).alias("all"))  # noqa: B023
                  .select("key", "hash", F.size("all").alias("total"), F.posexplode("all").alias("i", "h")))
        hits = None
        for part in range(parts):
            some = filed.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part) if parts > 1 else filed
            more = placed.join(F.broadcast(some), "h").select("key", "hash", "total", "n", "i")
            hits = more if hits is None else hits.union(more)
        per_length = (hits.groupBy("key", "hash", "total", "n").agg(F.sort_array(F.collect_set("i")).alias("places"))
                      .select("key", "hash", "n", F.explode(starts(F.col("places"), F.col("total"), F.col("n") - size + 1,
                                                                   threshold)).alias("s")))
        laid = per_length.select("key", "hash", F.greatest(F.lit(0), F.col("s")).alias("start"),
                                 (F.col("n") + F.least(F.lit(0), F.col("s"))).alias("length"))
        found = laid if found is None else found.union(laid)
    return found.distinct()


def leaks(documents: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str,
          words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``item``, ``similarity``, ``start``, ``length`` of the best window of each document and item that match.

    Words are compared in lower case and without ASCII punctuation. An item of fewer than ``words`` words
    counts as one n-gram; items without words match nothing, nor do null or empty documents. Windows
    at a document's edge are cut there. Rows of one key are one document here: the best of them
    counts; rows without a key are one document too. Texts of any length are read whole, a text's words
    being one array. No items or no documents: an empty result. Other columns are ignored.
    """
    best = F.max(F.struct("similarity", -F.col("start"), F.col("length"))).alias("best")
    found = matches(documents, items, key=key, text=text, item_key=item_key, item_text=item_text, words=words,
                    threshold=threshold)
    return (found.groupBy("key", "item").agg(best)
            .select("key", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start"),
                    F.col("best.length").alias("length")))


def text_hash(text: str) -> Column:
    """What texts of one key are told apart by."""
    return F.xxhash64(text_or_empty(text))


def matches(documents: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str,
            words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """As ``leaks``, but all windows that match, with the ``hash`` of the text that they stand in."""
    rows = documents.select(col(key).alias("key"), text_or_empty(text).alias("text"))
    known = written(benchmark_items(items, item_key, item_text, words), "benchmark")
    sizes = sorted(r[0] for r in known.select("gram").distinct().collect())
    gram = lambda words, n: F.coalesce(*[F.when(n == size, grams(words, size)) for size in sizes])
    if not sizes:
        return rows.select("key", text_hash("text").alias("hash"), F.lit(None).cast(dict(items.dtypes)[item_key]).alias("item"), F.lit(0.0).alias("similarity"),
                           F.lit(0).alias("start"), F.lit(0).alias("length")).where(F.lit(False))
    laid = written(windows(rows, known, sizes, threshold), "windows")
    read = (rows.withColumn("hash", text_hash("text")).join(shuffled(laid.withColumnsRenamed({"key": "k", "hash": "h"})),
                                                             F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")))
            .select("key", "hash", "start", F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("length")).alias("words"))
            .withColumn("length", F.size("words")).withColumn("parts", gram(F.col("words"), F.least("length", F.lit(words)))))
    signed = written(read.select("key", "hash", "start", "length", "parts", simhash(F.col("parts"), 1).alias("low"),
                                 simhash(F.col("parts"), 2).alias("high")), "window-fingerprints")
    filed = known.withColumn("item_parts", gram(F.col("words"), F.col("gram")))
    filed = written(filed.select("item", "item_parts", simhash(F.col("item_parts"), 1).alias("item_low"),
                                 simhash(F.col("item_parts"), 2).alias("item_high")), "item-fingerprints")
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    # An item has as many index entries as there are values near its blocks; written, so that Spark knows how many
    # that is before it picks a join.
    index = written(filed.repartition("item").select("*", F.explode(blocks(F.col("item_low"), F.col("item_high"))).alias("b"))
             .select("item", "item_low", "item_high", "b.block", F.explode(F.transform(
                 near, lambda x: x.bitwiseXOR(F.col("b.value")))).alias("value")), "item-index")
    # Windows with equal n-grams, as copies have, are searched once.
    distinct = signed.select("low", "high").distinct()
    pairs = (distinct.select("low", "high", F.explode(blocks(F.col("low"), F.col("high"))).alias("b"))
             .select("low", "high", "b.*").join(index, ["block", "value"])
             .where(distance(("low", "high"), ("item_low", "item_high")) <= RADIUS)
             .select("low", "high", "item").distinct())
    return (signed.join(written(pairs, "near-pairs"), ["low", "high"]).join(filed.select("item", "item_parts"), "item")
            .withColumn("similarity", weighted_jaccard(F.col("parts"), F.col("item_parts")))
            .where(F.col("similarity") >= threshold).select("key", "hash", "item", "similarity", "start", "length"))
