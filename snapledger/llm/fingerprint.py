"""Fingerprints of documents as sums of vectors, one vector hashed from each paragraph.

A fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**32. Sums do not depend
on the order of the paragraphs, and inserting or deleting one adds or subtracts its vector without
reading the rest. A paragraph's vector has three kinds of lanes:

* the number of its phrases (parts that end in punctuation),
* four lanes hashed from the whole paragraph, which tell unequal documents apart,
* 128 lanes, each the number of its phrases whose hash has a certain bit set. Taken as +1 and -1
  (twice the lane less the number of phrases) they are a random projection of the document's phrases,
  so scalar products of two fingerprints estimate how many phrases the documents share.

Two lanes lie in one long, so the running sums stay within 64 bits. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.llm.common import col, let, text_or_empty, written

#: Longs with two lanes of 32 bits each; two per bit of half a hash.
PACKED, HASHES = 32, 2
LOW = (1 << 32) - 1
BOTH_ONE = (1 << 32) + 1
PHRASE_END = r"\n+|(?<=\p{Punct})\s+"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def vector(text: Column) -> Column:
    """The fingerprint of a text: number of phrases, 4 identity lanes, 64 longs with 128 phrase lanes.

    Paragraphs are the non-empty lines. The empty text has the zero vector.
    """
    full = lambda x: F.length(x) > 0
    hashed = lambda parts, seed: F.transform(parts, lambda x: F.xxhash64(x, F.lit(seed)))

    def packed(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(PACKED - 1)), lambda bit: F.aggregate(
            hashes, _long(0), lambda total, h: total + F.call_function("shiftrightunsigned", h, bit).bitwiseAND(_long(BOTH_ONE))))

    def identity(hashes: Column) -> Column:
        half = lambda shift: F.aggregate(hashes, _long(0), lambda total, h: total + F.shiftrightunsigned(h, shift)
                                         .bitwiseAND(_long(LOW))).bitwiseAND(_long(LOW))
        return F.array(half(0), half(32))

    phrases = let(F.filter(F.split(text, PHRASE_END, -1), full), lambda parts: F.concat(
        F.array(F.size(parts).cast("long")), *[let(hashed(parts, seed), packed) for seed in range(HASHES)]))
    paragraphs = let(F.filter(F.split(text, "\n", -1), full), lambda parts: F.concat(
        *[let(hashed(parts, seed), identity) for seed in (101, 102)]))
    return let(phrases, lambda lanes: F.concat(F.slice(lanes, 1, 1), paragraphs, F.slice(lanes, 2, PACKED * HASHES)))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane by lane sum (``sign`` 1: paragraphs inserted) or difference (-1: deleted), modulo 2**32."""
    low, high = (lambda x: x.bitwiseAND(_long(LOW))), (lambda x: F.shiftrightunsigned(x, 32))
    return F.zip_with(a, b, lambda x, y: F.shiftleft(low(high(x) + sign * high(y)), 32)
                      .bitwiseOR(low(low(x) + sign * low(y))))


def digest(lanes: Column) -> Column:
    """The whole fingerprint as text: 16 hexadecimal digits a long."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _product(a: Column, b: Column) -> Column:
    """Scalar product of the phrase lanes taken as +1 and -1."""
    n, m = F.element_at(a, 1), F.element_at(b, 1)
    lanes = lambda x: F.slice(x, 6, PACKED * HASHES)
    low, high = (lambda x: x.bitwiseAND(_long(LOW))), (lambda x: F.shiftrightunsigned(x, 32))
    parts = F.zip_with(lanes(a), lanes(b), lambda x, y: (2 * low(x) - n).cast("double") * (2 * low(y) - m)
                       + (2 * high(x) - n).cast("double") * (2 * high(y) - m))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of phrases two documents have in common, from 0 to 1; 1 for equal fingerprints.

    Twice the scalar product over the sum of both squares, with a standard error of about 0.1.
    """
    squares = _product(a, a) + _product(b, b)
    return F.when(a == b, 1.0).when(squares == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * _product(a, b) / squares)))


def following(keys: DataFrame) -> DataFrame:
    """``_k``, ``_n`` and the next larger key ``_next`` (after the largest the smallest) of distinct keys.

    Keys are range-partitioned; the next one is looked up within a partition, and for its last key in
    the first keys of the partitions, which are as many as there are partitions.
    """
    placed = written(keys.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()), "keys")
    firsts = placed.groupBy("_part").agg(F.min("_k").alias("_first"))
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    lowest = placed.agg(F.min("_k").alias("_lowest"))
    within = placed.withColumn("_within", F.lead("_k").over(Window.partitionBy("_part").orderBy("_k")))
    return written(within.join(after, "_part").join(F.broadcast(lowest))
                   .select("_k", "_n", F.coalesce("_within", "_after", "_lowest").alias("_next")), "next-keys")


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text``, ``_chars``, ``_vector`` of every row, with ``_head`` and ``_next_vector`` of the next.

    ``_head`` is as much of the next text's beginning as half the row's text is long. Null text: the
    empty text. A null key sorts first. Rows with one key have the same next; if that key has several
    rows, the one whose beginning sorts first counts.
    """
    rows = df.select(F.struct(col(key).isNotNull().alias("known"), F.coalesce(col(key), F.lit(0)).alias("value")).alias("_k"),
                     text_or_empty(text).alias("_text"))
    keys = following(rows.groupBy("_k").agg(F.max(F.length("_text")).alias("_n")))
    full = rows.withColumn("_vector", vector(F.col("_text")))
    heads = (full.join(keys.select(F.col("_next").alias("_k"), F.col("_k").alias("_before"), "_n"), "_k")
             .select(F.col("_before").alias("_k"), F.struct(
                 F.substr("_text", F.lit(1), F.floor(F.col("_n") / 2).cast("int")).alias("_head"),
                 F.col("_vector").alias("_next_vector")).alias("_following"))
             .groupBy("_k").agg(F.min("_following").alias("_following")))
    return full.join(heads, "_k").select(
        F.when(F.col("_k.known"), F.col("_k.value")).alias("_key"), "_text", F.length("_text").alias("_chars"), "_vector",
        F.col("_following._head").alias("_head"), F.col("_following._next_vector").alias("_next_vector"))


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, ``n_chars``, fingerprints of the text and of an edited one, and likenesses.

    The edited text has its last half (rounded down, in code points) replaced by as much of the
    beginning of the next text by key. ``near_edited`` and ``near_next`` compare the fingerprint with
    those of the edited and of the next text. Texts of any length are read whole into vectors of one
    size. Repeated rows have equal results; an empty table gives an empty one; other columns are ignored.
    """
    half = F.floor(F.col("_chars") / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), F.col("_chars") - half), F.substr("_head", F.lit(1), half))
    return (with_next(df, key, text).withColumn("_edited", edited)
            .withColumn("_edited_vector", vector(F.col("_edited")))
            .select(F.col("_key").alias(key), F.col("_chars").cast("long").alias("n_chars"),
                    F.sha2("_edited", 256).alias("edited_sha256"), digest(F.col("_vector")).alias("fingerprint"),
                    digest(F.col("_edited_vector")).alias("edited_fingerprint"),
                    likeness(F.col("_vector"), F.col("_edited_vector")).alias("near_edited"),
                    likeness(F.col("_vector"), F.col("_next_vector")).alias("near_next")))
