"""A skipping index for word search: per file and column a Bloom filter of the trigrams of its search keys.

A file whose filter lacks a trigram of the word cannot hold the word and is not opened. The filters are rows
of 64 bits each, ``(path, column_name, block, bits)``, so building one is an aggregate that map tasks reduce
to at most ``BITS / 64`` rows per file and column, and a search reads only the blocks of its few trigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.naming import quoted
from snapledger.functions.text import search_key_of
from snapledger.operators.search import search
from snapledger.storage import file_path

#: Bits of a filter, and bits that a trigram sets in it.
BITS, HASHES = 1 << 17, 2
GRAM = 3


def grams(key: Column) -> Column:
    """The distinct trigrams of a search key; none of one that is shorter."""
    # A look-ahead finds overlapping ones in one pass; cutting them out one by one would count from the start each time.
    return F.array_distinct(F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _places(gram: Column) -> Column:
    value = F.xxhash64(gram)
    return F.array(*[F.pmod(F.shiftrightunsigned(value, 64 // HASHES * i), F.lit(BITS)) for i in range(HASHES)])


def _blocks(places: DataFrame, by: list[str]) -> DataFrame:
    """Places set in a filter as blocks of 64 bits."""
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    return places.groupBy(*by, F.floor(F.col("place") / 64).cast("int").alias("block")).agg(F.bit_or(bit).alias("bits"))


def text_index(rows: DataFrame, columns: list[str], suffix: str = "_search") -> DataFrame:
    """The filters of the files that ``rows`` is read from, over the stored keys of some columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(quoted(f"{name}{suffix}")).alias("key")) for name in columns])
    found = rows.select(file_path().alias("path"), F.inline(cells)).where("key IS NOT NULL")
    # Distinct per file before they are hashed: a file has few different trigrams, however long its texts.
    found = found.select("path", "column_name", F.explode(grams(F.col("key"))).alias("gram")).distinct()
    return _blocks(found.select("path", "column_name", F.explode(_places(F.col("gram"))).alias("place")), ["path", "column_name"])


def write_index(spark: SparkSession, data: str, columns: list[str], path: str, suffix: str = "_search") -> None:
    """Index the parquet files of a folder; sorted by block, so that a search skips most of the index as well."""
    rows = text_index(spark.read.parquet(data), columns, suffix)
    rows.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(path)


def candidate_files(index: DataFrame, word: str, columns: list[str]) -> DataFrame | None:
    """``path`` of the files that may hold the word in one of the columns; None if the index cannot tell."""
    key = search_key_of(word)
    if len(key) < GRAM:
        return None
    wanted = index.sparkSession.range(1).select(F.explode(grams(F.lit(key))).alias("gram"))
    # A few rows: one per block that a trigram of the word sets a bit of.
    needed = _blocks(wanted.select(F.explode(_places(F.col("gram"))).alias("place")), []).collect()
    held = F.lit(False)
    for row in needed:
        held = held | ((F.col("block") == row["block"]) & (F.col("bits").bitwiseAND(F.lit(row["bits"])) == F.lit(row["bits"])))
    return (index.where(F.col("column_name").isin(columns) & F.col("block").isin([row["block"] for row in needed]) & held)
            .groupBy("path", "column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(needed))
            .select("path").distinct())


def search_indexed(spark: SparkSession, data: str, index: str, word: str, columns: list[str], suffix: str = "_search") -> DataFrame:
    """`search` over the stored keys of a folder of parquet files, opening only files that may hold the word.

    Their names go through the driver, as those of any files that Spark reads. A word of less than three
    letters has no trigram, so all files are read.
    """
    every = spark.read.parquet(data)
    found = candidate_files(spark.read.parquet(index), word, columns)
    if found is not None:
        paths = [row["path"] for row in found.collect()]
        every = spark.read.schema(every.schema).option("basePath", data).parquet(*paths) if paths else every.limit(0)
    return search(every, word, columns, suffix)
