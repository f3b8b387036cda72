"""Data that several workloads derive from the given tables, in Spark and as SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.sources.csv import write_dumps
from snapledger.storage import scratch_dir
from snapledger.workloads import read

RUN_AT = datetime.datetime(2024, 1, 15, 12, 0, 0)

# Two states of the order book. The earlier one holds everything ordered before 2000. The later one
# starts in July 1996, and since then low-priority orders were written off and old pending ones closed.
OLD_ORDERS_SQL = """
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"""
NEW_ORDERS_SQL = """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'F'
                ELSE o_orderstatus END AS o_orderstatus,
           CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS DECIMAL(18,2))
               AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00'"""


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate") < timestamp("2000-01-01"))
    return orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= timestamp("1996-07-01"))
    closed = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < timestamp("1998-01-01"))
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return orders.withColumns({
        "o_orderstatus": F.when(closed, "F").otherwise(F.col("o_orderstatus")),
        "o_totalprice": price.cast("decimal(18,2)")})


def year_end_source(prefix: str, date: str = "o_orderdate") -> Column:
    """Dump name ``<prefix>_31_12_<year>``."""
    return F.concat(F.lit(f"{prefix}_31_12_"), F.year(date).cast("string"))


def dump_orders(spark: SparkSession, sf_dir: str, prefix: str = "shop", root: str | None = None,
                table: str = "orders") -> str:
    """Dump all orders into one source per order year."""
    root = root or scratch_dir(spark, "dumps")
    orders = read(spark, sf_dir, "orders")
    write_dumps(orders.withColumn("source", year_end_source(prefix)), root, table, "source")
    return root


def dump_customers(spark: SparkSession, sf_dir: str, root: str, source: str = "shop_31_12_2001",
                   table: str = "customer") -> str:
    customers = read(spark, sf_dir, "customer")
    write_dumps(customers.withColumn("source", F.lit(source)), root, table, "source")
    return root


def empty_dump(spark: SparkSession, root: str, source: str, table: str) -> None:
    """A dump file of zero bytes."""
    spark.range(0).select(F.col("id").cast("string").alias("value")).write.mode("append").text(
        f"{root}/source={source}/table={table}.csv")
