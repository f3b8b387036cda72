"""Comparing databases and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators import compare
from snapledger.operators.history import record_history, union_snapshots
from snapledger.sources.csv import read_table_dump, write_csv
from snapledger.sources.dataset import open_dataset
from snapledger.storage import scratch_dir
from snapledger.workloads import read, workload
from snapledger.workloads.catalogue import TABLES
from snapledger.workloads.fixtures import NEW_ORDERS_SQL, OLD_ORDERS_SQL, new_orders, old_orders

_COUNTED = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in TABLES)


@workload("compare_tables", f"""
    WITH l AS ({_COUNTED}),
    r AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
          UNION ALL SELECT 'customer', count(*) FROM customer
          UNION ALL SELECT 'returns', count(*) FROM lineitem WHERE l_returnflag = 'R')
    SELECT coalesce(l.table_name, r.table_name) AS table_name,
           CASE WHEN l.table_name IS NULL THEN 'only_right' WHEN r.table_name IS NULL THEN 'only_left'
                ELSE 'both' END AS presence, l.n AS left_rows, r.n AS right_rows
    FROM l FULL JOIN r ON l.table_name = r.table_name""")
def compare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = scratch_dir(spark, "other")
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    orders.write.parquet(f"{other}/orders.parquet")
    read(spark, sf_dir, "customer").write.orc(f"{other}/customer.orc")
    returns = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    returns.write.json(f"{other}/returns.json")
    return compare.compare_tables(open_dataset(spark, sf_dir),
                                  open_dataset(spark, other, prefix="other_"))


@workload("compare_schemas", """
    WITH l AS (SELECT column_name, data_type FROM duckdb_columns() WHERE table_name = 'lineitem'),
    r AS (SELECT 'l_' || name AS column_name, kind AS data_type FROM (
          SELECT 'orderkey' AS name, CASE WHEN bool_and(try_cast(l_orderkey AS BIGINT) IS NOT NULL)
                                          THEN 'BIGINT' ELSE 'VARCHAR' END AS kind FROM lineitem
          UNION ALL SELECT 'partkey', 'BIGINT' UNION ALL SELECT 'suppkey', 'BIGINT'
          UNION ALL SELECT 'linenumber', 'BIGINT' UNION ALL SELECT 'quantity', 'DOUBLE'
          UNION ALL SELECT 'extendedprice', 'DOUBLE' UNION ALL SELECT 'discount', 'DOUBLE'
          UNION ALL SELECT 'returnflag', 'VARCHAR' UNION ALL SELECT 'linestatus', 'VARCHAR'
          UNION ALL SELECT 'shipdate', 'DATE' UNION ALL SELECT 'net', 'DOUBLE'))
    SELECT coalesce(l.column_name, r.column_name) AS column_name,
           CASE WHEN l.column_name IS NULL THEN 'added' WHEN r.column_name IS NULL THEN 'removed'
                WHEN l.data_type <> r.data_type THEN 'retyped' ELSE 'same' END AS status,
           l.data_type AS left_type, r.data_type AS right_type
    FROM l FULL JOIN r ON l.column_name = r.column_name""")
def compare_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against its reload from a dump, whose types come from all the dumped values."""
    lines = read(spark, sf_dir, "lineitem")
    path = f"{scratch_dir(spark, 'export')}/lineitem.csv"
    write_csv(lines.drop("l_tax").withColumns({
        "l_shipdate": F.col("l_shipdate").cast("date"),
        "l_net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)}), path)
    return compare.compare_schemas(lines, read_table_dump(spark, [path]))


_COMPARED = f"""
    WITH l AS ({OLD_ORDERS_SQL}), r AS ({NEW_ORDERS_SQL}),
    rows AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey,
        CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed'
             WHEN (l.o_custkey, l.o_orderstatus, l.o_totalprice, l.o_orderdate, l.o_orderpriority)
                  IS DISTINCT FROM
                  (r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority)
             THEN 'changed' ELSE 'same' END AS status,
        CAST(CASE WHEN l.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_left,
        CAST(CASE WHEN r.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_right
        FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)"""


@workload("compare_rows", f"{_COMPARED} SELECT * FROM rows")
def compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_rows(old_orders(spark, sf_dir), new_orders(spark, sf_dir), ["o_orderkey"])


@workload("compare_summary", f"{_COMPARED} SELECT status, count(*) AS n_keys FROM rows GROUP BY status")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_summary(old_orders(spark, sf_dir), new_orders(spark, sf_dir), ["o_orderkey"])


@workload("compare_cells", f"""
    WITH l AS ({OLD_ORDERS_SQL}), r AS ({NEW_ORDERS_SQL}),
    pairs AS (SELECT l.o_orderkey, l.o_orderstatus AS s1, r.o_orderstatus AS s2,
                     CAST(l.o_totalprice AS VARCHAR) AS p1, CAST(r.o_totalprice AS VARCHAR) AS p2
              FROM l JOIN r ON l.o_orderkey = r.o_orderkey)
    SELECT o_orderkey, 'o_orderstatus' AS column_name, s1 AS old_value, s2 AS new_value, CAST(1 AS BIGINT) AS n_cells
    FROM pairs WHERE s1 <> s2
    UNION ALL SELECT o_orderkey, 'o_totalprice', p1, p2, 1 FROM pairs WHERE p1 <> p2""")
def compare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_cells(old_orders(spark, sf_dir), new_orders(spark, sf_dir), ["o_orderkey"])


@workload("compare_keyless", """
    WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
               WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY ALL),
    r AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
          WHERE l_shipdate >= TIMESTAMP '1996-07-01 00:00:00' GROUP BY ALL)
    SELECT coalesce(l.l_orderkey, r.l_orderkey) AS l_orderkey,
           coalesce(l.l_linenumber, r.l_linenumber) AS l_linenumber,
           CASE WHEN coalesce(r.n, 0) > coalesce(l.n, 0) THEN 'added' ELSE 'removed' END AS status,
           abs(coalesce(r.n, 0) - coalesce(l.n, 0)) AS n_copies
    FROM l FULL JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber
    WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def compare_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat: a line number occurs several times in an order."""
    old, new = _line_states(spark, sf_dir)
    return compare.compare_multiset(old, new, ["l_orderkey", "l_linenumber"])


def _line_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, sf_dir, "lineitem")
    old = lines.where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return old, lines.where(F.col("l_shipdate") >= F.lit("1996-07-01").cast("timestamp_ntz"))


@workload("compare_multiset", """
    WITH l AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00'),
    r AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-07-01 00:00:00'),
    surplus AS (SELECT *, 'removed' AS status FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
                UNION ALL
                SELECT *, 'added' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l))
    SELECT *, count(*) AS n_copies FROM surplus GROUP BY ALL""")
def compare_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_multiset(*_line_states(spark, sf_dir))


@workload("record_history", """
    WITH yearly AS (SELECT l_orderkey, make_date(year(l_shipdate), 12, 31) AS snapshot_date,
                           CAST(sum(l_quantity) AS BIGINT) AS quantity, max(l_shipdate) AS last_shipped
                    FROM lineitem GROUP BY ALL),
    steps AS (SELECT *, lag(quantity) OVER w AS q0, lag(last_shipped) OVER w AS s0,
                     row_number() OVER w AS rn
              FROM yearly WINDOW w AS (PARTITION BY l_orderkey ORDER BY snapshot_date))
    SELECT l_orderkey, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen,
           count(*) AS n_snapshots,
           count(*) FILTER (rn > 1 AND (q0 <> quantity OR s0 <> last_shipped)) AS n_changes
    FROM steps GROUP BY l_orderkey""")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each order per year in which lines of it were shipped."""
    yearly = read(spark, sf_dir, "lineitem").groupBy(
        "l_orderkey", F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)).alias("snapshot_date")).agg(
        F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("l_shipdate").alias("last_shipped"))
    return record_history(yearly, ["l_orderkey"])


@workload("union_snapshots", f"""
    WITH l AS ({OLD_ORDERS_SQL}), r AS ({NEW_ORDERS_SQL})
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate,
           o_orderpriority, NULL AS channel, DATE '2000-01-01' AS snapshot_date FROM l
    UNION ALL SELECT o_orderkey, NULL, o_orderstatus, CAST(o_totalprice AS DOUBLE), o_orderdate,
           o_orderpriority, 'web', DATE '2001-08-02' FROM r""")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = old_orders(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    new = new_orders(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    new = new.drop("o_custkey").withColumn("channel", F.lit("web"))
    return union_snapshots({"2000-01-01": old, "2001-08-02": new})


@workload("compare_types", """
    WITH l AS (SELECT o_orderkey, o_custkey + 9007199254740992 AS big, o_custkey % 100 AS small, CAST(o_orderdate AS DATE) AS day FROM orders),
    r AS (SELECT o_orderkey, CAST(o_custkey + 9007199254740992 AS DOUBLE) AS big,
                 CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey % 100 + 0.5 ELSE o_custkey % 100 END AS small,
                 CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 HOUR ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day
          FROM orders)
    SELECT o_orderkey, CASE WHEN l.big <> CAST(r.big AS HUGEINT) OR l.small <> r.small OR CAST(l.day AS TIMESTAMP) <> r.day
                            THEN 'changed' ELSE 'same' END AS status
    FROM l JOIN r USING (o_orderkey)""")
def compare_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose types differ, compared without loss: bigint and double, int and decimal, date and timestamp."""
    orders = read(spark, sf_dir, "orders")
    big, small, day = F.col("o_custkey") + 2 ** 53, (F.col("o_custkey") % 100).cast("int"), F.col("o_orderdate").cast("date")
    left = orders.select("o_orderkey", big.cast("bigint").alias("big"), small.alias("small"), day.alias("day"))
    half = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0.5")).otherwise(F.lit("0")).cast("decimal(2,1)")
    later = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).otherwise(day.cast("timestamp_ntz"))
    right = orders.select("o_orderkey", big.cast("double").alias("big"), (small + half).cast("decimal(8,2)").alias("small"),
                          later.cast("timestamp_ntz").alias("day"))
    return compare.compare_rows(left, right, ["o_orderkey"]).select("o_orderkey", "status")
