"""Opening, listing, describing and viewing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators.present import display_rows, row_keys, rows_as_json
from snapledger.sources.dataset import open_dataset
from snapledger.workloads import read, workload

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
          "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@workload("open_dataset", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in TABLES))
def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the folder, opened and counted."""
    return open_dataset(spark, sf_dir).row_counts()


@workload("list_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) > 0 AS has_rows FROM {name}" for name in TABLES))
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = open_dataset(spark, sf_dir)
    counts = dataset.row_counts().select("table_name", (F.col("row_count") > 0).alias("has_rows"))
    return dataset.list_tables().join(counts, "table_name", "left")


def _described_sql(table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {i} AS position, '{name}' AS column_name, "
        f"'{kind}' AS column_type, 'YES' AS is_nullable, count({name}) AS n_filled FROM {table}"
        for i, (name, kind) in enumerate(columns))


# The columns of the given tables, as a catalogue shows them.
COLUMNS = {
    "benchmark": "item_id BIGINT, text VARCHAR",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, "
                "l_shipdate TIMESTAMP",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
              "o_orderpriority VARCHAR",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
}


@workload("table_schema", " UNION ALL ".join(
    _described_sql(table, [tuple(c.split(" ")) for c in columns.split(", ")]) for table, columns in COLUMNS.items()))
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every table from the metadata, with how many values each of them holds."""
    dataset = open_dataset(spark, sf_dir)
    return functools.reduce(DataFrame.unionByName, [
        dataset.describe(name).join(dataset.filled_counts(name), ["table_name", "column_name"]) for name in COLUMNS])


@workload("preview_table", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def preview_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_dataset(spark, sf_dir).preview("orders", order_by=["o_orderdate", "o_orderkey"])


@workload("row_count", "SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_dataset(spark, sf_dir).count("lineitem")


_ADHOC = """
    SELECT n_name, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = {segment} AND o_totalprice > {price}
    GROUP BY n_name"""


@workload("adhoc_sql", _ADHOC.format(segment="'BUILDING'", price="100000"))
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _ADHOC.format(segment=":segment", price=":price")
    return open_dataset(spark, sf_dir).sql(query, segment="BUILDING", price=100000)


@workload("display_rows", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') AS status,
           coalesce(CAST(CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS VARCHAR), '')
               AS o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_totalprice * 1000 AS VARCHAR) AS thousandfold,
           o_orderpriority FROM orders""")
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display_rows(read(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"),
        F.col("o_orderdate").cast("date").alias("ordered_on"), "o_totalprice",
        (F.col("o_totalprice") * 1000).alias("thousandfold"), "o_orderpriority"))


@workload("rows_as_json", """
    SELECT concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_nationkey":', c_nationkey,
                  ',"c_mktsegment":', coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null'),
                  ',"c_acctbal":', c_acctbal, '}') AS row_json FROM customer""")
def as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_as_json(read(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_acctbal"))


@workload("row_keys", """
    WITH keyed AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' || o_orderkey
                          ELSE '' END AS UNIQID,
                          CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey END AS id FROM orders
                   ORDER BY o_orderkey LIMIT 100)
    SELECT *, coalesce(nullif(UNIQID, ''), CAST(nullif(id, 0) AS VARCHAR),
                       'orders_' || (row_number() OVER (ORDER BY o_orderkey) - 1)) AS row_key FROM keyed""")
def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(F.lit("U"), F.col("o_orderkey").cast("string"))).otherwise("").alias("UNIQID"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(F.col("o_orderkey")).alias("id"))
    return row_keys(orders, "orders", ["o_orderkey"])


@workload("view_summary", """
    SELECT 'documents' AS table_name, least(100, count(*)) AS shown, count(*) AS total,
           'Showing ' || least(100, count(*)) || ' of ' || count(*) || ' rows' AS summary FROM documents""")
def view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_dataset(spark, sf_dir).view_summary("documents")
