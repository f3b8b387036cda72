"""Checks against declared schemas, keys and foreign keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators import rules
from snapledger.operators.present import default_view
from snapledger.operators.reshape import select_by_role
from snapledger.sources.config import read_config
from snapledger.sources.dataset import Dataset
from snapledger.storage import scratch_dir
from snapledger.workloads import read, workload

SCHEMAS = {"tables": {
    "orders": {"columns": {
        "o_orderkey": {"type": "INTEGER", "primary_key": True},
        "o_orderstatus": {"type": "TEXT", "nullable": False},
        "o_orderdate": {"type": "TIMESTAMP"},
        "o_orderpriority": {"type": "INTEGER"}}},
    "lineitem": {"columns": {
        "l_orderkey": {"type": "INTEGER", "primary_key": True},
        "l_linenumber": {"type": "INTEGER", "primary_key": True},
        "l_returnflag": {"type": "TEXT", "nullable": False}}}}}

RELATIONS = {"foreign_keys": {
    "lineitem": {"l_orderkey": {"references": "orders.o_orderkey", "on_delete": "CASCADE"},
                 "l_partkey": {"references": "part.p_partkey"}},
    "orders": {"o_custkey": {"references": "customer.c_custkey", "on_delete": "CASCADE"}}}}


def _flawed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Text orders with flaws: pending ones are gone, low priorities are numbers, 'O' is NULL."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    orders = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_custkey",
        F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "soon").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", "5").otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"))
    lines = read(spark, sf_dir, "lineitem").withColumn(
        "l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return {"orders": orders, "lineitem": lines, "part": read(spark, sf_dir, "part"),
            "customer": read(spark, sf_dir, "customer")}


_CONFORMANCE = """
    SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'INTEGER' AS declared_type,
           count(*) AS n_values, 0 AS n_failed FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'orders', 'o_orderstatus', 'TEXT', count(*) FILTER (o_orderstatus <> 'O'), 0
    FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'orders', 'o_orderdate', 'TIMESTAMP', count(*),
           count(*) FILTER (o_orderpriority = '1-URGENT') FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'orders', 'o_orderpriority', 'INTEGER', count(*),
           count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders WHERE o_orderstatus <> 'P'"""


@workload("schema_conformance", _CONFORMANCE)
def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = rules.declared_columns(SCHEMAS, "orders")
    return rules.schema_conformance(_flawed(spark, sf_dir)["orders"], "orders", columns)


@workload("apply_schema", """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_custkey,
           nullif(o_orderstatus, 'O') AS o_orderstatus,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS o_orderdate,
           CASE WHEN o_orderpriority = '5-LOW' THEN 5 END AS o_orderpriority
    FROM orders WHERE o_orderstatus <> 'P'""")
def apply_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_schema(_flawed(spark, sf_dir)["orders"], rules.declared_columns(SCHEMAS, "orders"))


_KEYS = """
    SELECT 'lineitem' AS table_name, 'not_null' AS rule, 'l_orderkey' AS column_name, 0 AS n_violations
    UNION ALL SELECT 'lineitem', 'not_null', 'l_linenumber', 0
    UNION ALL SELECT 'lineitem', 'not_null', 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'lineitem', 'primary_key', 'l_orderkey,l_linenumber',
           count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"""


@workload("pk_null_check", _KEYS)
def pk_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _flawed(spark, sf_dir)["lineitem"]
    return rules.null_and_key_check(lines, "lineitem", rules.declared_columns(SCHEMAS, "lineitem"))


@workload("select_by_role", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_by_role(read(spark, sf_dir, "customer"), {
        "id_fields": ["c_custkey"], "principal_fields": ["c_name", "c_mktsegment"],
        "metadata_fields": ["c_acctbal", "c_updated_at"]})


@workload("fk_orphans", """
    SELECT l_orderkey AS fk_value, count(*) AS n_rows FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    GROUP BY l_orderkey""")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return rules.orphan_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey")


@workload("fk_orphan_rows", """
    SELECT * FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return rules.orphan_rows(read(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey")


@workload("cascade_delete", """
    WITH c AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS d FROM customer),
    o AS (SELECT o_orderkey, d FROM orders JOIN c ON o_custkey = c_custkey),
    l AS (SELECT d FROM lineitem JOIN o ON l_orderkey = o_orderkey)
    SELECT 'customer' AS table_name, count(*) FILTER (d) AS n_deleted,
           count(*) FILTER (NOT d) AS n_kept FROM c
    UNION ALL SELECT 'orders', count(*) FILTER (d), count(*) FILTER (NOT d) FROM o
    UNION ALL SELECT 'lineitem', count(*) FILTER (d), count(*) FILTER (NOT d) FROM l""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: read(spark, sf_dir, name) for name in ("customer", "orders", "lineitem")}
    marked = rules.cascade_delete(tables, rules.foreign_keys(RELATIONS),
                                  {"customer": "c_mktsegment = 'BUILDING'"})
    return rules.cascade_summary(marked)


@workload("cascade_self", """
    WITH RECURSIVE boxes AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey - 1 END AS inside FROM part),
    gone AS (SELECT id FROM boxes WHERE id % 100 = 0 UNION SELECT b.id FROM boxes AS b JOIN gone AS g ON b.inside = g.id)
    SELECT id, inside, id IN (SELECT id FROM gone) AS deleted FROM boxes""")
def cascade_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside boxes, fifty deep: whatever is inside a deleted one falls."""
    key = F.col("p_partkey")
    boxes = read(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 50 != 0, key - 1).alias("inside"))
    keys = [rules.ForeignKey("boxes", "inside", "boxes", "id", "CASCADE")]
    return rules.cascade_delete({"boxes": boxes}, keys, {"boxes": "id % 100 = 0"})["boxes"]


@workload("declared_table", """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_custkey, nullif(o_orderstatus, 'O') AS o_orderstatus,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS o_orderdate,
           CASE WHEN o_orderpriority = '5-LOW' THEN 5 END AS o_orderpriority,
           year(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END) AS order_year,
           coalesce(o_orderpriority = '5-LOW', false) AS can_wait
    FROM orders WHERE o_orderstatus <> 'P'""")
def declared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types and the columns derived from them, both read from configuration files."""
    folder = f"{scratch_dir(spark, 'config')}"
    declared = {"tables": {"orders": {**SCHEMAS["tables"]["orders"], "derived": {
        "order_year": "year(o_orderdate)", "can_wait": "coalesce(o_orderpriority = 5, false)"}}}}
    spark.createDataFrame([(json.dumps(declared),)], "value string").coalesce(1).write.text(f"{folder}/schemas/orders.json")
    data = Dataset(spark, _flawed(spark, sf_dir), prefix="flawed_")
    return rules.declared_table(data, "orders", read_config(spark, folder))


@workload("default_view", """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def declared_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_view(read(spark, sf_dir, "orders"), {
        "visible_columns": ["o_totalprice", "o_orderkey", "o_orderstatus"],
        "column_order": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
        "sort_by": "o_orderkey", "sort_order": "DESC"})


@workload("validation_report", f"""
    WITH kept AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
    SELECT table_name, 'type' AS rule, column_name, n_failed AS n_violations FROM ({_CONFORMANCE})
    UNION ALL SELECT 'orders', 'not_null', 'o_orderkey', 0
    UNION ALL SELECT 'orders', 'not_null', 'o_orderstatus', count(*) FILTER (o_orderstatus = 'O') FROM kept
    UNION ALL SELECT 'orders', 'primary_key', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM kept
    UNION ALL SELECT 'lineitem', 'type', c, 0
        FROM (VALUES ('l_orderkey'), ('l_linenumber'), ('l_returnflag')) t(c)
    UNION ALL {_KEYS}
    UNION ALL SELECT 'lineitem', 'foreign_key', 'l_orderkey', count(*) FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM kept)
    UNION ALL SELECT 'lineitem', 'foreign_key', 'l_partkey', count(*) FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'orders', 'foreign_key', 'o_custkey', count(*) FROM kept
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flawed = Dataset(spark, _flawed(spark, sf_dir), prefix="flawed_")
    return rules.validation_report(flawed, SCHEMAS, RELATIONS)
