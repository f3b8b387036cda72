"""Search, filters, the query builder and derived columns."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.text import add_search_key
from snapledger.operators.filters import filter_rows
from snapledger.operators.reshape import derived_columns
from snapledger.operators.search import search, search_like
from snapledger.operators.textindex import search_indexed, write_index
from snapledger.plans.builder import build_query
from snapledger.sources.dataset import open_dataset
from snapledger.storage import scratch_dir
from snapledger.workloads import read, workload

_SEARCH = """
    WITH hits AS (SELECT doc_id, lang, text, contains(strip_accents(lower(text)), '{word}') AS t,
                         contains(strip_accents(lower(source)), '{word}') AS s FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN t THEN 'text' END, CASE WHEN s THEN 'source' END)
           AS matched_columns
    FROM hits WHERE t OR s"""


@workload("search_ci_ai", _SEARCH.format(word="etion"))
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(read(spark, sf_dir, "documents"), "ÉTION", ["text", "source"])
    return hits.select("doc_id", F.array_join("matched_columns", ",").alias("matched_columns"))


@workload("search_ci_ai_keyed", _SEARCH.format(word="eauou"))
def search_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys are stored with the data once; the search itself reads nothing but keys."""
    path = f"{scratch_dir(spark, 'keyed')}/documents.parquet"
    add_search_key(read(spark, sf_dir, "documents"), ["text", "source"]).write.parquet(path)
    hits = search(spark.read.parquet(path), "eauôu", ["text", "source"], key_suffix="_search")
    return hits.select("doc_id", F.array_join("matched_columns", ",").alias("matched_columns"))


@workload("search_indexed", _SEARCH.format(word="etion"))
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and trigram filters are written with the data; the search opens the files that may hold the word."""
    folder = scratch_dir(spark, "indexed")
    data, index = f"{folder}/documents.parquet", f"{folder}/index"
    rows = add_search_key(read(spark, sf_dir, "documents"), ["text", "source"])
    rows.repartitionByRange(16, "lang", "source").write.parquet(data)
    write_index(spark, data, ["text", "source"], index)
    hits = search_indexed(spark, data, index, "ÉTION", ["text", "source"])
    return hits.select("doc_id", F.array_join("matched_columns", ",").alias("matched_columns"))


@workload("search_principal", """
    SELECT c_custkey, c_name, c_mktsegment, concat_ws(',', CASE WHEN contains(lower(c_name), 'r#0000') THEN 'c_name' END,
           CASE WHEN contains(lower(c_mktsegment), 'r#0000') THEN 'c_mktsegment' END) AS matched_columns
    FROM customer WHERE contains(lower(c_name), 'r#0000') OR contains(lower(c_mktsegment), 'r#0000')""")
def search_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without named columns, what the mapping calls principal is searched."""
    mapping = {"id_fields": ["c_custkey"], "principal_fields": ["c_name", "c_mktsegment", "c_gone"]}
    hits = search(read(spark, sf_dir, "customer"), "R#0000", mapping=mapping)
    return hits.select("c_custkey", "c_name", "c_mktsegment", F.array_join("matched_columns", ",").alias("matched_columns"))


@workload("search_conversations", """
    SELECT conv_id, turn, role, 'text' AS matched_columns FROM conversations
    WHERE contains(strip_accents(lower(text)), 'etion')""")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(read(spark, sf_dir, "conversations"), "Étion")
    return hits.select("conv_id", "turn", "role",
                       F.array_join("matched_columns", ",").alias("matched_columns"))


@workload("search_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%w_dget%'")
def like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_like(read(spark, sf_dir, "part"), "p_name", "%red%w_dget%").select("p_partkey", "p_name")


@workload("filter_and_or", """
    SELECT * FROM lineitem
    WHERE (l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
           AND l_returnflag IN ('A', 'R') AND NOT (l_discount >= 0.05 OR l_quantity < 10))
       OR (l_linestatus = 'O' AND l_extendedprice > 90000 AND l_tax IS NOT NULL)""")
def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_rows(read(spark, sf_dir, "lineitem"), {"or": [
        {"and": [
            {"column": "l_shipdate", "op": "between",
             "value": [datetime.datetime(1996, 1, 1), datetime.datetime(1997, 12, 31)]},
            {"column": "l_returnflag", "op": "in", "value": ["A", "R"]},
            {"not": {"or": [{"column": "l_discount", "op": ">=", "value": 0.05},
                            {"column": "l_quantity", "op": "<", "value": 10}]}}]},
        {"and": [
            {"column": "l_linestatus", "op": "=", "value": "O"},
            {"column": "l_extendedprice", "op": ">", "value": 90000},
            {"column": "l_tax", "op": "is_not_null"}]}]})


@workload("built_query", """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, max(l_shipdate) AS last_shipped,
           CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
    FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00' AND l_tax >= 0.02
    GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    ORDER BY l_returnflag DESC, l_linestatus LIMIT 4""")
def built_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_query(open_dataset(spark, sf_dir), {
        "table": "lineitem",
        "derive": {"net": "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"},
        "filter": {"and": [{"column": "l_shipdate", "op": "<", "value": "2000-01-01"},
                           {"column": "l_tax", "op": ">=", "value": 0.02}]},
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggregates": {"n_lines": {"function": "count"},
                       "last_shipped": {"function": "max", "column": "l_shipdate"},
                       "revenue": {"function": "sum", "column": "net"}},
        "having": {"column": "n_lines", "op": ">", "value": 10},
        "sort": [["l_returnflag", "desc"], ["l_linestatus", "asc"]], "limit": 4})
    return built.withColumn("revenue", F.col("revenue").cast("double"))


@workload("derived_columns", """
    SELECT c_custkey, c_name, c_acctbal, c_acctbal < 0 AS in_debt,
           CASE WHEN c_acctbal < 0 THEN 'debt' ELSE lower(c_mktsegment) END AS category FROM customer""")
def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_columns(read(spark, sf_dir, "customer"), {
        "in_debt": "c_acctbal < 0",
        "category": "CASE WHEN in_debt THEN 'debt' ELSE lower(c_mktsegment) END"}).select(
        "c_custkey", "c_name", "c_acctbal", "in_debt", "category")
