"""Sources, ingest and sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.naming import (date_text_compat, sanitize_name, snapshot_date,
                                         snapshot_table_name)
from snapledger.functions.types import type_profile
from snapledger.operators.reshape import columns_to_rows, is_ragged
from snapledger.plans import load, log
from snapledger.plans.accounting import load_accounting as account
from snapledger.plans.load import LoadOptions, batch_import, open_snapshots
from snapledger.sources.csv import (load_as_text, read_table_dump, write_csv,
                                    write_dumps)
from snapledger.sources.discover import (discover_sources, list_source_tables, newest, pick_subset)
from snapledger.sources.dataset import open_dataset
from snapledger.storage import scratch_dir
from snapledger.streaming.incremental import import_new
from snapledger.workloads import read, workload
from snapledger.workloads.fixtures import (RUN_AT, dump_customers, dump_orders, empty_dump,
                                           year_end_source)


@workload("discover_sources", """
    SELECT 'shop_31_12_' || year(o_orderdate) AS source_file, 'orders' AS table_name, true AS has_bytes
    FROM orders GROUP BY ALL""")
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = discover_sources(spark, dump_orders(spark, sf_dir))
    return files.groupBy("source_file", "table_name").agg((F.sum("length") > 0).alias("has_bytes"))


@workload("list_source_tables", """
    SELECT 'shop_31_12_' || year(o_orderdate) AS source_file, 'orders' AS table_name
    FROM orders GROUP BY ALL
    UNION SELECT 'shop_31_12_2001', 'customer' FROM customer""")
def source_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = dump_customers(spark, sf_dir, dump_orders(spark, sf_dir))
    return list_source_tables(discover_sources(spark, root)).select("source_file", "table_name")


@workload("latest_source", """
    SELECT 'shop_31_12_' || max(year(o_orderdate)) AS source_file FROM orders""")
def latest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest dump by the date in its name; copies written together share their file time."""
    files = discover_sources(spark, dump_orders(spark, sf_dir))
    dated = files.withColumn("snapshot_date", snapshot_date("source_file"))
    return newest(dated, ["snapshot_date", "modified_at", "path"]).select("source_file")


@workload("latest_snapshot", """
    SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_custkey"])


def _dump_names(orders: DataFrame) -> DataFrame:
    """A file name per order, its date in a form that depends on the priority."""
    def date(pattern: str):
        return F.date_format("o_orderdate", pattern)

    name = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("dump_"), date("dd_MM_yyyy")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("db "), date("yyyy-MM-dd")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("x"), date("ddMMyyyy")))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("x"), date("yyyyMMdd")))
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit("m_"), date("dd-MM_yyyy")))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("a_32_13_"), date("yyyy"), F.lit("_x_"),
                                                          date("yyyy-MM-dd")))
            .otherwise(F.lit("none")))
    return orders.select("o_orderkey", F.concat(name, F.lit(".bak")).alias("file_name"))


_NAMES_SQL = """
    names AS (SELECT o_orderkey, concat(CASE
        WHEN o_orderpriority = '1-URGENT' THEN 'dump_' || strftime(o_orderdate, '%d_%m_%Y')
        WHEN o_orderpriority = '2-HIGH' THEN 'db ' || strftime(o_orderdate, '%Y-%m-%d')
        WHEN o_orderpriority = '3-MEDIUM' THEN 'x' || strftime(o_orderdate, '%d%m%Y')
        WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'x' || strftime(o_orderdate, '%Y%m%d')
        WHEN o_orderstatus = 'F' THEN 'm_' || strftime(o_orderdate, '%d-%m_%Y')
        WHEN o_orderstatus = 'O' THEN 'a_32_13_' || strftime(o_orderdate, '%Y') || '_x_'
                                       || strftime(o_orderdate, '%Y-%m-%d')
        ELSE 'none' END, '.bak') AS file_name FROM orders)"""


@workload("snapshot_date_lenient", f"""
    WITH {_NAMES_SQL}
    SELECT o_orderkey, file_name, CASE
               WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%m%d-')
                    || strftime(o_orderdate, '%Y')[3:4] || '-' || strftime(o_orderdate, '%Y')[1:2]
               WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-13-32')
               WHEN o_orderpriority <> '5-LOW' OR o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
           END AS compat_text,
           CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus NOT IN ('F', 'O') THEN DATE '1900-01-01'
                ELSE CAST(o_orderdate AS DATE) END AS snapshot_date
    FROM names JOIN orders USING (o_orderkey)""")
def date_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump_names(read(spark, sf_dir, "orders")).select(
        "o_orderkey", "file_name", date_text_compat("file_name").alias("compat_text"),
        snapshot_date("file_name", default="1900-01-01").alias("snapshot_date"))


@workload("snapshot_date_strict", f"""
    WITH {_NAMES_SQL}, hits AS (SELECT *,
        regexp_replace(regexp_extract(file_name, '\\d{{2}}_\\d{{2}}_\\d{{4}}'),
            '(..).(..).(....)', '\\3-\\2-\\1') AS t1,
        regexp_replace(regexp_extract(file_name, '\\d{{4}}_\\d{{2}}_\\d{{2}}'),
            '(....).(..).(..)', '\\1-\\2-\\3') AS t2,
        regexp_replace(regexp_extract(file_name, '\\d{{2}}-\\d{{2}}-\\d{{4}}'),
            '(..).(..).(....)', '\\3-\\2-\\1') AS t3,
        regexp_extract(file_name, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS t4 FROM names)
    SELECT o_orderkey, file_name, coalesce(try_cast(t1 AS DATE), try_cast(t2 AS DATE),
           try_cast(t3 AS DATE), try_cast(t4 AS DATE)) AS snapshot_date
    FROM hits""")
def date_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump_names(read(spark, sf_dir, "orders")).select(
        "o_orderkey", "file_name", snapshot_date("file_name", mode="strict").alias("snapshot_date"))


@workload("csv_roundtrip_orders", "SELECT * FROM orders")
def roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'export')}/orders.csv"
    write_csv(read(spark, sf_dir, "orders"), path)
    return read_table_dump(spark, [path])


@workload("csv_roundtrip_documents", "SELECT * FROM documents")
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line ends inside come back as they were."""
    path = f"{scratch_dir(spark, 'export')}/documents.csv"
    write_csv(read(spark, sf_dir, "documents"), path)
    return read_table_dump(spark, [path])


def _order_lines(orders: DataFrame, *more: Column) -> DataFrame:
    """CSV lines of orders, those of pending ones malformed: fields short or a field too many."""
    fields = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"),
              F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")]
    line = F.concat_ws(",", *fields)
    pending = F.col("o_orderstatus") == "P"
    return orders.select(
        *[c.alias("source") for c in more],
        F.when(pending & (F.col("o_orderpriority") < "3"), F.concat(F.lit("bad,"), F.col("o_orderpriority")))
        .when(pending, F.concat(line, F.lit(",surplus"))).otherwise(line).alias("value"))


@workload("csv_load_typed", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders WHERE o_orderstatus <> 'P'""")
def csv_load_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed rows are left out, and what is left decides the types."""
    path = _written_lines(spark, _order_lines(read(spark, sf_dir, "orders")))
    return read_table_dump(spark, [path])


def _written_lines(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of CSV files, each starting with the header."""
    path = f"{scratch_dir(spark, 'lines')}/orders.csv"
    header = "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate"
    lines.select(F.col("value").alias(header)).write.options(
        header=True, quote="", sep="\u0001", escape="").csv(path)
    return path


@workload("csv_load_failfast", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders""")
def csv_load_failfast(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"))
    path = f"{scratch_dir(spark, 'export')}/orders.csv"
    write_csv(orders, path)
    return read_table_dump(spark, [path], mode="fail")


_LINE_TEXTS = {
    **{name: f"CAST({name} AS VARCHAR)" for name in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                     "l_extendedprice", "l_discount", "l_tax")},
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": "strftime(l_shipdate, '%Y-%m-%d')",
    "is_returned": "CAST(l_returnflag = 'R' AS VARCHAR)", "shipped_at": "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')",
    "zip": "lpad(CAST(l_suppkey AS VARCHAR), 6, '0')", "serial": "'9' || lpad(CAST(l_orderkey AS VARCHAR), 19, '0')"}


@workload("infer_types", f"""
    WITH texts AS ({" UNION ALL ".join(f"SELECT '{name}' AS column_name, {value} AS v FROM lineitem" for name, value in _LINE_TEXTS.items())}),
    counts AS (SELECT column_name, count(v) AS n_values,
        count(CASE WHEN lower(v) IN ('true', 'false') THEN 1 END) AS n_boolean,
        count(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') AND NOT regexp_matches(v, '^[+-]?0[0-9]') THEN try_cast(v AS BIGINT) END) AS n_bigint,
        count(CASE WHEN v NOT LIKE '%-%' AND v NOT LIKE '%:%' AND lower(v) NOT IN ('true', 'false') AND NOT regexp_matches(v, '^[+-]?0[0-9]')
                   AND NOT (regexp_full_match(v, '[+-]?[0-9]+') AND length(v) > 15) THEN try_cast(v AS DOUBLE) END) AS n_double,
        count(CASE WHEN length(v) = 10 AND v LIKE '%-%' THEN try_cast(v AS DATE) END) AS n_date,
        count(CASE WHEN length(v) >= 10 AND v LIKE '%-%' THEN try_cast(v AS TIMESTAMP) END) AS n_timestamp_ntz
        FROM texts GROUP BY column_name)
    SELECT *, CASE n_values WHEN n_boolean THEN 'boolean' WHEN n_bigint THEN 'bigint'
                            WHEN n_double THEN 'double' WHEN n_date THEN 'date'
                            WHEN n_timestamp_ntz THEN 'timestamp_ntz' ELSE 'string' END AS inferred_type
    FROM counts""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the lines as a dump has them, and identifiers: zero-padded, and of twenty digits."""
    lines = read(spark, sf_dir, "lineitem")
    return type_profile(load_as_text(lines.withColumns({
        "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"), "is_returned": F.col("l_returnflag") == "R",
        "shipped_at": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "zip": F.lpad(F.col("l_suppkey").cast("string"), 6, "0"),
        "serial": F.concat(F.lit("9"), F.lpad(F.col("l_orderkey").cast("string"), 19, "0"))})))


@workload("load_as_varchar", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice
    FROM orders""")
def load_as_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_as_text(read(spark, sf_dir, "orders"))


@workload("sanitize_names", """
    WITH names AS (SELECT p_partkey AS id, p_size || ' ' || p_name || '/' || p_brand AS name FROM part
                   UNION ALL SELECT page_id, url FROM pages),
    clean AS (SELECT *, regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') AS c FROM names)
    SELECT id, name, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'T_' || c ELSE c END AS clean FROM clean""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("/"), "p_brand").alias("name"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    return parts.unionByName(pages).withColumn("clean", sanitize_name("name"))


@workload("snapshot_names", """
    SELECT 'orders_' || strftime(o_orderdate, '%Y%m%d') AS snapshot_name, count(*) AS n_rows
    FROM orders GROUP BY ALL""")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "orders").select(
        snapshot_table_name(F.lit("orders"), F.col("o_orderdate")).alias("snapshot_name"))
    return named.groupBy("snapshot_name").agg(F.count(F.lit(1)).alias("n_rows"))


def _rival_dumps(spark: SparkSession, sf_dir: str) -> str:
    """Two sources per year end: 'a' with the orders as they are, 'b' with all of them closed."""
    root = dump_orders(spark, sf_dir, "a")
    closed = read(spark, sf_dir, "orders").withColumn("o_orderstatus", F.lit("C"))
    write_dumps(closed.withColumn("source", year_end_source("b")), root, "orders", "source")
    return root


@workload("load_first_wins", """
    SELECT *, make_date(year(o_orderdate), 12, 31) AS snapshot_date FROM orders""")
def load_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store = _rival_dumps(spark, sf_dir), scratch_dir(spark, "store")
    batch_import(spark, root, store, RUN_AT)
    # Loading the same tree again finds every date taken.
    batch_import(spark, root, store, RUN_AT + datetime.timedelta(days=1))
    return open_snapshots(spark, store, "orders")


@workload("load_replace", """
    SELECT * REPLACE ('C' AS o_orderstatus), make_date(year(o_orderdate), 12, 31) AS snapshot_date
    FROM orders""")
def load_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "store")
    batch_import(spark, dump_orders(spark, sf_dir, "a"), store, RUN_AT)
    batch_import(spark, _rival_dumps(spark, sf_dir), store, RUN_AT + datetime.timedelta(days=1),
                 LoadOptions(on_conflict="replace"))
    return open_snapshots(spark, store, "orders")


DECLARED = {"tables": {"orders": {"columns": {
    "o_orderkey": {"type": "INTEGER"}, "o_totalprice": {"type": "DECIMAL(12,2)"}, "o_orderdate": {"type": "TIMESTAMP"},
    "o_orderpriority": {"type": "INTEGER"}}}}}


@workload("load_declared", """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_custkey, o_orderstatus,
           CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS o_totalprice, o_orderdate,
           CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 5 END AS INTEGER) AS o_orderpriority,
           make_date(year(o_orderdate), 12, 31) AS snapshot_date,
           'values not of the declared type, in all sources of this load: o_orderpriority: '
           || (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS message
    FROM orders""")
def load_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns get their declared types at load, the others inferred ones; misfits are NULL and counted in the log."""
    root, store = scratch_dir(spark, "dumps"), scratch_dir(spark, "store")
    low = F.when(F.col("o_orderpriority") == "5-LOW", "5").otherwise(F.col("o_orderpriority"))
    write_dumps(read(spark, sf_dir, "orders").withColumns({"o_orderpriority": low, "source": year_end_source("shop")}), root, "orders", "source")
    run = batch_import(spark, root, store, RUN_AT, LoadOptions(schemas=DECLARED))
    return open_snapshots(spark, store, "orders").join(run.select(F.col("file_date").alias("snapshot_date"), "message"), "snapshot_date")


@workload("load_full_refresh", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def load_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'refresh')}/orders.parquet"
    orders = read(spark, sf_dir, "orders")
    load.full_refresh(orders, path)
    load.full_refresh(orders.where("o_orderstatus = 'F'"), path)
    load.load_if_absent(orders, path)
    return spark.read.parquet(path)


@workload("load_subset", """
    SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, 'FOUND' AS note FROM customer
    UNION ALL SELECT 'orders', count(*), 'FOUND' FROM orders
    UNION ALL SELECT 'returns', NULL, 'EMPTY'
    UNION ALL SELECT 'refunds', NULL, 'MISSING'""")
def load_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store = dump_customers(spark, sf_dir, dump_orders(spark, sf_dir)), scratch_dir(spark, "store")
    dump_customers(spark, sf_dir, root, table="unwanted")
    empty_dump(spark, root, "shop_31_12_2001", "returns")
    wanted = ("customer", "orders", "returns", "refunds")
    run = batch_import(spark, root, store, RUN_AT, LoadOptions(tables=wanted))
    rows = run.groupBy(F.col("base_table").alias("table_name")).agg(
        F.sum(F.when(F.col("status") == log.LOADED, F.col("row_count"))).alias("n_rows"))
    found = pick_subset(list_source_tables(discover_sources(spark, root)), list(wanted))
    return found.join(rows, "table_name", "left").select("table_name", "n_rows", "note")


_LOG_SQL = """
    SELECT 'shop_31_12_' || year(o_orderdate) AS source_file,
           make_date(year(o_orderdate), 12, 31) AS file_date,
           'orders_' || year(o_orderdate) || '1231' AS table_name,
           CAST(count(*) AS BIGINT) AS row_count, year(o_orderdate) || '1231' AS date_suffix, 'OK' AS status
    FROM orders GROUP BY year(o_orderdate)
    UNION ALL SELECT 'shop_31_12_2001', DATE '2001-12-31', 'customer_20011231', count(*), '20011231', 'OK'
    FROM customer"""


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    root, store = dump_customers(spark, sf_dir, dump_orders(spark, sf_dir)), scratch_dir(spark, "store")
    return batch_import(spark, root, store, RUN_AT), store


@workload("import_log", f"""
    WITH entries AS ({_LOG_SQL})
    SELECT row_number() OVER (ORDER BY source_file, table_name) AS import_id, *,
           TIMESTAMP '2024-01-15 12:00:00' AS import_timestamp FROM entries""")
def import_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, _ = _imported(spark, sf_dir)
    return run.select("import_id", "source_file", "file_date", "table_name", "row_count",
                      "date_suffix", "status", "import_timestamp")


@workload("load_status", """
    SELECT 'shop_31_12_' || year(o_orderdate) AS source_file, 'orders' AS base_table,
           CAST(count(*) AS BIGINT) AS row_count, 'OK' AS status FROM orders GROUP BY year(o_orderdate)
    UNION ALL SELECT 'shop_31_12_2001', 'returns', 0, 'EMPTY'
    UNION ALL SELECT 'shop_32_13_2001', 'customer', NULL, 'ERROR'
    UNION ALL SELECT 'shop_undated', 'customer', NULL, 'ERROR'
    UNION ALL SELECT 'tally_31_12_2001', 'orders', NULL, 'SKIPPED_EXISTS'""")
def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in which tables load, are empty, have no usable date or come second."""
    root, store = dump_orders(spark, sf_dir), scratch_dir(spark, "store")
    dump_customers(spark, sf_dir, root, "shop_32_13_2001")
    dump_customers(spark, sf_dir, root, "shop_undated")
    dump_customers(spark, sf_dir, root, "tally_31_12_2001", table="orders")
    empty_dump(spark, root, "shop_31_12_2001", "returns")
    run = batch_import(spark, root, store, RUN_AT)
    return run.select("source_file", "base_table", "row_count", "status")


def _dump_lines(lines: DataFrame, root: str, table: str) -> None:
    """Dump files of ready-made lines: columns ``source`` and one named as the header."""
    (lines.withColumn("table", F.lit(f"{table}.csv")).write.mode("append").partitionBy("source", "table")
     .options(header=True, quote="", sep="\u0001", escape="", lineSep="\n").csv(root))


ORDER_HEADER = "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate"


@workload("load_accounting", """
    WITH orders_by AS (SELECT year(o_orderdate) AS y, o_orderstatus = 'P' AS bad FROM orders)
    SELECT 'shop_31_12_' || y AS source_file, 'orders' AS table_name, 'OK' AS status, CAST(count(*) AS BIGINT) AS n_records,
           CAST(count(*) FILTER (NOT bad) AS BIGINT) AS n_loaded, CAST(count(*) FILTER (bad) AS BIGINT) AS n_dropped,
           CAST(0 AS BIGINT) AS n_failed, CAST(0 AS BIGINT) AS n_not_taken, CAST(0 AS BIGINT) AS n_unaccounted
    FROM orders_by GROUP BY y
    UNION ALL SELECT 'tally_31_12_' || y, 'orders', 'SKIPPED_EXISTS', count(*), 0, 0, 0, count(*), 0 FROM orders_by GROUP BY y
    UNION ALL SELECT 'shop_31_12_2001', 'customer', 'OK', count(*), count(*), 0, 0, 0, 0 FROM customer
    UNION ALL SELECT 'shop_undated', 'customer', 'ERROR', count(*), 0, 0, count(*), 0, 0 FROM customer
    UNION ALL SELECT 'shop_31_12_2002', 'parts', 'OK', count(*), count(*), 0, 0, 0, 0 FROM part
    UNION ALL SELECT 'shop_31_12_2003', 'documents', 'OK', count(*), count(*), 0, 0, 0, 0 FROM documents""")
def load_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed lines, stray quotes, values over line ends, undated and second dumps: every record is accounted for."""
    root, store = scratch_dir(spark, "dumps"), scratch_dir(spark, "store")
    orders = read(spark, sf_dir, "orders")
    for prefix in ("shop", "tally"):
        lines = _order_lines(orders, year_end_source(prefix)).withColumnRenamed("value", ORDER_HEADER)
        _dump_lines(lines, root, "orders")
    dump_customers(spark, sf_dir, root)
    dump_customers(spark, sf_dir, root, "shop_undated")
    # Inches are written as a quote in a bare name; texts run over line ends.
    _dump_lines(read(spark, sf_dir, "part").select(F.lit("shop_31_12_2002").alias("source"), F.concat(
        F.col("p_partkey").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit('" '), "p_type")
        .alias("p_partkey,p_type")), root, "parts")
    write_dumps(read(spark, sf_dir, "documents").withColumn("source", F.lit("shop_31_12_2003")), root, "documents", "source")
    batch_import(spark, root, store, RUN_AT)
    return account(spark, root, store)


@workload("read_rejects", """
    SELECT 'shop_31_12_' || year(o_orderdate) AS source_file, make_date(year(o_orderdate), 12, 31) AS file_date,
           CASE WHEN o_orderpriority < '3' THEN 'bad,' || o_orderpriority
                ELSE concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d'), 'surplus') END
           AS record
    FROM orders WHERE o_orderstatus = 'P'""")
def read_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The malformed lines that a load left out, as they stand in the dumps."""
    root, store = scratch_dir(spark, "dumps"), scratch_dir(spark, "store")
    _dump_lines(_order_lines(read(spark, sf_dir, "orders"), year_end_source("shop")).withColumnRenamed("value", ORDER_HEADER), root, "orders")
    run = batch_import(spark, root, store, RUN_AT)
    return log.read_rejects(spark, load.rejects_path(store), run).select("source_file", "file_date", "record")


@workload("batch_import", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           NULL AS channel, make_date(year(o_orderdate), 12, 31) AS snapshot_date FROM orders
    UNION ALL
    SELECT o_orderkey, o_custkey, NULL, o_totalprice, o_orderdate, o_orderpriority, 'web',
           make_date(year(o_orderdate) + 10, 12, 31) FROM orders""")
def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps whose column order and columns differ, loaded together and matched by name."""
    root, store = dump_orders(spark, sf_dir), scratch_dir(spark, "store")
    later = read(spark, sf_dir, "orders").select(
        F.lit("web").alias("channel"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_custkey",
        "o_orderkey", F.concat(F.lit("shop_31_12_"), (F.year("o_orderdate") + 10).cast("string"))
        .alias("source"))
    write_dumps(later, root, "orders", "source")
    batch_import(spark, root, store, RUN_AT)
    return open_snapshots(spark, store, "orders")


@workload("import_summary", f"""
    WITH entries AS ({_LOG_SQL})
    SELECT TIMESTAMP '2024-01-15 12:00:00' AS import_timestamp, count(*) AS tables_imported,
           CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS n_empty,
           CAST(0 AS BIGINT) AS n_skipped, CAST(0 AS BIGINT) AS n_failed
    FROM entries""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, _ = _imported(spark, sf_dir)
    return log.import_summary(run)


@workload("load_manifest", f"""
    WITH entries AS ({_LOG_SQL})
    SELECT source_file, 'store' AS output_db, '2024-01-15T12:00:00Z' AS converted_at,
           count(*) AS table_count, string_agg(table_name, ',' ORDER BY table_name) AS tables
    FROM entries GROUP BY source_file""")
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read back."""
    run, store = _imported(spark, sf_dir)
    log.write_manifest(log.load_manifest(run, "store", "2024-01-15T12:00:00Z"), f"{store}/manifest.json")
    return spark.read.schema(
        "source_file string, output_db string, converted_at string, table_count bigint, "
        "tables array<string>").json(f"{store}/manifest.json").withColumn(
        "tables", F.array_join("tables", ","))


@workload("row_count_report", """
    SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'customer', count(*) FROM customer""")
def row_count_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_dataset(spark, sf_dir).row_counts(["orders", "lineitem", "customer"])


@workload("columns_to_rows", """
    SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS ragged, 'quantity' AS measure,
           l_quantity AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag = 'R', 'price', l_extendedprice FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag = 'R', 'tax',
           CASE WHEN l_returnflag <> 'R' THEN l_tax END FROM lineitem""")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column block per line, that of returned lines one value short."""
    amounts = F.when(F.col("l_returnflag") == "R", F.array("l_quantity", "l_extendedprice")).otherwise(
        F.array("l_quantity", "l_extendedprice", "l_tax"))
    block = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", amounts.alias("amount"),
        F.array(F.lit("quantity"), F.lit("price"), F.lit("tax")).alias("measure"))
    names = ["measure", "amount"]
    return columns_to_rows(block.withColumn("ragged", is_ragged(names)), names)


@workload("incremental_ingest", """
    SELECT *, make_date(year(o_orderdate), 12, 31) AS snapshot_date FROM orders""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps that arrive in two instalments, picked up by three runs; the third finds nothing new."""
    root, store = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    checkpoint = scratch_dir(spark, "stream")
    times = iter(RUN_AT + datetime.timedelta(hours=i) for i in range(100))
    orders = read(spark, sf_dir, "orders").withColumn("source", year_end_source("shop"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (orders.where(early), orders.where(~early), None):
        if part is not None:
            write_dumps(part, root, "orders", "source")
        import_new(spark, root, store, checkpoint, lambda: next(times)).awaitTermination()
    return open_snapshots(spark, store, "orders")


@workload("incremental_parts", """
    SELECT *, make_date(year(o_orderdate), 12, 31) AS snapshot_date FROM orders""")
def incremental_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files that come to a dump in three instalments; a lost checkpoint replays all of them without harm."""
    root, store = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    checkpoint, again = scratch_dir(spark, "stream"), scratch_dir(spark, "stream")
    times = iter(RUN_AT + datetime.timedelta(hours=i) for i in range(100))
    orders = read(spark, sf_dir, "orders").withColumn("source", year_end_source("shop"))
    third = F.pmod(F.xxhash64("o_orderkey"), F.lit(3))
    for part in range(3):
        write_dumps(orders.where(third == part), root, "orders", "source")
        import_new(spark, root, store, checkpoint, lambda: next(times)).awaitTermination()
    import_new(spark, root, store, again, lambda: next(times)).awaitTermination()
    return open_snapshots(spark, store, "orders")
