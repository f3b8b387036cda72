"""The load log, one row per table and dump, appended after every load, and the ledger of files that were read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.sources.local import local_frame
from snapledger.storage import exists

# Both log shapes the converters write, in one schema, plus what a load needs to find its data again, what it
# left out, and what types its values allow.
LOG_SCHEMA = (
    "import_id bigint, source_file string, file_date date, import_timestamp timestamp_ntz, "
    "table_name string, row_count bigint, date_suffix string, status string, message string, "
    "base_table string, store_path string, n_dropped bigint, adds boolean, type_masks map<string,int>")
LOG_COLUMNS = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
LEDGER_SCHEMA = ("path string, length bigint, modified_at timestamp, source_file string, base_table string, "
                 "file_date date, load string")

REJECTS_SCHEMA = "source_file string, base_table string, file_date date, path string, record string, load string"

LOADED = "OK"
EMPTY = "EMPTY"
SKIPPED = "SKIPPED_EXISTS"
ERROR = "ERROR"

# Loads of one schema lie side by side, told apart by this part of their path.
LOAD_COLUMN = "__load"


def load_of(store_path) -> F.Column:
    return F.regexp_extract(store_path, f"/{LOAD_COLUMN}=([^/]*)$", 1)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return local_frame(spark, [], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def append_log(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Append log rows numbered from 1. Writers of one log take turns: ids go on after the highest one there."""
    last = read_log(spark, path).agg(F.max("import_id")).first()[0] or 0
    entries.withColumn("import_id", F.col("import_id") + F.lit(last)).select(*LOG_COLUMNS) \
        .coalesce(1).write.mode("append").parquet(path)


def loaded_keys(log: DataFrame) -> DataFrame:
    """Every folder that holds current data of a ``(base_table, file_date)``: the last load that owns the date
    and those that added files to it since. ``source_file`` is the owner, whose files alone are added."""
    loaded = log.where(F.col("status") == LOADED).withColumn("adds", F.coalesce("adds", F.lit(False)))
    key = ["base_table", "file_date"]
    owners = loaded.groupBy(*key).agg(F.max(F.when(~F.col("adds"), F.col("import_id"))).alias("owner"))
    return loaded.join(owners, key).where(F.col("import_id") >= F.col("owner")).select(
        *key, "store_path", "row_count", "source_file", "n_dropped", "type_masks")


def _of_current_loads(spark: SparkSession, path: str, schema: str, log: DataFrame) -> DataFrame:
    """What loads noted about themselves, each in a folder; only of those the log names for their date."""
    if not exists(spark, path):
        return local_frame(spark, [], schema)
    entries = spark.read.schema(schema).parquet(path).select(*[part.split()[0] for part in schema.split(", ")])
    current = loaded_keys(log).select("base_table", "file_date", load_of("store_path").alias("load")).distinct()
    return entries.join(current, ["base_table", "file_date", "load"], "left_semi")


def read_ledger(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """The files whose rows are current data."""
    return _of_current_loads(spark, path, LEDGER_SCHEMA, log)


def read_rejects(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """The malformed rows that current loads left out, with the file they stand in."""
    return _of_current_loads(spark, path, REJECTS_SCHEMA, log)


def known_masks(log: DataFrame, table: str) -> dict[str, int]:
    """Per column the types that hold all values of the table's current loads, as a mask; none for loads of old logs."""
    loads = loaded_keys(log).where(F.col("base_table") == table)
    if loads.where("type_masks IS NULL").limit(1).count():
        return {}
    masks = loads.select(F.explode("type_masks").alias("name", "mask"))
    return {row["name"]: row["mask"] for row in masks.groupBy("name").agg(F.bit_and("mask").alias("mask")).collect()}


def import_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per run: tables imported and rows in total; empty, skipped and failed ones only counted."""
    loaded = F.col("status") == LOADED
    return log.groupBy(*(by or ["import_timestamp"])).agg(
        F.count_if(loaded).alias("tables_imported"),
        F.coalesce(F.sum(F.when(loaded, F.col("row_count"))), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("status") == EMPTY).alias("n_empty"),
        F.count_if(F.col("status") == SKIPPED).alias("n_skipped"),
        F.count_if(F.col("status") == ERROR).alias("n_failed"))


def load_manifest(log: DataFrame, output: str, converted_at: str) -> DataFrame:
    """One row per source: what was converted, where to, when, and the tables that came out.

    The list is of table names of one source, so it is as small as that source's catalogue.
    """
    return log.where(F.col("status") == LOADED).groupBy("source_file").agg(
        F.lit(output).alias("output_db"), F.lit(converted_at).alias("converted_at"),
        F.count_distinct("table_name").alias("table_count"),
        F.sort_array(F.collect_set("table_name")).alias("tables"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
