"""Whether every record of the dumps is accounted for: loaded, left out, in a failed load, or not taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.plans import log as load_log
from snapledger.plans.load import LoadOptions, dump_date, ledger_path, log_path
from snapledger.sources.csv import count_records
from snapledger.sources.discover import discover_sources
from snapledger.sources.local import local_frame


def load_accounting(spark: SparkSession, root: str, store: str, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Per source and table of a dump tree: its records and what became of them in a store.

    ``n_records`` are counted from the files alone. Those of files in the ledger must be ``n_loaded`` or
    ``n_dropped``, both as logged; those of other files are ``n_failed`` if the last load of their table did,
    else ``n_not_taken``. What is left over is ``n_unaccounted``: rows that were lost (or, below zero, made up).
    """
    log = load_log.read_log(spark, log_path(store))
    ledger = load_log.read_ledger(spark, ledger_path(store), log).select("path", "base_table", F.col("file_date").alias("date"))
    files = discover_sources(spark, root).where("length > 0").withColumn("date", dump_date(F.col("source_file"), options))
    dumps = [row["location"] for row in files.select("location").distinct().collect()]
    records = count_records(spark, dumps) if dumps else local_frame(spark, [], "path string, n_records bigint")
    files = files.join(records, "path", "left").join(ledger.withColumn("taken", F.lit(True)).withColumnRenamed("base_table", "table_name"),
                                                             ["path", "table_name", "date"], "left")
    n, taken = F.coalesce("n_records", F.lit(0)), F.col("taken").isNotNull()
    dumps = files.groupBy("source_file", "table_name").agg(
        F.sum(n).alias("n_records"), F.sum(F.when(taken, n).otherwise(0)).alias("n_taken"))
    last = log.groupBy("source_file", F.col("base_table").alias("table_name")).agg(F.max_by("status", "import_id").alias("status"))
    loaded = load_log.loaded_keys(log).groupBy("source_file", F.col("base_table").alias("table_name")).agg(
        F.sum("row_count").alias("rows"), F.sum("n_dropped").alias("dropped"))
    key = ["source_file", "table_name"]
    rest = F.col("n_records") - F.col("n_taken")
    failed = F.col("status") == load_log.ERROR
    return (dumps.join(last, key, "left").join(loaded, key, "left").select(
        *key, "status", "n_records", F.coalesce("rows", F.lit(0)).alias("n_loaded"), F.coalesce("dropped", F.lit(0)).alias("n_dropped"),
        F.when(failed, rest).otherwise(0).alias("n_failed"), F.when(failed, 0).otherwise(rest).alias("n_not_taken"))
        .withColumn("n_unaccounted", F.col("n_records") - F.col("n_loaded") - F.col("n_dropped") - F.col("n_failed") - F.col("n_not_taken")))
