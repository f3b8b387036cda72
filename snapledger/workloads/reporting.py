"""Reports over nested run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators.report import explode_results, read_results, run_summary, save_results
from snapledger.storage import scratch_dir
from snapledger.workloads import read, workload


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON result per event: its type as implementation, its value as time, errors as failures."""
    failed = F.col("event_type") == "error"
    result = F.struct((~failed).alias("success"), F.col("value").alias("elapsed_time"),
                      F.when(failed, F.col("props")).alias("error"))
    return read(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.create_map(F.col("event_type"), result)).alias("implementations"))


@workload("explode_results", """
    SELECT event_id, event_type AS implementation, event_type <> 'error' AS success,
           value AS elapsed_time, CASE WHEN event_type = 'error' THEN props END AS error FROM events""")
def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_results(_runs(spark, sf_dir), "implementations", ["event_id"])


@workload("run_summary", """
    SELECT event_type AS implementation, count(*) AS files_tested,
           count(*) FILTER (event_type <> 'error') AS success_count,
           count(*) FILTER (event_type = 'error') AS fail_count,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_time,
           round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS average_time,
           CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 100 END AS DOUBLE) AS success_rate
    FROM events GROUP BY event_type""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept as JSON first, as the harness does, and summed up from there."""
    path = f"{scratch_dir(spark, 'results')}/benchmark_results_20240115_120000.json"
    save_results(_runs(spark, sf_dir), path)
    saved = spark.read.schema("event_id bigint, implementations string").json(path)
    return run_summary(explode_results(saved, "implementations", ["event_id"]))


@workload("save_results", """
    SELECT '20240115_120000' AS timestamp, event_id, event_type AS implementation, event_type <> 'error' AS success,
           value AS elapsed_time, CASE WHEN event_type = 'error' THEN props END AS error FROM events""")
def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept under their time stamp and read back."""
    path, stamp = f"{scratch_dir(spark, 'results')}/benchmark_results_20240115_120000.json", "20240115_120000"
    save_results(_runs(spark, sf_dir), path, stamp)
    rows = read_results(spark, path, "event_id: bigint, implementations: string")
    return explode_results(rows, "implementations", ["timestamp", "event_id"])
