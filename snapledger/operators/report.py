"""Reports over nested run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TYPE = "map<string, struct<success: boolean, elapsed_time: double, error: string>>"


def explode_results(df: DataFrame, results: Column | str, others: list[str]) -> DataFrame:
    """One row per implementation from ``{implementation: {success, elapsed_time, error}}`` JSON."""
    column = F.col(results) if isinstance(results, str) else results
    parsed = F.from_json(column, RESULT_TYPE)
    return df.select(*others, F.explode(parsed).alias("implementation", "result")).select(
        *others, "implementation", "result.*")


def run_summary(results: DataFrame, by: str = "implementation") -> DataFrame:
    """Per group: runs tested, successes, failures, total and mean time, success percentage."""
    tested = F.count(F.lit(1))
    success = F.count_if("success")
    # Exact decimal sums do not depend on the order tasks finish in.
    total = F.coalesce(F.sum(F.col("elapsed_time").cast("decimal(18,6)")), F.lit(0)).cast("double")
    return results.groupBy(by).agg(
        tested.alias("files_tested"), success.alias("success_count"),
        (tested - success).alias("fail_count"), F.round(total, 2).alias("total_time"),
        F.round(total / tested, 2).alias("average_time"),
        F.round(success / tested * 100, 1).alias("success_rate"))


def save_results(df: DataFrame, path: str, timestamp: str | None = None) -> None:
    """Keep results as JSON; the caller puts its time stamp into the path, or into every record.

    With a ``timestamp`` each record is ``{"timestamp": ..., "results": {...}}``, the row being the results.
    """
    if timestamp is not None:
        df = df.select(F.lit(timestamp).alias("timestamp"), F.struct("*").alias("results"))
    df.write.mode("errorifexists").json(path)


def read_results(spark: SparkSession, path: str, results: str) -> DataFrame:
    """Saved results with their time stamp, ``results`` being the schema of what was kept."""
    return spark.read.schema(f"timestamp string, results struct<{results}>").json(path).select("timestamp", "results.*")
