"""Small driver-side rows (catalogue entries, load plans) as a DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows as a local relation: its size is known to the planner and no Python worker is started."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(schema)
    table = pa.table([pa.array(values, field.type) for values, field in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)
