"""Paths: where scratch data goes and what lies in a folder, on whatever file system Spark uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder all executors can reach: below ``spark.checkpoint.dir`` where that is set.

    Only a local session without that setting (tests, one machine) has a temporary folder instead; on
    a cluster, where executors would not see it, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} share")
        return tempfile.mkdtemp(prefix=f"{label}-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write a result that later joins look up, and read it back from the shared folder.

    It is then worked out once, survives lost executors, and its true size is known: Spark
    broadcasts it below the session's limit, and otherwise shuffles both sides afresh, which is
    the form in which adaptive execution can split a hot key of the other side over many tasks.
    """
    path = f"{scratch_dir(df.sparkSession, label)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _hadoop_path(spark, path)
    return fs.exists(hadoop)


def list_children(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """``(name, path, is_folder)`` of the entries directly in a folder, sorted, hidden ones left out."""
    hadoop, fs = _hadoop_path(spark, path)
    if not fs.exists(hadoop):
        raise FileNotFoundError(f"no such path: {path}")
    entries = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            entries.append((name, status.getPath().toString(), status.isDirectory()))
    return sorted(entries)


def file_path() -> Column:
    """Path of the file a row was read from, with URI escapes undone."""
    raw = F.col("_metadata.file_path")
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def plain_glob(path: str) -> str:
    """A path for a reader that takes globs, with any glob characters in it meant literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
