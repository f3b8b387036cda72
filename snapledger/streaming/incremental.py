"""Import whatever is new in a folder, as a stream over its file listing."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapledger.plans.load import LoadOptions, import_files, import_paths, log_path
from snapledger.plans.log import read_log
from snapledger.sources.discover import FILE_GLOB, FILE_SCHEMA, empty_tables, listed_files


def new_files(spark: SparkSession, root: str, glob: str = FILE_GLOB,
              max_files: int | None = None) -> DataFrame:
    """Streaming listing of files as they appear; contents are not read."""
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("recursiveFileLookup", True).option("pathGlobFilter", glob))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(root).select("path", "modificationTime", "length")


def import_new(spark: SparkSession, root: str, store: str, checkpoint: str,
               clock: Callable[[], datetime.datetime], options: LoadOptions = LoadOptions(),
               max_files: int | None = None) -> StreamingQuery:
    """Load the files that came since the last call, then stop.

    The checkpoint remembers which files were seen, the store's ledger which were loaded. Part files that come
    to a dump after its first ones are added to their date. A batch that is replayed after a failure finds its
    files in the ledger and leaves them alone, so every file is loaded once. A stream is not told of files
    without bytes; tables that have no others are looked for in the folders, and logged once.
    """
    log = read_log(spark, log_path(store))
    noted = log.select("source_file", F.col("base_table").alias("table_name"))
    empty = empty_tables(spark, root, listed_files(spark, [root])).join(noted, ["source_file", "table_name"], "left_anti")
    if empty.limit(1).count():
        import_files(spark, empty, store, clock(), options)

    def load(batch: DataFrame, batch_id: int) -> None:
        import_paths(batch.sparkSession, batch, store, clock(), options)

    return (new_files(spark, root, max_files=max_files).writeStream
            .foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
