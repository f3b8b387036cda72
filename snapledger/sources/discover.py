"""Which dumps are there: files, sources, tables, and the newest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.sources.local import local_frame
from snapledger.storage import exists, list_children, plain_glob

# A dump tree is <root>/<source>/<table>.csv, each table one file or a folder of part files. The
# folders may be written as source=<source> and table=<table>.csv, as one Spark job leaves them. The leading
# greedy part makes the match start from the end of the path; the look-behind tells a table folder
# from a source, as part files end in .csv as well.
SOURCE_OF_PATH = r"^.*/(?:[^/=]+=)?([^/=]+)(?<!\.csv)/[^/]+\.csv(?:/[^/]+)?$"
LOCATION_OF_PATH = (r"(\.csv)/[^/]+$", "$1")
TABLE_OF_PATH = r"^.*(?<!\.csv)/(?:[^/=]+=)?([^/=]+)\.csv(?:/[^/]+)?$"

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
FILE_GLOB = "*.csv"


def describe_files(files: DataFrame) -> DataFrame:
    """File listing with the source and table each path belongs to, and the table's own path."""
    return files.select(
        "path", "length", F.col("modificationTime").alias("modified_at"),
        F.regexp_extract("path", SOURCE_OF_PATH, 1).alias("source_file"),
        F.regexp_extract("path", TABLE_OF_PATH, 1).alias("table_name"),
        F.regexp_replace("path", *LOCATION_OF_PATH).alias("location"))


def listed_files(spark: SparkSession, paths: list[str], glob: str = FILE_GLOB) -> DataFrame:
    return describe_files(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                          .option("pathGlobFilter", glob).load(paths))


def list_location_files(files: DataFrame) -> DataFrame:
    """All files there are now of the dumps that some files are known of; a row per dump comes to the driver."""
    places = [plain_glob(row["location"]) for row in files.select("location").distinct().collect()]
    return listed_files(files.sparkSession, places) if places else files


def discover_sources(spark: SparkSession, root: str, glob: str = FILE_GLOB,
                     single: bool = False) -> DataFrame:
    """All matching files below a folder of sources, or of one source if it is a ``single`` one.

    The file contents are not read. Spark's listing leaves out files of zero bytes, so a table with
    nothing else gets a row of length 0 from the folder tree.
    """
    if not exists(spark, root):
        raise FileNotFoundError(f"no such folder: {root}")
    files = listed_files(spark, [root], glob)
    return files.unionByName(empty_tables(spark, root, files, single))


def empty_tables(spark: SparkSession, root: str, files: DataFrame, single: bool = False) -> DataFrame:
    """A row of length 0 for each table in the folder tree of which there is no file in the listing."""
    sources = [root] if single else [
        path for _, path, is_folder in list_children(spark, root) if is_folder]
    tables = [(path,) for source in sources
              for name, path, _ in list_children(spark, source) if name.endswith(".csv")]
    folders = describe_files(local_frame(spark, tables, "path string").select(
        "path", F.lit(0).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime")))
    return folders.join(files, ["source_file", "table_name"], "left_anti").select(*files.columns)


def list_source_tables(files: DataFrame, table_type: str | None = None) -> DataFrame:
    """Tables per source. A listing with a ``table_type`` column can be held to one type."""
    if table_type is not None:
        files = files.where(F.col("table_type") == table_type)
    return files.groupBy("source_file", "table_name", "location").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"),
        F.max("modified_at").alias("modified_at"))


def newest(df: DataFrame, by: list[Column | str], per: list[str] | None = None) -> DataFrame:
    """The newest row, per key when ``per`` is given; ties go to the later entries of ``by``.

    An aggregate, not a window: map tasks reduce each key to one row before anything is shuffled,
    so a key that holds a large share of the rows costs no more than any other.
    """
    per = per or []
    rest = [name for name in df.columns if name not in per]
    picked = df.groupBy(*per).agg(
        F.max_by(F.struct(*rest), F.struct(*by)).alias("picked"))
    # An empty input without keys still gives one group, whose pick is NULL.
    return picked.where(F.col("picked").isNotNull()).select(*per, "picked.*").select(*df.columns)


def pick_subset(tables: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted tables with what was found of each; an absent or empty one stays, with a note."""
    spark = tables.sparkSession
    names = local_frame(spark, [(name,) for name in wanted], "table_name string")
    found = tables.where(F.col("table_name").isin(*wanted)).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("n_bytes").alias("n_bytes"))
    return names.join(found, "table_name", "left").select(
        "table_name", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        F.when(F.col("n_sources").isNull(), "MISSING").when(F.col("n_bytes") == 0, "EMPTY")
        .otherwise("FOUND").alias("note"))
