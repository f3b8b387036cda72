"""Records of CSV files whose quoted values run over line ends, put together in parallel.

Spark's reader takes such a file in one task. Here its lines are read in splits like any text. What a
line does to the question whether one is inside a quoted value is a function of two states, known from
the line alone; such functions are composed within a split by windows, and over the splits before it by
windows over one row per split. Only lines of records that run over line ends are grouped, and before
that it is checked that no such record is broken: that each ends, cleanly, and is of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.storage import file_path, materialized, plain_glob

CORRUPT = "__corrupt"
#: A record of more bytes than this is taken for a quote that was left open.
MAX_RECORD_BYTES = 32 << 20


class BrokenRecord(ValueError):
    """A quoted value that does not end as it should, by file and line."""


def quote_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))


def line_effect(line: Column) -> Column:
    """``opens``, ``keeps``, ``unclean``: is one inside a value after the line, having begun it outside or inside?

    A quote opens a value only where a field begins, anywhere else in a bare field it is text. The value goes
    on until a single quote. ``unclean``: that of a value carried into the line is followed by more than the
    field's end, so either it or the one that opened the value does not belong there.
    """
    single = lambda text: F.replace(text, F.lit('""'), F.lit(""))
    pieces = F.transform(F.split(F.regexp_replace(line, r"\r\z", ""), ",", -1), lambda piece: F.struct(
        (F.startswith(piece, F.lit('"')) & ~F.contains(single(F.substr(piece, F.lit(2))), F.lit('"'))).alias("opens"),
        (~F.contains(single(piece), F.lit('"'))).alias("keeps"),
        (F.endswith(piece, F.lit('"')) & ~F.contains(single(F.left(piece, F.length(piece) - 1)), F.lit('"'))).alias("clean")))
    effect = lambda opens, keeps, unclean, closed: F.struct(
        opens.alias("opens"), keeps.alias("keeps"), unclean.alias("unclean"), closed.alias("closed"))
    after = lambda state, piece: F.when(state, piece["keeps"]).otherwise(piece["opens"])
    folded = F.aggregate(pieces, effect(F.lit(False), F.lit(True), F.lit(False), F.lit(False)), lambda now, piece: effect(
        after(now["opens"], piece), after(now["keeps"], piece),
        now["unclean"] | (~now["closed"] & ~piece["keeps"] & ~piece["clean"]), now["closed"] | ~piece["keeps"]))
    return F.when(F.contains(line, F.lit('"')), folded).otherwise(effect(F.lit(False), F.lit(True), F.lit(False), F.lit(False)))


def _before(rows: DataFrame, order: Window) -> DataFrame:
    """``from_out``, ``from_in``: is one inside a value before a row, if one was outside or inside before the first?

    Rows that end in one state wherever they began fix it for those after; the others keep or swap it.
    """
    swaps = (F.col("opens") & ~F.col("keeps")).cast("int")
    fixes = F.when(F.col("opens") == F.col("keeps"), F.struct(F.col("opens").alias("state"), F.col("_swaps").alias("swaps")))
    odd = (F.col("_swaps") - swaps - F.coalesce("_fixed.swaps", F.lit(0))) % 2 == 1
    return (rows.withColumn("_swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_fixed", F.last(fixes, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumns({"from_out": F.coalesce("_fixed.state", F.lit(False)) != odd,
                          "from_in": F.coalesce("_fixed.state", F.lit(True)) != odd}).drop("_swaps", "_fixed"))


def _placed(spark: SparkSession, paths: list[str], files: DataFrame | None) -> DataFrame:
    """All lines but the headers, with the place where their record begins (``start``, ``number``)."""
    lines = spark.read.option("lineSep", "\n").text([plain_glob(path) for path in paths]).select(
        "value", file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    if files is not None:
        lines = lines.join(files, "path", "left_semi")
    split = Window.partitionBy("path", "block").orderBy("line")
    counted = _before(lines.withColumn("effect", line_effect(F.col("value"))).select("*", "effect.*"), split)
    after = lambda before: F.when(F.col(before), F.col("keeps")).otherwise(F.col("opens"))
    began = lambda before: F.max(F.when(~F.col(before), F.col("line")))
    splits = counted.groupBy("path", "block").agg(
        F.max_by(after("from_out"), "line").alias("opens"), F.max_by(after("from_in"), "line").alias("keeps"),
        began("from_out").alias("if_out"), began("from_in").alias("if_in"), F.count(F.lit(1)).alias("lines"))
    in_file = Window.partitionBy("path").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = _before(splits, in_file).withColumn("last", F.when(F.col("from_out"), F.col("if_in")).otherwise(F.col("if_out")))
    splits = splits.select("path", "block", F.col("from_out").alias("_inside"),
                           F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("_lines"),
                           F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("line"))), True)
                           .over(earlier).alias("_open"))
    inside = F.when(F.col("_inside"), F.col("from_in")).otherwise(F.col("from_out"))
    first = F.min(F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("line"))).over(Window.partitionBy("path", "block"))
    begin = F.last(F.when(~F.col("inside"), F.struct("block", "line")), True).over(split.rowsBetween(Window.unboundedPreceding, 0))
    return (counted.join(splits, ["path", "block"]).withColumn("inside", inside).withColumns({
        "open": F.when(F.col("inside"), F.col("keeps")).otherwise(F.col("opens")),
        "unclean": F.col("inside") & F.col("unclean"), "header": first,
        "number": F.col("_lines") + F.row_number().over(split), "start": F.coalesce(begin, F.col("_open"))})
        .where("header IS NULL OR start.line <> header")
        .select("path", "value", "block", "line", "number", "start", "inside", "open", "unclean"))


def csv_records(spark: SparkSession, paths: list[str], files: DataFrame | None = None) -> DataFrame:
    """``(path, record)`` for all records but the headers; only of the ``files`` (by ``path``), if given.

    Raises `BrokenRecord` with the file and line of the first quoted value that is still open when its file
    ends, ends uncleanly on a later line, or makes a record of over ``MAX_RECORD_BYTES``: such a quote would
    swallow the lines after it. Otherwise no group is larger than a split, the splits of one file, or a record.
    """
    placed = materialized(_placed(spark, paths, files), "lines")
    several = placed.where("inside OR open")
    key = ["path", "start"]
    broken = several.groupBy(*key).agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.min("number").alias("number"), F.count(F.lit(1)).alias("lines"),
        F.max_by("open", F.struct("block", "line")).alias("open"), F.max("unclean").alias("unclean"))
    first = broken.where(F.col("open") | F.col("unclean") | (F.col("bytes") > MAX_RECORD_BYTES)).orderBy("path", "number").first()
    if first is not None:
        how = ("ends before other text" if first["unclean"] else "is open when the file ends" if first["open"] else "is too long")
        raise BrokenRecord(f"{first['path']} line {first['number']}: a quoted value begins that {how}, {first['lines']} lines later")
    records = several.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda line: line["value"]), "\n")
    return (placed.where("NOT (inside OR open)").select("path", F.col("value").alias("record"))
            .unionByName(records.select("path", text.alias("record")))
            .select("path", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''"))


def count_starts(spark: SparkSession, paths: list[str], files: DataFrame | None = None) -> DataFrame:
    """``path`` and ``n_records``: lines with which a record begins, of which the header is none."""
    starts = F.count_if(~F.col("inside") & ~F.col("value").isin("", "\r"))
    return _placed(spark, paths, files).groupBy("path").agg(starts.alias("n_records"))


def parse_records(records: DataFrame, names: list[str], mode: str, options: dict[str, str]) -> DataFrame:
    """Columns of the records, all text, ``__path``, and in ``__corrupt`` the record if it is malformed.

    With FAILFAST a malformed record is an error.
    """
    failing = mode == "FAILFAST"
    schema = ", ".join(f"`{name}` string" for name in names)
    parsed = F.from_csv("record", schema if failing else f"{schema}, `{CORRUPT}` string", {
        **options, "multiLine": "true", "mode": "FAILFAST" if failing else "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT})
    rows = records.select("path", parsed.alias("row"))
    corrupt = F.lit(None).cast("string") if failing else F.col(f"row.{CORRUPT}")
    return rows.select(*[F.col(f"row.`{name}`").alias(name) for name in names],
                       F.col("path").alias("__path"), corrupt.alias(CORRUPT))
