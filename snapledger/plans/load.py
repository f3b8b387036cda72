"""Loading dump trees into date-partitioned tables.

A store is a folder with ``<table>/schema=<n>/__load=<id>/snapshot_date=<date>/`` parquet data, one
``schema`` folder per set of columns and types a table has had, and an ``import_log``. The log says which
folders hold the current data of a ``(table, date)``: that of the load which owns the date, and those of
loads that added files later. A folder it does not name is not read. Beside it lie ``import_files``, the
ledger of files whose rows were loaded, and ``import_rejects``, the malformed rows that were left out.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import json
import operator
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.naming import quoted, sanitize_text, snapshot_date, unique_names
from snapledger.functions.text import add_search_key
from snapledger.functions.types import LADDER, common_form, fit_mask, literal, spark_type, text_masks, type_of_mask, wider_type
from snapledger.operators.rules import apply_schema, declared_columns, fits
from snapledger.operators.search import search
from snapledger.operators.textindex import candidate_files, write_index
from snapledger.plans import log as load_log
from snapledger.plans.log import LOAD_COLUMN
from snapledger.sources.csv import cast_columns, merged_types, read_csv_rows, sound_rows
from snapledger.sources.discover import (SOURCE_OF_PATH, describe_files, discover_sources, list_location_files,
                                         newest)
from snapledger.sources.local import local_frame
from snapledger.sources.records import CORRUPT
from snapledger.storage import exists, file_path, materialized

ON_CONFLICT = ("keep", "replace")
LOAD, ADD = "LOAD", "ADD"


@dataclass(frozen=True)
class LoadOptions:
    """How a load behaves. The three source converters differ in nothing else."""

    date_mode: str = "valid"
    date_override: str | None = None
    default_date: str | None = None
    on_conflict: str = "keep"          # 'keep' = first load wins, 'replace' = last one does
    typing: str = "infer"              # or 'text'
    read_mode: str = "drop"            # or 'fail'
    tables: tuple[str, ...] | None = None
    search_columns: tuple[str, ...] = ()   # text columns to store search keys of, and an index of these
    schemas: dict | None = None        # declared types by table, as in a configuration
    parallel_tables: int = 4

    def __post_init__(self):
        if self.on_conflict not in ON_CONFLICT:
            raise ValueError(f"unknown on_conflict {self.on_conflict!r}; use one of {ON_CONFLICT}")


def log_path(store: str) -> str:
    return f"{store.rstrip('/')}/import_log"


def ledger_path(store: str) -> str:
    return f"{store.rstrip('/')}/import_files"


def rejects_path(store: str) -> str:
    return f"{store.rstrip('/')}/import_rejects"


def index_path(store: str) -> str:
    return f"{store.rstrip('/')}/import_index"


def dump_date(source: Column, options: LoadOptions) -> Column:
    return snapshot_date(source, options.date_mode, options.date_override, options.default_date)


def table_folder(table: str) -> str:
    """Folder of a table; names that only differ in characters a folder cannot have stay apart."""
    clean = sanitize_text(table)
    return clean if clean == table else f"{clean}_{hashlib.md5(table.encode()).hexdigest()}"


def plan_load(files: DataFrame, log: DataFrame, ledger: DataFrame, options: LoadOptions) -> DataFrame:
    """What to do with each file found: LOAD, ADD, SKIPPED_EXISTS, EMPTY or ERROR, decided by source and table.

    With 'keep' the first source by name gets a ``(table, date)`` and what was loaded before is left alone;
    with 'replace' the last one gets it. Either way files that came to the owner's dump after it was loaded
    are added to the date, if all files loaded before are still there; else the dump was written anew, which
    only 'replace' takes. ``is_new``: the file is not in the ledger. Works on the file listing, with
    aggregates only; nothing in it grows with the files but the listing itself.
    """
    if options.tables is not None:
        files = files.where(F.col("table_name").isin(*options.tables))
    key, dump = ["table_name", "snapshot_date"], ["source_file", "table_name", "location", "snapshot_date"]
    listed = files.withColumn("snapshot_date", dump_date(F.col("source_file"), options))
    seen = ledger.select("path", F.col("base_table").alias("table_name"), F.col("file_date").alias("snapshot_date"),
                         F.col("length").alias("seen_length"), F.col("modified_at").alias("seen_at"))
    same = (F.col("length") == F.col("seen_length")) & F.col("modified_at").eqNullSafe(F.col("seen_at"))
    listed = listed.join(seen, ["path", *key], "left").withColumn("is_new", F.col("seen_length").isNull())
    new = F.col("is_new") & (F.col("length") > 0)
    found = listed.groupBy(*dump).agg(
        F.sum("length").alias("n_bytes"), F.count_if(new).alias("n_new"), F.count_if(~F.col("is_new")).alias("n_seen"),
        F.count_if(~F.col("is_new") & same).alias("n_same"))
    usable = found.where((F.col("n_bytes") > 0) & F.col("snapshot_date").isNotNull())
    pick = F.min if options.on_conflict == "keep" else F.max
    winners = usable.groupBy(*key).agg(pick(F.struct("source_file", "location")).alias("winner"))
    owned = load_log.loaded_keys(log).groupBy("base_table", "file_date").agg(F.max("source_file").alias("owner"))
    known = ledger.groupBy("base_table", "file_date").agg(F.count(F.lit(1)).alias("n_known"))
    owned = owned.join(known, ["base_table", "file_date"], "left").withColumnsRenamed(
        {"base_table": "table_name", "file_date": "snapshot_date"})
    planned = found.join(winners, key, "left").join(owned, key, "left")
    wins = F.col("winner") == F.struct("source_file", "location")
    # All that was loaded is still there, and more.
    still = F.col("n_same") if options.on_conflict == "replace" else F.col("n_seen")
    grown = (F.col("owner") == F.col("source_file")) & (F.col("n_new") > 0) & (still == F.col("n_known"))
    taken = F.col("owner").isNotNull()
    if options.on_conflict == "keep":
        action = F.when(taken, F.when(grown, ADD).otherwise(load_log.SKIPPED)).when(wins, LOAD).otherwise(load_log.SKIPPED)
    else:
        action = F.when(~wins, load_log.SKIPPED).when(taken & grown, ADD).otherwise(LOAD)
    action = (F.when(F.col("snapshot_date").isNull(), load_log.ERROR)
              .when(F.col("n_bytes") == 0, load_log.EMPTY).otherwise(action))
    actions = planned.select(*[F.col(c).alias(f"of_{c}") for c in dump], action.alias("action"))
    both = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in dump])
    return listed.join(actions, both).select(*dump, "path", "length", "modified_at", "is_new", "action")


def schema_folder(df: DataFrame) -> str:
    """Name of the folder for this set of columns and types."""
    fields = json.dumps([[f.name.lower(), f.dataType.simpleString()] for f in df.schema])
    return "schema=" + hashlib.md5(fields.encode()).hexdigest()


def write_snapshots(df: DataFrame, store: str, table: str, load: str | None = None) -> str:
    """Write rows with a ``snapshot_date`` column into the table, replacing just those dates.

    Replacing makes a repeated attempt harmless: a load that died before its log entry is done over.
    A ``load`` of its own has its own folder, in which nothing else is found and none is replaced.
    """
    path = f"{store.rstrip('/')}/{table_folder(table)}/{schema_folder(df.drop('snapshot_date'))}"
    if load:
        path += f"/{LOAD_COLUMN}={load}"
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(path))
    return path


def load_snapshot(df: DataFrame, store: str, table: str, date: str) -> tuple[str, int]:
    """Load one dated copy and count its rows while they are written."""
    counted = Observation()
    dated = df.withColumn("snapshot_date", F.lit(date).cast("date"))
    path = write_snapshots(dated.observe(counted, F.count(F.lit(1)).alias("rows")), store, table)
    return path, counted.get["rows"]


def _schema_path() -> Column:
    return F.regexp_replace("store_path", f"/{LOAD_COLUMN}=[^/]*$", "").alias("schema_path")


def _known_types(spark: SparkSession, log: DataFrame, table: str, masks: dict[str, int]) -> dict[str, str]:
    """Types the table's columns have in the store: what all values allow where their masks are known."""
    types: dict[str, str] = {}
    paths = (load_log.loaded_keys(log).where(F.col("base_table") == table)
             .groupBy(_schema_path()).agg(F.min("store_path").alias("store_path")).collect())
    for row in paths:
        for field in spark.read.parquet(row["store_path"]).schema:
            kind = field.dataType.simpleString()
            if field.name in masks:
                types[field.name] = type_of_mask(masks[field.name])
            else:
                types[field.name] = wider_type(types[field.name], kind) if field.name in types else kind
    types.pop("snapshot_date", None)
    return types


@dataclass(frozen=True)
class Loaded:
    """What a load of a table's files left: its folder, rows by date, malformed rows by source, types as masks,
    and by declared column the values that its type cannot hold."""

    path: str | None
    rows: dict
    dropped: dict
    masks: dict
    misfits: dict

    def message(self) -> str | None:
        told = ", ".join(f"{name}: {n}" for name, n in self.misfits.items())
        return f"values not of the declared type, in all sources of this load: {told}" if told else None


def _load_table(spark: SparkSession, store: str, table: str, plan: list, files: DataFrame,
                log: DataFrame, options: LoadOptions) -> Loaded:
    """The planned files of a table into dated partitions of a folder of this load.

    What the values of each column fit is observed while they are written. The first load of a table
    scans them before, to know the types. Later ones write them as the types the table has; if the masks
    say that some value is not of them, the types that hold both the old and the new values are known by
    then, and only the writing is repeated. Columns with a declared type are of that type; a value that it
    cannot hold becomes NULL and is counted.
    """
    # Of files added later, the older ones in their folders are left out unread.
    since = None if any(row["action"] == LOAD for row in plan) else files.agg(F.min("modified_at")).first()[0]
    rows = read_csv_rows(spark, [row["location"] for row in plan], options.read_mode, files.select("path"), since)
    columns = [name for name in rows.columns if name not in ("__path", CORRUPT)]
    write = functools.partial(_write_dated, rows, store=store, table=table, plan=plan, options=options,
                              load=f"l{uuid.uuid4().hex}")
    if options.typing == "text":
        return replace(write({name: "string" for name in columns}), masks=dict.fromkeys(columns, 0))
    known_masks = load_log.known_masks(log, table)
    known = _known_types(spark, log, table, known_masks)
    declared = {name: spec for name, spec in declared_columns(options.schemas, table).items() if name in columns and "type" in spec}
    write = functools.partial(write, declared=declared)
    columns = [name for name in columns if name not in declared]
    types = {name: known.get(name) for name in columns}
    if all(t == "string" or t in LADDER for t in types.values()):
        result = write(types, strict=False, masked=True)
        masks = result.masks
        fitting = merged_types(masks, known_masks, known)
        if all(fitting[name] == types[name] for name in masks):
            return result
    else:
        masks = text_masks(sound_rows(rows), columns)
        fitting = merged_types(masks, known_masks, known)
    return replace(write({**known, **fitting}), masks=masks)


def _write_dated(rows: DataFrame, types: dict[str, str], *, store: str, table: str, plan: list, options: LoadOptions,
                 load: str, strict: bool = True, masked: bool = False, declared: dict | None = None) -> Loaded:
    """Date the rows by the source their file belongs to and write them; the malformed ones go to the rejects.

    One pass writes the sound rows and observes how many are malformed and, ``masked``, what each column's
    values fit.
    """
    spark = rows.sparkSession
    columns = [name for name in rows.columns if name not in ("__path", CORRUPT)]
    sound = F.col(CORRUPT).isNull()
    observed = Observation()
    declared = declared or {}
    open_columns = [name for name in columns if name not in declared]
    fitting = [F.bit_and(F.when(sound, fit_mask(F.col(quoted(name))))).alias(f"m{i}") for i, name in enumerate(open_columns) if masked]
    misfits = [F.count_if(sound & F.col(quoted(name)).isNotNull() & ~fits(rows, name, spark_type(spec["type"]))).alias(f"f{i}")
               for i, (name, spec) in enumerate(declared.items())]
    watched = rows.observe(observed, F.count_if(~sound).alias("malformed"), *fitting, *misfits)
    typed = apply_schema(watched.where(sound).drop(CORRUPT), declared)
    typed = cast_columns(typed, {name: kind for name, kind in types.items() if name not in declared}, strict)
    keyed = [name for name, kind in typed.dtypes if kind == "string" and name in options.search_columns]
    typed = add_search_key(typed, keyed)
    # One short row per source of this table, of a size Spark knows, so it joins as it sees fit.
    dates = local_frame(spark, [(row["source_file"], row["snapshot_date"]) for row in plan],
                        "__source string, __date date")
    source = F.regexp_extract("__path", SOURCE_OF_PATH, 1)
    dated = typed.withColumn("__source", source).join(dates, "__source").drop("__source", "__path")
    # A dump may itself have a column of the partition column's name.
    names = unique_names(["snapshot_date", *dated.columns[:-1]])[1:]
    dated = dated.toDF(*names, "snapshot_date")
    # What is read back and counted is what this load wrote, even where it replaces a date.
    path = write_snapshots(dated, store, table, load)
    # The schema is given because a dump without rows leaves no file to take it from.
    counts = (spark.read.schema(dated.schema).parquet(path)
              .where(F.col("snapshot_date").isin([row["snapshot_date"] for row in plan]))
              .groupBy("snapshot_date").count().collect())
    written = {row["snapshot_date"]: row["count"] for row in counts}
    dropped, masks = {}, {}
    # Without any row there is nothing to observe; whether all were malformed is then asked of the rejects.
    seen = observed.get if written else None
    if options.read_mode == "drop" and (seen is None or seen["malformed"]):
        bad = rows.where(~sound).withColumn("source_file", source).join(dates, F.col("source_file") == F.col("__source"))
        (bad.select("source_file", F.lit(table).alias("base_table"), F.col("__date").alias("file_date"),
                    F.col("__path").alias("path"), F.col(CORRUPT).alias("record"), F.lit(load).alias("load"))
         .write.mode("overwrite").parquet(f"{rejects_path(store)}/part={load}"))
        rejects = spark.read.parquet(f"{rejects_path(store)}/part={load}")
        dropped = {row["source_file"]: row["count"] for row in rejects.groupBy("source_file").count().collect()}
    if seen is not None and masked:
        masks = {name: seen[f"m{i}"] for i, name in enumerate(open_columns)}
    lost = {name: seen[f"f{i}"] for i, name in enumerate(declared) if seen is not None and seen[f"f{i}"]}
    if written and keyed:
        write_index(spark, path, keyed, f"{index_path(store)}/part={load}")
    return Loaded(path, written, dropped, masks, lost)


def import_files(spark: SparkSession, files: DataFrame, store: str,
                 run_at: datetime.datetime, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load the listed dump files, table by table, and log what became of each.

    ``files`` is all there is of the dumps it names. What comes to the driver is a row per source and
    table, not per file. A table that fails is logged as ERROR and the others go on. Files enter the ledger
    before the log names their load, so a load that dies in between is done over. Returns this run's log rows.
    """
    log = load_log.read_log(spark, log_path(store))
    ledger = load_log.read_ledger(spark, ledger_path(store), log)
    planned = materialized(plan_load(files, log, ledger, options), "plan")
    plan = planned.groupBy("source_file", "table_name", "location", "snapshot_date", "action").agg(
        F.count(F.lit(1)).alias("n_files")).collect()

    entries = []

    def note(row, status, rows=None, message=None, done: Loaded | None = None):
        date = row["snapshot_date"]
        suffix = date.strftime("%Y%m%d") if date else None
        name = sanitize_text(row["table_name"])
        masks = {c: m for c, m in done.masks.items() if m is not None} if done else None
        entries.append((None, row["source_file"], date, run_at,
                        f"{name}_{suffix}" if suffix else name, rows, suffix, status, message,
                        row["table_name"], done.path if done else None,
                        done.dropped.get(row["source_file"], 0) if done else None, row["action"] == ADD, masks))

    for row in plan:
        if row["action"] == load_log.ERROR:
            note(row, load_log.ERROR, message="no valid date in the name and no default given")
        elif row["action"] not in (LOAD, ADD):
            note(row, row["action"], 0 if row["action"] == load_log.EMPTY else None)
    to_load: dict[str, list] = {}
    for row in plan:
        if row["action"] in (LOAD, ADD):
            to_load.setdefault(row["table_name"], []).append(row)

    def load(table: str, todo: list) -> list[tuple]:
        chosen = planned.where((F.col("table_name") == table) & ((F.col("action") == LOAD) | (F.col("action") == ADD) & F.col("is_new")))
        if len(todo) < len(to_load[table]):
            chosen = chosen.where(F.struct("source_file", "location").isin(
                [F.struct(F.lit(row["source_file"]), F.lit(row["location"])) for row in todo]))
        try:
            done = _load_table(spark, store, table, todo, chosen, log, options)
            (chosen.select("path", "length", "modified_at", "source_file", F.col("table_name").alias("base_table"),
                           F.col("snapshot_date").alias("file_date"), F.lit(done.path.rpartition("=")[2]).alias("load"))
             .coalesce(1).write.parquet(f"{ledger_path(store)}/part={done.path.rpartition('=')[2]}"))
            return [(row, done.rows.get(row["snapshot_date"], 0), done, None) for row in todo]
        except Exception as error:  # noqa: BLE001 - one bad table must not stop the others
            if len(todo) > 1:
                # Together they failed: halve them until only the bad ones are left alone.
                half = len(todo) // 2
                return load(table, todo[:half]) + load(table, todo[half:])
            return [(todo[0], None, None, str(error) or type(error).__name__)]

    # Small tables would leave a cluster idle one after the other, so a few load side by side.
    with ThreadPoolExecutor(max_workers=options.parallel_tables) as pool:
        outcomes = list(pool.map(load, to_load, to_load.values()))
    for row, rows, done, error in (result for results in outcomes for result in results):
        if error:
            note(row, load_log.ERROR, message=error)
        elif rows:
            note(row, load_log.LOADED, rows, done.message(), done)
        else:
            # A header without rows leaves nothing to read back.
            note(row, load_log.EMPTY, 0, done=done)

    # Ids go by source, table and date; the rows are here already, so they are numbered here.
    entries.sort(key=lambda row: (row[1], row[9], row[2] or datetime.date.min))
    entries = [(number, *row[1:]) for number, row in enumerate(entries, 1)]
    result = local_frame(spark, entries, load_log.LOG_SCHEMA)
    if entries:
        load_log.append_log(spark, log_path(store), result)
    return load_log.read_log(spark, log_path(store)).where(
        F.col("import_timestamp") == literal(run_at))


def batch_import(spark: SparkSession, root: str, store: str, run_at: datetime.datetime,
                 options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load every dump below a folder into one store."""
    return import_files(spark, discover_sources(spark, root), store, run_at, options)


def import_source(spark: SparkSession, folder: str, store: str, run_at: datetime.datetime,
                  options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load the dump of one source."""
    return import_files(spark, discover_sources(spark, folder, single=True), store, run_at, options)


def import_latest(spark: SparkSession, root: str, store: str, run_at: datetime.datetime,
                  options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load only the newest source below a folder, by file time and then path."""
    files = discover_sources(spark, root)
    latest = newest(files.where("length > 0"), ["modified_at", "path"]).first()
    if latest is None:
        raise FileNotFoundError(f"no dumps in {root}")
    return import_files(spark, files.where(F.col("source_file") == latest["source_file"]), store, run_at,
                        options)


def import_paths(spark: SparkSession, listing: DataFrame, store: str, run_at: datetime.datetime,
                 options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load the dumps that a raw listing (path, modificationTime, length), as a stream delivers it, has files of.

    Their folders are listed anew, so that it can be told what came to them and what has gone.
    """
    return import_files(spark, list_location_files(describe_files(listing)), store, run_at, options)


def open_snapshots(spark: SparkSession, store: str, table: str) -> DataFrame:
    """All dated copies of a table under one schema, with ``snapshot_date`` as partition column.

    Copies with other columns are united by name, with NULL for what one lacks, and columns whose
    type changed are read as the one that holds all their values. Filters on ``snapshot_date`` prune to their folders.
    """
    log = load_log.read_log(spark, log_path(store))
    keys = load_log.loaded_keys(log).where(F.col("base_table") == table)
    folders = keys.groupBy(_schema_path(), "store_path").agg(F.collect_list("file_date").alias("dates")) \
        .orderBy("schema_path", "store_path").collect()
    if not folders:
        raise ValueError(f"Table not found: {table}")
    by_schema: dict[str, list] = {}
    for folder in folders:
        by_schema.setdefault(folder["schema_path"], []).append(folder)
    types = {name: type_of_mask(mask) for name, mask in load_log.known_masks(log, table).items()}
    return unite([_read_loads(spark, path, loads) for path, loads in by_schema.items()], types)


def search_snapshots(spark: SparkSession, store: str, table: str, word: str, columns: list[str]) -> DataFrame:
    """`search` over all dated copies of a table by the keys stored at load, opening files that may hold the word.

    Which these are the index says that a load wrote beside its keys. Files of loads without one are all read.
    """
    rows = open_snapshots(spark, store, table)
    log = load_log.read_log(spark, log_path(store))
    loads = [row["load"] for row in load_log.loaded_keys(log).where(F.col("base_table") == table)
             .select(load_log.load_of("store_path").alias("load")).distinct().collect()]
    indexed = [f"{index_path(store)}/part={load}" for load in loads]
    if all(exists(spark, path) for path in indexed):
        found = candidate_files(spark.read.parquet(*indexed), word, columns)
        if found is not None:
            paths = [row["path"] for row in found.collect()]
            rows = rows.where(file_path().isin(paths)) if paths else rows.limit(0)
    return search(rows, word, columns, "_search")


def _read_loads(spark: SparkSession, path: str, loads: list) -> DataFrame:
    """The loads of one schema as one scan, each with the dates for which it is the current one."""
    rows = spark.read.option("basePath", path).parquet(*[load["store_path"] for load in loads])
    if LOAD_COLUMN not in rows.columns:
        return rows.where(F.col("snapshot_date").isin([date for load in loads for date in load["dates"]]))
    current = functools.reduce(operator.or_, [
        (F.col(LOAD_COLUMN) == load["store_path"].rpartition("=")[2]) & F.col("snapshot_date").isin(load["dates"])
        for load in loads])
    return rows.where(current).drop(LOAD_COLUMN)


def unite(parts: list[DataFrame], known: dict[str, str] | None = None) -> DataFrame:
    """Union by name; missing columns are NULL and differing types go to the ``known`` one or one that holds all."""
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for field in part.schema:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())

    def form(name: str, own: str) -> Column:
        value, wide = F.col(quoted(name)), (known or {}).get(name, "string")
        if len(kinds[name]) == 1:
            return value
        return (common_form(value, own, kinds[name]) if wide == "string" else value.cast(wide)).alias(name)

    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        part.select(*[form(f.name, f.dataType.simpleString()) for f in part.schema]) for part in parts])


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace a whole output with this one."""
    df.write.mode("overwrite").parquet(path)


def load_if_absent(df: DataFrame, path: str) -> None:
    """Write only where nothing is yet (the single-table form of the first load wins)."""
    df.write.mode("ignore").parquet(path)
