"""Command line: ``python -m snapledger <command> ...``."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from snapledger.operators.compare import compare_cells, compare_rows, compare_schemas, compare_tables
from snapledger.operators.filters import filter_rows
from snapledger.operators.present import default_view
from snapledger.operators.rules import validation_report
from snapledger.operators.search import search
from snapledger.plans.builder import build_query
from snapledger.plans.load import LoadOptions, batch_import, import_latest, import_source, open_snapshots
from snapledger.plans.log import load_manifest, write_manifest
from snapledger.session import local_session
from snapledger.sources.config import read_config
from snapledger.sources.csv import write_csv
from snapledger.sources.dataset import DEFAULT_ROWS, open_dataset, shown_limit


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="snapledger", description="Dated snapshots of many databases")
    commands = parser.add_subparsers(dest="command", required=True)

    load = commands.add_parser("import", help="load table dumps into dated tables")
    load.add_argument("--input", required=True, help="folder of one source, or of many with --batch")
    load.add_argument("--output", required=True, help="store to load into")
    which = load.add_mutually_exclusive_group()
    which.add_argument("--batch", action="store_true", help="load all sources below the input folder")
    which.add_argument("--latest", action="store_true", help="load the newest source below the input folder")
    load.add_argument("--date", help="snapshot date, instead of the one in the name (yyyy-mm-dd)")
    load.add_argument("--default-date", help="snapshot date where the name has none")
    load.add_argument("--date-mode", default="valid", choices=["valid", "compat", "strict"])
    load.add_argument("--replace", action="store_true", help="replace dates that are loaded already")
    load.add_argument("--text", action="store_true", help="load every column as text")
    load.add_argument("--tables", nargs="+", help="load only these tables")
    load.add_argument("--manifest", help="write a JSON manifest there")

    def viewer(name: str, text: str, table: bool = True) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=text)
        command.add_argument("--dataset", help="folder of tables (default: SNAPLEDGER_DATASET)")
        command.add_argument("--csv", help="write the whole result there as CSV instead of showing rows")
        command.add_argument("--rows", type=int, default=DEFAULT_ROWS, help="rows to show")
        if table:
            command.add_argument("table")
        return command

    viewer("tables", "list the tables with their row counts", table=False)
    viewer("schema", "columns of a table")
    look = viewer("preview", "first rows of a table")
    look.add_argument("--order-by", nargs="+")
    look.add_argument("--filter", type=json.loads, help='JSON: {"column": ..., "op": ..., "value": ...}, or "and", "or", "not" of such')
    look.add_argument("--config", help="folder with declared views: show the table's default view")
    viewer("count", "rows of a table")
    viewer("sql", "run a query", table=False).add_argument("query")
    viewer("build", "run a query given as its parts", table=False).add_argument(
        "parts", type=json.loads, help='JSON: {"table": ..., "filter": ..., "group_by": [...], "aggregates": ..., "sort": ...}')
    find = viewer("search", "find a word, ignoring case and accents")
    find.add_argument("--config", help="folder with declared mappings: search the table's principal fields")
    find.add_argument("word")
    find.add_argument("--columns", nargs="+")
    find.add_argument("--filter", type=json.loads, help="JSON as for preview: search only these rows")
    check = viewer("validate", "check declared rules", table=False)
    check.add_argument("--config", help="folder with declared schemas and rules")
    diff = viewer("compare", "compare with another dataset", table=False)
    diff.add_argument("other")
    diff.add_argument("--table")
    diff.add_argument("--key", nargs="+", help="compare rows of the table by key")
    diff.add_argument("--cells", action="store_true", help="list changed cells")
    history = commands.add_parser("snapshots", help="all dated copies of a table in a store")
    history.add_argument("store")
    history.add_argument("table")
    history.add_argument("--csv")
    history.add_argument("--rows", type=int, default=DEFAULT_ROWS)
    return parser


def run_import(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    options = LoadOptions(
        date_mode=args.date_mode, date_override=args.date, default_date=args.default_date,
        on_conflict="replace" if args.replace else "keep", typing="text" if args.text else "infer",
        tables=tuple(args.tables) if args.tables else None)
    load = batch_import if args.batch else import_latest if args.latest else import_source
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    log = load(spark, args.input, args.output, now, options)
    if args.manifest:
        write_manifest(load_manifest(log, args.output, f"{now:%Y-%m-%dT%H:%M:%SZ}"), args.manifest)
    return log.select("import_id", "source_file", "table_name", "status", "row_count", "message") \
        .orderBy("import_id")


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "import":
        return run_import(spark, args)
    if args.command == "snapshots":
        return open_snapshots(spark, args.store, args.table)
    data = open_dataset(spark, args.dataset)
    if args.command == "tables":
        return data.row_counts().orderBy("table_name")
    if args.command == "schema":
        return data.describe(args.table)
    if args.command == "preview":
        view = read_config(spark, args.config).view(args.table)
        if view:
            return default_view(filter_rows(data.table(args.table), args.filter), view).limit(shown_limit(args.rows))
        if args.filter:
            return build_query(data, {"table": args.table, "filter": args.filter, "limit": shown_limit(args.rows),
                                      "sort": [[name, "asc"] for name in args.order_by or []]})
        return data.preview(args.table, args.rows, args.order_by)
    if args.command == "count":
        return data.view_summary(args.table, args.rows)
    if args.command == "sql":
        return data.sql(args.query)
    if args.command == "build":
        return build_query(data, args.parts)
    if args.command == "search":
        mapping = read_config(spark, args.config).mapping(args.table)
        return search(filter_rows(data.table(args.table), args.filter), args.word, args.columns, mapping=mapping)
    if args.command == "validate":
        config = read_config(spark, args.config)
        return validation_report(data, config.schemas, config.rules)
    other = open_dataset(spark, args.other, prefix="other_")
    if not args.table:
        return compare_tables(data, other).orderBy("table_name")
    left, right = data.table(args.table), other.table(args.table)
    if not args.key:
        return compare_schemas(left, right)
    return compare_cells(left, right, args.key) if args.cells else compare_rows(left, right, args.key)


#: Commands whose result is a row per table, source, column or rule: all of it is shown.
REPORTS = ("import", "tables", "schema", "validate", "snapshots", "count")


def shown(df: DataFrame, rows: int | None, whole: bool) -> None:
    """Print a result, and how much of it that is where it was cut."""
    limit = rows or (2 ** 31 - 2 if whole else DEFAULT_ROWS)
    df.show(limit, truncate=False)
    total = None if whole and not rows else df.count()
    if total is not None and total > limit:
        print(f"Showing {limit} of {total}")


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    try:
        df = result(spark, args)
    except (FileNotFoundError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    if getattr(args, "csv", None):
        write_csv(df, args.csv)
    else:
        shown(df, getattr(args, "rows", None), args.command in REPORTS)
    return 0


if __name__ == "__main__":
    sys.exit(main())
