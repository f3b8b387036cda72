"""What loads and checks must not hide: rows of no dump, blank lines, absent columns, other datasets' tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions.text import add_search_key
from snapledger.operators import rules
from snapledger.operators.compare import compare_tables
from snapledger.operators.search import search
from snapledger.operators.textindex import search_indexed, write_index
from snapledger.plans.load import LoadOptions, batch_import, open_snapshots, search_snapshots
from snapledger.plans.log import read_log
from snapledger.sources.csv import read_csv_text
from snapledger.sources.dataset import Dataset
from snapledger.storage import scratch_dir
from snapledger.workloads.rules import RELATIONS, SCHEMAS

RUN = datetime.datetime(2024, 1, 1)


def dump(root, source, table, text):
    (root / source).mkdir(parents=True, exist_ok=True)
    (root / source / f"{table}.csv").write_text(text)


def outcome(log):
    return {(r["source_file"], r["table_name"]): (r["status"], r["row_count"]) for r in log.collect()}


def test_header_only_dump_does_not_pass_for_the_old_rows(spark, tmp_path):
    root, store = tmp_path / "dumps", str(tmp_path / "store")
    dump(root, "a_2024-01-01", "t", "id,v\n1,x\n2,y\n")
    batch_import(spark, str(root), store, RUN)
    dump(root, "a_2024-01-01", "t", "id,v\n")
    again = batch_import(spark, str(root), store, RUN + datetime.timedelta(days=1), LoadOptions(on_conflict="replace"))
    assert list(outcome(again).values()) == [("EMPTY", 0)]
    dump(root, "a_2024-01-01", "t", "id,v\n3,z\n")
    batch_import(spark, str(root), store, RUN + datetime.timedelta(days=2), LoadOptions(on_conflict="replace"))
    assert [r["id"] for r in open_snapshots(spark, store, "t").collect()] == [3]


def test_several_loads_of_one_schema_are_one_table(spark, tmp_path):
    root, store = tmp_path / "dumps", str(tmp_path / "store")
    for day in (1, 2, 3):
        dump(root, f"a_2024-01-0{day}", "t", f"id,v\n{day},x\n")
        batch_import(spark, str(root), store, RUN + datetime.timedelta(days=day))
    rows = open_snapshots(spark, store, "t")
    assert rows.columns == ["id", "v", "snapshot_date"]
    assert sorted((r["id"], r["snapshot_date"].day) for r in rows.collect()) == [(1, 1), (2, 2), (3, 3)]
    assert [r["import_id"] for r in read_log(spark, f"{store}/import_log").orderBy("import_id").collect()] == list(range(1, 7))


@pytest.mark.parametrize("mode", ["drop", "fail"])
def test_blank_first_line_does_not_lose_a_file(spark, tmp_path, mode):
    for name, text in (("a", "id,v\n1,x\n"), ("b", "\nid,v\n2,y\n"), ("c", "v,id\nz,3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    rows = read_csv_text(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], mode)
    assert sorted((r["id"], r["v"]) for r in rows.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]


def test_identifiers_survive_a_load(spark, tmp_path):
    root, store = tmp_path / "dumps", str(tmp_path / "store")
    dump(root, "a_20101231", "t", "id,zip\n12345678901234567891,00123\n12345678901234567892,00124\n")
    batch_import(spark, str(root), store, RUN)
    rows = open_snapshots(spark, store, "t").orderBy("id").collect()
    assert [(r["id"], r["zip"], r["snapshot_date"]) for r in rows] == [
        ("12345678901234567891", "00123", datetime.date(2010, 12, 31)), ("12345678901234567892", "00124", datetime.date(2010, 12, 31))]


def test_absent_columns_and_tables_are_rows_of_the_report(spark):
    data = Dataset(spark, {"t": spark.createDataFrame([(1, None), (1, "x")], "id int, v string")})
    schemas = {"tables": {"t": {"columns": {"id": {"primary_key": True}, "v": {"nullable": False}, "w": {"nullable": False}}},
                          "gone": {"columns": {"id": {"primary_key": True}}}}}
    relations = {"foreign_keys": {"t": {"id": {"references": "parent.id"}, "x": {"references": "t.id"}}}}
    report = {(r["table_name"], r["rule"], r["column_name"]): r["n_violations"] for r in rules.validation_report(data, schemas, relations).collect()}
    assert report == {("t", "not_null", "id"): 0, ("t", "not_null", "v"): 1, ("t", "primary_key", "id"): 1, ("t", "missing_column", "w"): 1,
                      ("gone", "missing_table", None): 1, ("t", "missing_table", None): 1, ("t", "missing_column", "x"): 1}


def test_lossy_values_do_not_fit(spark):
    df = spark.createDataFrame([(1.5, "10:00", "2020", "7"), (2.0, "2024-01-02", "2024-01-02", "07")], "a double, b string, c string, d string")
    columns = {"a": {"type": "INTEGER"}, "b": {"type": "DATE"}, "c": {"type": "DATE"}, "d": {"type": "VARCHAR(20)"}}
    failed = {r["column_name"]: r["n_failed"] for r in rules.schema_conformance(df, "t", columns).collect()}
    assert failed == {"a": 1, "b": 1, "c": 1, "d": 0}
    assert rules.apply_schema(df, columns).where("a IS NULL AND b IS NULL AND c IS NULL").count() == 1


def test_cascade_along_a_key_to_its_own_table(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)] + [(10, None), (11, 10), (12, 12)], "id int, boss int")
    keys = [rules.ForeignKey("t", "boss", "t", "id", "CASCADE")]
    marked = rules.cascade_delete({"t": df}, keys, {"t": "id = 2"})["t"]
    assert sorted(r["id"] for r in marked.where("deleted").collect()) == [2, 3, 4, 5]
    assert marked.columns == ["id", "boss", "deleted"] and marked.count() == 9


def test_cascade_down_a_deep_chain_writes_no_table(spark, monkeypatch):
    written = []
    kept = rules.materialized
    monkeypatch.setattr(rules, "materialized", lambda df, label: written.append((label, df.columns)) or kept(df, label))
    df = spark.createDataFrame([(i, i - 1 if i % 60 else None, "v" * 20) for i in range(180)], "id int, `in.side` int, v string")
    keys = [rules.ForeignKey("t", "in.side", "t", "id", "CASCADE")]
    marked = rules.cascade_delete({"t": df}, keys, {"t": "id = 70"})["t"]
    assert sorted(r["id"] for r in marked.where("deleted").collect()) == list(range(70, 120))
    assert marked.count() == 180 and marked.columns == ["id", "in.side", "v", "deleted"]
    assert [label for label, _ in written].count("links") == 1
    assert all(set(columns) <= {"__id", "__of", "__gone", "__level", "deleted"} for _, columns in written)


def test_all_rules_of_a_table_take_three_scans_at_most(spark, small, monkeypatch):
    scans = []
    kept = rules.materialized

    def count(df, label=None):
        scans.append(sum("lineitem" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
                         if "FileScan" in line))
        return kept(df, label) if label else None

    monkeypatch.setattr(rules, "materialized", count)
    names = ("orders", "lineitem", "part", "customer")
    tables = {name: spark.read.parquet(f"{small}/{name}.parquet") for name in names}
    report = rules.validation_report(Dataset(spark, tables), SCHEMAS, RELATIONS)
    count(report)
    assert 1 <= sum(scans) <= 3
    assert report.where("rule = 'foreign_key'").count() == 3


def test_a_query_finds_only_its_own_dataset(spark):
    one = Dataset(spark, {"only_here": spark.range(3).toDF("id")})
    other = Dataset(spark, {"elsewhere": spark.range(5).toDF("id")})
    held = one.sql("SELECT count(*) AS n FROM only_here")
    with pytest.raises(Exception, match="only_here"):
        other.sql("SELECT count(*) FROM only_here")
    assert held.first()["n"] == 3


def test_dotted_key_columns(spark):
    df = spark.createDataFrame([(1,), (1,)], "`a.b` int")
    assert rules.duplicate_keys(df, ["a.b"]).select(F.col("n_rows")).first()[0] == 2


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def __init__(self, **values):
            self.get = lambda key, default=None: values.get(key, default)

    session = type("Session", (), {})()
    session.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session, "x")
    session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs:///c"})
    assert scratch_dir(session, "x").startswith("hdfs:///c/x-")


def test_an_index_of_trigrams_skips_files(spark, tmp_path):
    words = ["étude", "Stadt", "garden", "naïve 🙂🙂 x", "ab", "zebra"]
    rows = [(i, f"{words[i % 6]} {i}", "plain") for i in range(600)]
    df = add_search_key(spark.createDataFrame(rows, "id int, text string, kind string"), ["text", "kind"])
    data, index = str(tmp_path / "data"), str(tmp_path / "index")
    df.withColumn("part", F.col("id") % 6).repartition(6, "part").write.partitionBy("part").parquet(data)
    write_index(spark, data, ["text", "kind"], index)
    for word in ("ÉTUDE", "adt", "b 1", "e 🙂🙂", "zebra 59", "plain", "nowhere", "ab", ""):
        got = search_indexed(spark, data, index, word, ["text", "kind"])
        want = search(spark.read.parquet(data), word, ["text", "kind"], "_search")
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), word
    every = len(spark.read.parquet(data).inputFiles())
    assert len(search_indexed(spark, data, index, "étude", ["text"]).inputFiles()) == 1 < every
    assert len(search_indexed(spark, data, index, "plain", ["text"]).inputFiles()) == 0


def test_the_index_of_a_load_is_searched(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    for day, text in (("01", "1,Élan\n2,other\n"), ("02", "3,nothing\n"), ("03", "4,the élan\n")):
        dump(root, f"a_2024-01-{day}", "t", "id,v\n" + text)
        batch_import(spark, str(root), store, RUN + datetime.timedelta(days=int(day)), LoadOptions(search_columns=("v",)))
    found = search_snapshots(spark, store, "t", "ELAN", ["v"])
    assert sorted(r["id"] for r in found.collect()) == [1, 4]
    assert search_snapshots(spark, store, "t", "gone with", ["v"]).count() == 0
    assert search_snapshots(spark, store, "t", "e", ["v"]).count() == 3


def test_declared_types_at_load(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    schemas = {"tables": {"t": {"columns": {"id": {"type": "INTEGER"}, "day": {"type": "DATE"}, "gone": {"type": "TEXT"}}}}}
    options = LoadOptions(schemas=schemas)
    dump(root, "a_2024-01-01", "t", "id,day,v\n1,2024-01-01,7\nx,2020,8\n")
    run = batch_import(spark, str(root), store, RUN, options)
    assert [r["message"] for r in run.collect()] == ["values not of the declared type, in all sources of this load: id: 1, day: 1"]
    dump(root, "a_2024-01-02", "t", "id,day,v\n3,2024-01-02,2.5\n")
    batch_import(spark, str(root), store, RUN + datetime.timedelta(days=1), options)
    df = open_snapshots(spark, store, "t")
    assert dict(df.dtypes) == {"id": "int", "day": "date", "v": "double", "snapshot_date": "date"}
    assert sorted((r["id"] or 0, str(r["day"]), r["v"]) for r in df.collect()) == [(0, "None", 8.0), (1, "2024-01-01", 7.0), (3, "2024-01-02", 2.5)]


def test_names_alone_are_compared_without_opening_a_table(spark, tmp_path):
    left, right = Dataset(spark, {"a": str(tmp_path / "gone.parquet")}), Dataset(spark, {"a": spark.range(2), "b": spark.range(1)})
    found = {(r["table_name"], r["presence"], r["left_rows"]) for r in compare_tables(left, right, counts=False).collect()}
    assert found == {("a", "both", None), ("b", "only_right", None)}
