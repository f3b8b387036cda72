import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.sources.csv import read_csv_text, read_table_dump, write_csv
from snapledger.sources.dataset import UnknownTable, open_dataset
from snapledger.sources.discover import discover_sources, list_source_tables, newest, pick_subset
from snapledger.sources.local import local_frame
from snapledger.storage import list_children, scratch_dir


def test_scratch_goes_to_the_configured_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path != scratch_dir(spark, "x")
    if shared:
        assert path.startswith(shared)


def test_files_with_other_column_orders_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("name,id\nz,3\n")
    (tmp_path / "c.csv").write_text("id,name,extra\n4,w,2024-01-01\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("id,name\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abcde"]
    rows = {(r["id"], r["name"], r["extra"]) for r in read_table_dump(spark, paths).collect()}
    assert rows == {(1, "x", None), (2, "y", None), (3, "z", None), (4, "w", datetime.date(2024, 1, 1))}
    with pytest.raises(ValueError):
        read_csv_text(spark, [str(tmp_path / "d.csv")])


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,name\n1,a\n2\n3,c,z\n4,\n")
    df = read_table_dump(spark, [str(tmp_path / "m.csv")])
    assert {tuple(r) for r in df.collect()} == {(1, "a"), (4, None)}
    # What counts as malformed does not depend on the columns asked for.
    assert df.count() == 2 and df.select("id").count() == 2
    assert dict(df.dtypes)["id"] == "bigint"
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table_dump(spark, [str(tmp_path / "m.csv")], mode="fail").collect()


def test_awkward_values_come_back(spark, tmp_path):
    rows = [(1, 'say "hi"', "a,b"), (2, "two\nlines", "  padded "), (3, None, "back\\slash"),
            (4, "", '"'), (5, "tab\there", "ünï")]
    df = spark.createDataFrame(rows, "id int, `a b` string, c string")
    path = str(tmp_path / "odd [1] +name.csv")
    write_csv(df, path)
    back = {tuple(r) for r in read_table_dump(spark, [path]).collect()}
    # Empty and absent cannot be told apart in a dump.
    assert back == {(i, a or None, c) for i, a, c in rows}


def test_only_files_with_running_values_are_read_multi_line(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,t\n1,plain\n")
    (tmp_path / "two.csv").write_text('id,t\n2,"runs\nover"\n')
    df = read_table_dump(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    assert {tuple(r) for r in df.collect()} == {(1, "plain"), (2, "runs\nover")}


def test_header_names_are_made_safe(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"Order No",2nd,order-no\n1,2,3\n')
    df = read_csv_text(spark, [str(tmp_path / "h.csv")])
    assert df.columns == ["Order_No", "T_2nd", "order_no_2"]


def dump(root, source, table, text):
    folder = root / source
    folder.mkdir(exist_ok=True)
    (folder / f"{table}.csv").write_text(text)


def test_discovery(spark, tmp_path):
    dump(tmp_path, "a_01_02_2020", "t", "id\n1\n")
    dump(tmp_path, "a_02_02_2020", "t", "id\n1\n")
    dump(tmp_path, "a_02_02_2020", "zero", "")
    (tmp_path / "a_02_02_2020" / "notes.txt").write_text("x")
    files = discover_sources(spark, str(tmp_path))
    tables = {(r["source_file"], r["table_name"]): r["n_bytes"] for r in list_source_tables(files).collect()}
    assert set(tables) == {("a_01_02_2020", "t"), ("a_02_02_2020", "t"), ("a_02_02_2020", "zero")}
    assert tables["a_02_02_2020", "zero"] == 0
    notes = pick_subset(list_source_tables(files), ["t", "zero", "gone"]).collect()
    assert {r["table_name"]: r["note"] for r in notes} == {"t": "FOUND", "zero": "EMPTY", "gone": "MISSING"}
    typed = local_frame(spark, [("s", "t", "TABLE", 1, "s/t"), ("s", "v", "VIEW", 1, "s/v")],
                        "source_file string, table_name string, table_type string, length bigint, location string")
    typed = typed.withColumn("modified_at", F.lit(None).cast("timestamp"))
    assert [r["table_name"] for r in list_source_tables(typed, "TABLE").collect()] == ["t"]
    with pytest.raises(FileNotFoundError):
        discover_sources(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bare").mkdir()
    assert discover_sources(spark, str(tmp_path / "bare")).count() == 0


def test_newest(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "w")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert {tuple(r) for r in newest(df, ["t", "v"], ["k"]).collect()} == {("a", 3, "z"), ("b", None, "w")}
    assert [tuple(r) for r in newest(df, ["t", "v"]).collect()] == [("a", 3, "z")]
    assert newest(df.where("false"), ["t"]).count() == 0


@pytest.fixture
def dataset_dir(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "ID int, NAME string")
    df.write.parquet(str(tmp_path / "sample.parquet"))
    df.write.orc(str(tmp_path / "copy.orc"))
    df.write.json(str(tmp_path / "lines.json"))
    write_csv(df, str(tmp_path / "dump.csv"))
    (tmp_path / "readme.txt").write_text("x")
    return str(tmp_path)


def test_open_dataset(spark, dataset_dir, monkeypatch):
    data = open_dataset(spark, dataset_dir)
    assert data.tables == ["copy", "dump", "lines", "sample"]
    assert [r[0] for r in data.list_tables().collect()] == data.tables
    for name in data.tables:
        shown = data.preview(name, 1).count()
        total = data.count(name).first()["row_count"]
        assert (shown, total) == (1, 2)
        assert sorted(r["NAME"] for r in data.table(name).collect()) == ["Alpha", "Beta"]
    assert [(r["column_name"], r["column_type"]) for r in data.describe("sample").collect()] == [
        ("ID", "INTEGER"), ("NAME", "VARCHAR")]
    assert data.view_summary("sample", 5).first()["summary"] == "Showing 2 of 2 rows"
    monkeypatch.setenv("SNAPLEDGER_DATASET", dataset_dir)
    assert open_dataset(spark).tables == data.tables


def test_what_cannot_be_opened(spark, dataset_dir, tmp_path_factory):
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, dataset_dir + "/nowhere")
    other = tmp_path_factory.mktemp("other")
    (other / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        open_dataset(spark, str(other))
    with pytest.raises(ValueError):
        open_dataset(spark)
    data = open_dataset(spark, dataset_dir)
    for call in (data.table, data.describe, data.preview, data.count):
        with pytest.raises(UnknownTable):
            call("sample; drop table sample")


def test_limits(spark, small):
    data = open_dataset(spark, small)
    assert data.preview("orders").count() == 100
    assert data.preview("orders", 0).count() == 100
    assert data.preview("orders", -5).count() == 100
    assert data.preview("orders", 7).count() == 7
    assert data.preview("orders", 3, ["o_orderkey"]).count() == 3


def test_sql_reads_only(spark, dataset_dir, tmp_path):
    data = open_dataset(spark, dataset_dir)
    found = data.sql("SELECT NAME FROM sample WHERE ID = :id -- the one\n;", id=2).collect()
    assert [r[0] for r in found] == ["Beta"]
    ordered = data.sql("WITH t AS (SELECT * FROM sample) SELECT ID FROM t ORDER BY ID DESC").collect()
    assert [r[0] for r in ordered] == [2, 1]
    for statement in ("DROP VIEW sample", "CREATE TABLE x AS SELECT 1", "INSERT INTO sample VALUES (1, 'x')",
                      f"INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING parquet SELECT 1"):
        with pytest.raises(Exception):
            data.sql(statement).collect()


def test_opening_again_sees_the_other_dataset(spark, dataset_dir, tmp_path_factory):
    other = tmp_path_factory.mktemp("second")
    spark.range(5).write.parquet(str(other / "sample.parquet"))
    open_dataset(spark, dataset_dir).sql("SELECT * FROM sample").collect()
    assert open_dataset(spark, str(other)).sql("SELECT count(*) FROM sample").first()[0] == 5
    both = open_dataset(spark, dataset_dir, prefix="old_")
    assert both.sql("SELECT count(*) FROM old_sample").first()[0] == 2


def test_list_children(spark, dataset_dir):
    assert [n for n, _, _ in list_children(spark, dataset_dir)] == [
        "copy.orc", "dump.csv", "lines.json", "readme.txt", "sample.parquet"]
