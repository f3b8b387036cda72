import datetime
import os

import pytest
from pyspark.sql import functions as F

from snapledger.operators.history import union_snapshots
from snapledger.operators.search import search
from snapledger.plans import log as load_log
from snapledger.plans.accounting import load_accounting
from snapledger.plans.load import (LoadOptions, batch_import, import_latest, load_if_absent, load_snapshot, log_path,
                                   open_snapshots, rejects_path, unite)
from snapledger.plans.log import import_summary, load_manifest, read_log, write_manifest
from snapledger.streaming.incremental import import_new

RUN = datetime.datetime(2024, 1, 15, 12)
DAY = datetime.timedelta(days=1)


def dump(root, source, table, text):
    folder = root / source
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{table}.csv").write_text(text)


def statuses(run):
    return {(r["source_file"], r["base_table"]): (r["status"], r["row_count"]) for r in run.collect()}


def date(text):
    return datetime.date.fromisoformat(text)


def test_first_load_wins_and_is_told(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,v\n1,old\n")
    dump(root, "b_01_02_2020", "t", "id,v\n9,rival\n8,rival\n")
    run = batch_import(spark, str(root), store, RUN)
    assert statuses(run) == {("a_01_02_2020", "t"): ("OK", 1), ("b_01_02_2020", "t"): ("SKIPPED_EXISTS", None)}
    dump(root, "a_01_02_2020", "t", "id,v\n1,new\n2,new\n")
    again = batch_import(spark, str(root), store, RUN + DAY)
    assert {s for s, _ in statuses(again).values()} == {"SKIPPED_EXISTS"}
    assert [tuple(r) for r in open_snapshots(spark, store, "t").collect()] == [(1, "old", date("2020-02-01"))]
    entries = read_log(spark, log_path(store)).orderBy("import_id").collect()
    assert [r["import_id"] for r in entries] == [1, 2, 3, 4]
    assert entries[0]["table_name"] == "t_20200201" and entries[0]["date_suffix"] == "20200201"


def test_replace_takes_the_last(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    options = LoadOptions(on_conflict="replace")
    dump(root, "a_01_02_2020", "t", "id,v\n1,old\n2,old\n")
    dump(root, "a_02_02_2020", "t", "id,v\n5,kept\n")
    batch_import(spark, str(root), store, RUN, options)
    dump(root, "a_01_02_2020", "t", "id,v\nx1,new\n")
    (root / "a_02_02_2020" / "t.csv").unlink()
    batch_import(spark, str(root), store, RUN + DAY, options)
    rows = {tuple(r) for r in open_snapshots(spark, store, "t").collect()}
    # The new copy has another type: it lies in another folder, and the old copy is out of sight.
    assert rows == {("x1", "new", date("2020-02-01")), ("5", "kept", date("2020-02-02"))}
    with pytest.raises(ValueError):
        LoadOptions(on_conflict="merge")


def test_schema_drift_between_dumps(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,v\n1,10\n")
    batch_import(spark, str(root), store, RUN)
    dump(root, "a_02_02_2020", "t", "v,id,w\n1.5,2,x\n")
    batch_import(spark, str(root), store, RUN + DAY)
    df = open_snapshots(spark, store, "t")
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "w": "string", "snapshot_date": "date"}
    rows = {(r["id"], r["v"], r["w"]) for r in df.collect()}
    assert rows == {(1, 10.0, None), (2, 1.5, "x")}
    pruned = df.where(F.col("snapshot_date") == date("2020-02-02"))
    assert [r["id"] for r in pruned.collect()] == [2]
    with pytest.raises(ValueError):
        open_snapshots(spark, store, "unknown")


def test_one_bad_source_does_not_stop_the_others(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,v\n1,x\n")
    dump(root, "a_02_02_2020", "t", "id,v\n1,x,surplus\n")
    dump(root, "a_02_02_2020", "u", "id\n1\n2\n")
    dump(root, "a_02_02_2020", "z", "")
    dump(root, "a_02_02_2020", "h", "id,v\n")
    dump(root, "undated", "t", "id,v\n1,x\n")
    dump(root, "a_32_13_2020", "t", "id,v\n1,x\n")
    run = batch_import(spark, str(root), store, RUN, LoadOptions(read_mode="fail"))
    found = statuses(run)
    assert found.pop(("a_02_02_2020", "t"))[0] == "ERROR"
    assert found == {
        ("a_01_02_2020", "t"): ("OK", 1), ("a_02_02_2020", "u"): ("OK", 2),
        ("a_02_02_2020", "z"): ("EMPTY", 0), ("a_02_02_2020", "h"): ("EMPTY", 0),
        ("undated", "t"): ("ERROR", None), ("a_32_13_2020", "t"): ("ERROR", None)}
    assert open_snapshots(spark, store, "t").count() == 1
    summary = import_summary(run).first()
    assert (summary["tables_imported"], summary["total_rows"], summary["n_empty"], summary["n_failed"]) \
        == (2, 3, 2, 3)


def test_options(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "undated", "Order Details", "id,v\n007,x\n")
    dump(root, "undated", "Order-Details", "id,v\n8,y\n")
    dump(root, "undated", "other", "id\n1\n")
    options = LoadOptions(default_date="2021-05-06", typing="text", tables=("Order Details", "Order-Details"))
    run = batch_import(spark, str(root), store, RUN, options)
    assert {r["base_table"] for r in run.collect()} == {"Order Details", "Order-Details"}
    assert {r["table_name"] for r in run.collect()} == {"Order_Details_20210506"}
    assert [tuple(r) for r in open_snapshots(spark, store, "Order Details").collect()] == [
        ("007", "x", date("2021-05-06"))]
    assert [r["id"] for r in open_snapshots(spark, store, "Order-Details").collect()] == ["8"]
    other = batch_import(spark, str(root), str(tmp_path / "s2"), RUN, LoadOptions(date_override="2022-01-01"))
    assert {r["file_date"] for r in other.collect()} == {date("2022-01-01")}


def test_later_loads_keep_the_types_while_they_fit(spark, tmp_path, monkeypatch):
    import snapledger.plans.load as load
    root, store = tmp_path / "in", str(tmp_path / "store")
    calls = []
    scanned = load.text_masks
    monkeypatch.setattr(load, "text_masks", lambda *a: calls.append(1) or scanned(*a))

    def add(day, text):
        dump(root, f"a_{day}_02_2020", "t", "id,v,d\n" + text)
        statuses = batch_import(spark, str(root), store, RUN + int(day) * DAY)
        return {r["status"] for r in statuses.collect()}, len(calls)

    assert add("01", "1,1.5,2024-01-01\n") == ({"OK"}, 1)
    # Whole numbers fit a double, and a column without values any type.
    assert add("02", "2,7,\n,,\n")[1] == 1
    types = dict(open_snapshots(spark, store, "t").dtypes)
    assert (types["id"], types["v"], types["d"]) == ("bigint", "double", "date")
    # A cast would take these, cutting the time off; the shape of the value says otherwise. What types hold
    # old and new values is known from the masks of both, without another scan.
    assert add("03", "3,2,2024-01-01 10:00:00\n")[1] == 1
    assert add("04", "x4,2,2024-01-05\n")[1] == 1
    df = open_snapshots(spark, store, "t")
    types = dict(df.dtypes)
    assert (types["id"], types["v"], types["d"]) == ("string", "double", "timestamp_ntz")
    rows = {(r["id"], r["v"], str(r["d"])) for r in df.collect()}
    assert rows == {("1", 1.5, "2024-01-01 00:00:00"), ("2", 7.0, "None"), (None, None, "None"),
                    ("3", 2.0, "2024-01-01 10:00:00"), ("x4", 2.0, "2024-01-05 00:00:00")}


def test_search_keys_are_stored_at_load(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,name,note\n1,Étienne,x\n2,other,étienne\n")
    dump(root, "a_02_02_2020", "t", "id,name,note\n3,ETIENNE,x\n")
    options = LoadOptions(search_columns=("name", "absent", "id"))
    batch_import(spark, str(root), store, RUN, options)
    df = open_snapshots(spark, store, "t")
    assert df.columns == ["id", "name", "note", "name_search", "snapshot_date"]
    assert sorted(r["id"] for r in search(df, "étiennE", ["name"], "_search").collect()) == [1, 3]


def test_newest_source(spark, tmp_path):
    root = tmp_path / "in"
    for day, age in (("01_02_2020", 100), ("02_02_2020", 300), ("03_02_2020", 200)):
        dump(root, f"a_{day}", "t", "id\n1\n")
        os.utime(root / f"a_{day}" / "t.csv", (10**9 - age, 10**9 - age))
    run = import_latest(spark, str(root), str(tmp_path / "store"), RUN)
    assert [r["source_file"] for r in run.collect()] == ["a_01_02_2020"]
    (tmp_path / "bare").mkdir()
    with pytest.raises(FileNotFoundError):
        import_latest(spark, str(tmp_path / "bare"), str(tmp_path / "store"), RUN)


def test_a_column_named_like_the_partition_column(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,snapshot_date\n1,later\n")
    batch_import(spark, str(root), store, RUN)
    row = open_snapshots(spark, store, "t").first()
    assert row["snapshot_date_2"] == "later" and row["snapshot_date"] == date("2020-02-01")


def test_load_of_a_frame_counts_while_writing(spark, tmp_path):
    path, rows = load_snapshot(spark.range(10), str(tmp_path), "t", "2020-01-01")
    assert rows == 10
    again, rows = load_snapshot(spark.range(4), str(tmp_path), "t", "2020-01-01")
    load_snapshot(spark.range(3), str(tmp_path), "t", "2020-01-02")
    assert again == path and rows == 4 and spark.read.parquet(path).count() == 7
    load_if_absent(spark.range(1), str(tmp_path / "once"))
    load_if_absent(spark.range(9), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1


def test_manifest(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id\n1\n")
    dump(root, "a_01_02_2020", "u", "id\n1\n")
    run = batch_import(spark, str(root), store, RUN)
    write_manifest(load_manifest(run, store, "2024-01-15T12:00:00Z"), f"{store}/manifest")
    row = spark.read.json(f"{store}/manifest").first()
    assert row["tables"] == ["t_20200201", "u_20200201"] and row["table_count"] == 2


def test_streamed_import_takes_up_only_what_is_new(spark, tmp_path):
    root, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    times = iter(RUN + i * DAY for i in range(10))

    def run():
        import_new(spark, str(root), store, checkpoint, lambda: next(times)).awaitTermination()
        return read_log(spark, log_path(store)).count()

    dump(root, "a_01_02_2020", "t", "id\n1\n")
    assert run() == 1
    dump(root, "a_02_02_2020", "t", "id\n2\n3\n")
    dump(root, "b_01_02_2020", "t", "id\n7\n")
    assert run() == 3
    assert run() == 3
    assert sorted(r["id"] for r in open_snapshots(spark, store, "t").collect()) == [1, 2, 3]
    log = read_log(spark, log_path(store))
    assert log.where(F.col("status") == load_log.SKIPPED).count() == 1


def test_union_of_snapshots(spark):
    old = spark.createDataFrame([(1, 5)], "id int, n int")
    new = spark.createDataFrame([(2, 2.5, "x")], "id bigint, n double, w string")
    df = union_snapshots({"2020-01-01": old, "2020-01-02": new})
    assert dict(df.dtypes) == {"id": "bigint", "n": "double", "w": "string", "snapshot_date": "date"}
    assert {tuple(r[c] for c in ("id", "n", "w")) for r in df.collect()} == {(1, 5.0, None), (2, 2.5, "x")}
    assert unite([old]).columns == ["id", "n"]


def test_masks_of_loads_widen_without_loss(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    for day, text in (("01", "1,5\n"), ("02", "12345678901234567,7\n"), ("03", "2.5,6.5\n")):
        dump(root, f"a_{day}_02_2020", "t", "id,v\n" + text)
        batch_import(spark, str(root), store, RUN + int(day) * DAY)
    df = open_snapshots(spark, store, "t")
    # No double holds 17 digits, so ids become text; the others fit one.
    assert dict(df.dtypes) == {"id": "string", "v": "double", "snapshot_date": "date"}
    assert {(r["id"], r["v"]) for r in df.collect()} == {("1", 5.0), ("12345678901234567", 7.0), ("2.5", 6.5)}


def test_text_and_typed_loads_of_one_table(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id\n007\n")
    batch_import(spark, str(root), store, RUN, LoadOptions(typing="text"))
    dump(root, "a_02_02_2020", "t", "id\n8\n")
    batch_import(spark, str(root), store, RUN + DAY)
    assert {r["id"] for r in open_snapshots(spark, store, "t").collect()} == {"007", "8"}


def part(root, source, table, name, text, age=0):
    folder = root / source / f"{table}.csv"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text(text)
    os.utime(folder / f"{name}.csv", (10**9 - age, 10**9 - age))


@pytest.mark.parametrize("conflict", ["keep", "replace"])
def test_late_part_files_are_added_once(spark, tmp_path, conflict):
    root, store, options = tmp_path / "in", str(tmp_path / "store"), LoadOptions(on_conflict=conflict)
    times, checkpoints = iter(RUN + i * DAY for i in range(20)), iter(str(tmp_path / f"c{i}") for i in range(9))

    def stream(checkpoint):
        import_new(spark, str(root), store, checkpoint, lambda: next(times), options).awaitTermination()
        return sorted(r["id"] for r in open_snapshots(spark, store, "t").collect())

    first = next(checkpoints)
    part(root, "a_01_02_2020", "t", "p1", "id,v\n1,x\n2,y\n")
    assert stream(first) == [1, 2]
    # One is older than what was loaded, one has its columns the other way round.
    part(root, "a_01_02_2020", "t", "p2", "id,v\n3,z\n", age=500)
    part(root, "a_01_02_2020", "t", "p3", "v,id\nw,4\n")
    assert stream(first) == [1, 2, 3, 4]
    assert stream(first) == [1, 2, 3, 4]
    # All of it comes again, as after a lost checkpoint.
    assert stream(next(checkpoints)) == [1, 2, 3, 4]
    part(root, "a_01_02_2020", "t", "p4", "id,v\n5,only\nbroken\n")
    batch_import(spark, str(root), store, next(times), options)
    assert sorted(r["id"] for r in open_snapshots(spark, store, "t").collect()) == [1, 2, 3, 4, 5]
    last = read_log(spark, log_path(store)).orderBy(F.col("import_id").desc()).first()
    assert (last["row_count"], last["n_dropped"], last["adds"]) == (1, 1, True)


def test_a_dump_written_anew_is_no_late_part(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    part(root, "a_01_02_2020", "t", "p1", "id\n1\n")
    batch_import(spark, str(root), store, RUN)
    (root / "a_01_02_2020" / "t.csv" / "p1.csv").unlink()
    part(root, "a_01_02_2020", "t", "q1", "id\n7\n")
    assert {r["status"] for r in batch_import(spark, str(root), store, RUN + DAY).collect()} == {"SKIPPED_EXISTS"}
    assert [r["id"] for r in open_snapshots(spark, store, "t").collect()] == [1]
    batch_import(spark, str(root), store, RUN + 2 * DAY, LoadOptions(on_conflict="replace"))
    assert [r["id"] for r in open_snapshots(spark, store, "t").collect()] == [7]


def test_a_load_that_died_before_its_log_entry_is_done_over(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "in", str(tmp_path / "store")
    part(root, "a_01_02_2020", "t", "p1", "id\n1\nbad,line\n")
    with monkeypatch.context() as patch:
        patch.setattr(load_log, "append_log", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            batch_import(spark, str(root), store, RUN)
    assert read_log(spark, log_path(store)).count() == 0
    run = batch_import(spark, str(root), store, RUN + DAY)
    assert statuses(run) == {("a_01_02_2020", "t"): ("OK", 1)}
    assert open_snapshots(spark, store, "t").count() == 1
    assert [r["record"] for r in load_log.read_rejects(spark, rejects_path(store), run).collect()] == ["bad,line"]


def test_tables_without_bytes_are_logged_once_by_a_stream(spark, tmp_path):
    root, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "c")
    times = iter(RUN + i * DAY for i in range(9))
    dump(root, "a_01_02_2020", "z", "")
    for _ in range(2):
        import_new(spark, str(root), store, checkpoint, lambda: next(times)).awaitTermination()
    assert statuses(read_log(spark, log_path(store))) == {("a_01_02_2020", "z"): ("EMPTY", 0)}
    assert read_log(spark, log_path(store)).count() == 1


def test_every_record_is_accounted_for(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    dump(root, "a_01_02_2020", "t", "id,v\n1,x\n2\n3,y,z\n4,\"p\nq\"\n")
    dump(root, "a_01_02_2020", "broken", "id,v\n1,x\n2,\"open\n3,y\n")
    dump(root, "b_01_02_2020", "t", "id,v\n9,x\n")
    dump(root, "undated", "u", "id\n1\n2\n")
    dump(root, "a_01_02_2020", "h", "id\n")
    run = batch_import(spark, str(root), store, RUN)
    message = {r["base_table"]: r["message"] for r in run.collect()}["broken"]
    assert "broken.csv line 3" in message
    got = {(r["source_file"], r["table_name"]): tuple(r)[2:] for r in load_accounting(spark, str(root), store).collect()}
    assert got == {("a_01_02_2020", "t"): ("OK", 4, 2, 2, 0, 0, 0), ("a_01_02_2020", "broken"): ("ERROR", 2, 0, 0, 2, 0, 0),
                   ("b_01_02_2020", "t"): ("SKIPPED_EXISTS", 1, 0, 0, 0, 1, 0),
                   ("undated", "u"): ("ERROR", 2, 0, 0, 2, 0, 0), ("a_01_02_2020", "h"): ("EMPTY", 0, 0, 0, 0, 0, 0)}
