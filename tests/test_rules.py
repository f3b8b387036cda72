import pytest

from snapledger.operators.rules import (ForeignKey, apply_schema, cascade_delete, cascade_summary,
                                        declared_columns, duplicate_keys, foreign_keys, null_and_key_check,
                                        orphan_keys, orphan_report, orphan_rows, schema_conformance,
                                        validation_report)
from snapledger.sources.dataset import Dataset

# The shape and keywords of declared schemas and relations.
SCHEMAS = {"tables": {"table1": {"columns": {
    "id": {"type": "INTEGER", "primary_key": True}, "name": {"type": "TEXT", "nullable": False},
    "created_at": {"type": "TIMESTAMP"}, "absent": {"type": "DECIMAL(10,2)"}}}}}
RULES = {"foreign_keys": {"table2": {"parent_id": {"references": "table1.id", "on_delete": "CASCADE"}}}}


@pytest.fixture
def table1(spark):
    rows = [("1", "a", "2024-01-01 10:00:00"), ("2", None, "soon"), ("2", "c", None), ("x", "d", "2024-02-30"),
            (None, "e", "2024-01-01")]
    return spark.createDataFrame(rows, "id string, name string, created_at string")


def test_schema(table1):
    columns = declared_columns(SCHEMAS, "table1")
    report = {r["column_name"]: (r["declared_type"], r["n_values"], r["n_failed"])
              for r in schema_conformance(table1, "table1", columns).collect()}
    assert report == {"id": ("INTEGER", 4, 1), "name": ("TEXT", 4, 0), "created_at": ("TIMESTAMP", 4, 2),
                      "absent": ("DECIMAL(10,2)", None, None)}
    cast = apply_schema(table1, columns)
    assert dict(cast.dtypes) == {"id": "int", "name": "string", "created_at": "timestamp_ntz"}
    assert sorted(r["id"] or -1 for r in cast.collect()) == [-1, -1, 1, 2, 2]
    with pytest.raises(ValueError):
        apply_schema(table1, {"id": {"type": "MONEYBAG"}})


def test_keys_and_nulls(table1):
    report = {(r["rule"], r["column_name"]): r["n_violations"]
              for r in null_and_key_check(table1, "table1", declared_columns(SCHEMAS, "table1")).collect()}
    assert report == {("not_null", "id"): 1, ("not_null", "name"): 1, ("primary_key", "id"): 1}
    assert [tuple(r) for r in duplicate_keys(table1, ["id"]).collect()] == [("2", 2)]


def test_nothing_declared_is_no_error(table1, spark):
    assert declared_columns(None, "t") == {} and foreign_keys(None) == []
    assert null_and_key_check(table1, "t", {}).count() == 0
    assert validation_report(Dataset(spark, {"t": table1}), None, None).count() == 0
    assert apply_schema(table1, {}).columns == table1.columns


def test_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, "a"), (9, "b"), (9, "c"), (None, "d"), (8, "e")], "parent_id int, v string")
    assert {tuple(r) for r in orphan_keys(child, "parent_id", parent, "id").collect()} == {(9, 2), (8, 1)}
    assert {r["v"] for r in orphan_rows(child, "parent_id", parent, "id").collect()} == {"b", "c", "e"}
    report = orphan_report({"table1": parent, "table2": child}, foreign_keys(RULES)).first()
    assert (report["n_values"], report["n_rows"]) == (2, 3)


def test_validation_report(spark, table1):
    child = spark.createDataFrame([("1",), ("7",)], "parent_id string")
    report = validation_report(Dataset(spark, {"table1": table1, "table2": child}), SCHEMAS, RULES)
    rows = {(r["table_name"], r["rule"], r["column_name"]): r["n_violations"] for r in report.collect()}
    assert rows["table2", "foreign_key", "parent_id"] == 1
    assert rows["table1", "type", "created_at"] == 2 and rows["table1", "primary_key", "id"] == 1


def test_cascade_over_levels_and_two_parents(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 1)], "id int, a_id int"),
        "c": spark.createDataFrame([(100, 10, 3), (101, 11, 2), (102, 11, 1), (103, None, None)],
                                   "id int, b_id int, a_id int"),
        "d": spark.createDataFrame([(1, 10)], "id int, b_id int")}
    keys = [ForeignKey("c", "b_id", "b", "id", "CASCADE"), ForeignKey("b", "a_id", "a", "id", "CASCADE"),
            ForeignKey("c", "a_id", "a", "id", "CASCADE"), ForeignKey("d", "b_id", "b", "id", "RESTRICT")]
    marked = cascade_delete(tables, keys, {"a": "id = 1"})
    fallen = {name: {r["id"] for r in df.where("deleted").collect()} for name, df in marked.items()}
    assert fallen == {"a": {1}, "b": {10, 13}, "c": {100, 102}}
    assert {name: df.count() for name, df in marked.items()} == {"a": 3, "b": 4, "c": 4}
    assert {r["table_name"]: (r["n_deleted"], r["n_kept"]) for r in cascade_summary(marked).collect()} == {
        "a": (1, 2), "b": (2, 2), "c": (2, 2)}
    part = cascade_delete(tables, keys, {"b": "id = 11"})
    assert {r["id"] for r in part["c"].where("deleted").collect()} == {101, 102}
