import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions.text import add_search_key
from snapledger.operators.filters import condition, filter_rows
from snapledger.operators.present import default_view, display_rows, row_keys, rows_as_json
from snapledger.operators.report import explode_results, run_summary
from snapledger.operators.reshape import columns_to_rows, derived_columns, is_ragged, select_by_role
from snapledger.operators.search import search, search_like
from snapledger.plans.builder import build_query
from snapledger.sources.dataset import Dataset, UnknownTable

ROWS = [(1, "Étienne", "a_b", datetime.date(2024, 1, 1), 1.5), (2, "ETIENNE x", None, None, 2.5),
        (3, "other", "etienne", datetime.date(2023, 1, 1), None), (4, None, "100% a", None, -1.0)]
SCHEMA = "id int, name string, note string, day date, v double"


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("spec, expected", [
    ({"column": "id", "op": "=", "value": 2}, [2]), ({"column": "id", "op": "<>", "value": 2}, [1, 3, 4]),
    ({"column": "v", "op": "<", "value": 2}, [1, 4]), ({"column": "v", "op": ">=", "value": 1.5}, [1, 2]),
    ({"column": "v", "op": "<=", "value": -1}, [4]), ({"column": "id", "op": ">", "value": 3}, [4]),
    ({"column": "id", "op": "in", "value": [1, 4, 9]}, [1, 4]), ({"column": "id", "op": "in", "value": []}, []),
    ({"column": "day", "op": "between", "value": [datetime.date(2023, 1, 1), datetime.date(2023, 12, 31)]}, [3]),
    ({"column": "note", "op": "like", "value": "a_b"}, [1]), ({"column": "note", "op": "contains", "value": "%"}, [4]),
    ({"column": "note", "op": "IS_NULL"}, [2]), ({"column": "v", "op": "is_not_null"}, [1, 2, 4]),
    ({"and": []}, [1, 2, 3, 4]), ({"or": []}, []), ({"not": {"column": "id", "op": "=", "value": 1}}, [2, 3, 4]),
    ({"or": [{"column": "id", "op": "=", "value": 4},
             {"and": [{"column": "id", "op": "<", "value": 3}, {"not": {"column": "v", "op": ">", "value": 2}}]}]},
     [1, 4]),
    (None, [1, 2, 3, 4])])
def test_filters(df, spec, expected):
    assert ids(filter_rows(df, spec)) == expected


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    noon = datetime.datetime(2024, 1, 1, 12)
    try:
        for name in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 12:00:00' AS t")
            for test in ({"op": "=", "value": noon}, {"op": "in", "value": [noon]},
                         {"op": "between", "value": [noon, noon]}):
                assert filter_rows(df, {"column": "t", **test}).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unknown_operator():
    with pytest.raises(ValueError):
        condition({"column": "id", "op": "~", "value": 1})


def test_filters_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    hit = filter_rows(orders, {"or": [{"column": "o_orderkey", "op": "in", "value": [1, 2]},
                                      {"column": "o_totalprice", "op": ">", "value": 400000}]})
    plan = hit.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert pushed.startswith("Or(In(o_orderkey") and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_search(df, spark, tmp_path):
    found = search(df, "etiénne").collect()
    assert {r["id"]: r["matched_columns"] for r in found} == {1: ["name"], 2: ["name"], 3: ["note"]}
    assert ids(search(df, "ETIENNE", ["note"])) == [3]
    assert ids(search(df, "100%")) == [4]
    keyed = add_search_key(df, ["name", "note"])
    assert ids(search(keyed, "Étienne", ["name", "note"], "_search")) == [1, 2, 3]
    with pytest.raises(ValueError):
        search(df.select("id"), "x")
    keyed.write.parquet(str(tmp_path / "keyed"))
    plan = search(spark.read.parquet(str(tmp_path / "keyed")), "x", ["name"], "_search").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "note" not in text.split("ReadSchema")[1]


def test_like_parameter_is_only_a_value(df):
    assert ids(search_like(df, "name", "%tienne%")) == [1]
    assert ids(search_like(df, "name", "' OR 1=1 --")) == []


def test_display_and_json(df):
    shown = {r["id"]: tuple(r) for r in display_rows(df).collect()}
    assert shown["2"] == ("2", "ETIENNE x", "", "", "2.5")
    assert rows_as_json(df.where("id = 3")).first()[0] == \
        '{"id":3,"name":"other","note":"etienne","day":"2023-01-01","v":null}'


def test_row_keys(spark):
    rows = [(1, "U1", 5), (2, "", 6), (3, None, 0), (4, None, None)]
    df = spark.createDataFrame(rows, "n int, UNIQID string, id int")
    assert [r["row_key"] for r in row_keys(df, "t", ["n"]).orderBy("n").collect()] == ["U1", "6", "t_2", "t_3"]
    assert [r["row_key"] for r in row_keys(df.select("n"), "t", ["n"], 2).collect()] == ["t_0", "t_1"]


def test_views_and_roles(df):
    view = {"visible_columns": ["v", "id", "name"], "column_order": ["id", "day", "v"],
            "sort_by": "id", "sort_order": "desc"}
    shown = default_view(df, view)
    assert shown.columns == ["id", "v", "name"] and [r["id"] for r in shown.collect()] == [4, 3, 2, 1]
    assert default_view(df, None).columns == df.columns
    roles = {"id_fields": ["id"], "principal_fields": ["name", "code"], "metadata_fields": ["day", "id"]}
    assert select_by_role(df, roles).columns == ["id", "name", "day"]
    assert select_by_role(df, roles, ("principal_fields",)).columns == ["name"]
    assert select_by_role(df, None).columns == df.columns


def test_column_blocks(spark):
    df = spark.createDataFrame([("x", [1, 2, 3], ["a", "b"]), ("y", [], [])], "k string, n array<int>, t array<string>")
    assert [tuple(r) for r in columns_to_rows(df, ["n", "t"]).collect()] == [
        ("x", 1, "a"), ("x", 2, "b"), ("x", 3, None)]
    assert [r[0] for r in df.orderBy("k").select(is_ragged(["n", "t"])).collect()] == [True, False]


def test_derived_columns(df):
    found = derived_columns(df, {"twice": "v * 2", "more": "twice + 1"}).where("id = 1").first()
    assert (found["twice"], found["more"]) == (3.0, 4.0)


def test_builder(spark, df):
    data = Dataset(spark, {"t": df})
    counts = build_query(data, {"table": "t", "derive": {"has": "note IS NOT NULL"}, "group_by": ["has"],
                                "aggregates": {"n": {"function": "count"}, "top": {"function": "max", "column": "id"}},
                                "sort": [["n", "desc"]]})
    assert [tuple(r) for r in counts.collect()] == [(True, 3, 4), (False, 1, 2)]
    rows = build_query(data, {"table": "t", "columns": ["id"], "sort": [["v", "desc"]], "limit": 1})
    assert [tuple(r) for r in rows.collect()] == [(2,)]
    assert build_query(data, {"table": "t", "aggregates": {"n": {"function": "count"}}}).first()["n"] == 4
    assert build_query(data, {"table": "t", "group_by": ["id"]}).count() == 4
    for bad in ({"table": "nope"}, {"table": "t", "where": 1},
                {"table": "t", "aggregates": {"m": {"function": "median", "column": "v"}}},
                {"table": "t", "aggregates": {"m": {"function": "sum"}}}):
        with pytest.raises((ValueError, UnknownTable)):
            build_query(data, bad)


def test_run_reports(spark):
    rows = [("f1", '{"one": {"success": true, "elapsed_time": 1.5}, '
                   '"two": {"success": false, "elapsed_time": 0.5, "error": "no"}}'),
            ("f2", '{"one": {"success": false, "elapsed_time": 2.0, "error": "x"}}'), ("f3", "{}")]
    flat = explode_results(spark.createDataFrame(rows, "file string, r string"), F.col("r"), ["file"])
    assert {tuple(r) for r in flat.collect()} == {
        ("f1", "one", True, 1.5, None), ("f1", "two", False, 0.5, "no"), ("f2", "one", False, 2.0, "x")}
    assert {tuple(r) for r in run_summary(flat).collect()} == {
        ("one", 2, 1, 1, 3.5, 1.75, 50.0), ("two", 1, 0, 1, 0.5, 0.5, 0.0)}
