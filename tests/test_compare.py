import collections
import random

import pytest

from snapledger.operators.compare import (compare_cells, compare_multiset, compare_rows, compare_schemas,
                                          compare_summary, compare_tables)
from snapledger.operators.filters import filter_rows
from snapledger.operators.history import record_history, union_snapshots
from snapledger.sources.dataset import Dataset

SCHEMA = "k int, j string, a int, b string"


def random_rows(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(12)]), rnd.choice(["x", "y", None]), rnd.choice([None, 1, 2]),
             rnd.choice([None, "", "p", "q"])) for _ in range(n)]


def expected_rows(left, right):
    sides = [collections.defaultdict(collections.Counter) for _ in "lr"]
    for side, rows in zip(sides, (left, right)):
        for k, j, a, b in rows:
            side[k, j][a, b] += 1
    result = {}
    for key in set(sides[0]) | set(sides[1]):
        old, new = sides[0][key], sides[1][key]
        status = "added" if not old else "removed" if not new else "same" if old == new else "changed"
        result[key] = (status, sum(old.values()), sum(new.values()))
    return result


@pytest.mark.parametrize("seed", range(4))
def test_rows_against_brute_force(spark, seed):
    """Keys repeat and are NULL at times, and so are the values."""
    left, right = random_rows(seed, 40), random_rows(seed + 100, 40)
    df = compare_rows(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k", "j"])
    assert {(r["k"], r["j"]): (r["status"], r["n_left"], r["n_right"]) for r in df.collect()} \
        == expected_rows(left, right)


@pytest.mark.parametrize("seed", range(4))
def test_cells_against_brute_force(spark, seed):
    left, right = random_rows(seed, 30), random_rows(seed + 100, 30)
    status = expected_rows(left, right)
    expected = collections.Counter()
    for key, (what, n_left, n_right) in status.items():
        if what != "changed":
            continue
        for i, name in ((2, "a"), (3, "b")):
            def text(row):
                return None if row[i] is None else str(row[i])
            old = collections.Counter(text(r) for r in left if r[:2] == key)
            new = collections.Counter(text(r) for r in right if r[:2] == key)
            if n_left == n_right == 1:
                (before,), (after,) = old, new
                if before != after:
                    expected[*key, name, before, after, 1] += 1
            else:
                for value in set(old) | set(new):
                    n = new[value] - old[value]
                    if n:
                        expected[*key, name, value if n < 0 else None, value if n > 0 else None, abs(n)] += 1
    df = compare_cells(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k", "j"])
    found = collections.Counter(
        (r["k"], r["j"], r["column_name"], r["old_value"], r["new_value"], r["n_cells"]) for r in df.collect())
    assert found == expected


@pytest.mark.parametrize("seed", range(2))
def test_multiset_against_brute_force(spark, seed):
    left, right = random_rows(seed, 60), random_rows(seed + 100, 50)
    old, new = collections.Counter(left), collections.Counter(right)
    expected = {(*row, "added" if new[row] > old[row] else "removed"): abs(new[row] - old[row])
                for row in set(old) | set(new) if old[row] != new[row]}
    df = compare_multiset(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert {tuple(r)[:5]: r["n_copies"] for r in df.collect()} == expected


def test_nothing_differs_from_itself(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    assert [r["status"] for r in compare_summary(orders, orders, ["o_orderkey"]).collect()] == ["same"]
    assert compare_cells(orders, orders, ["o_orderkey"]).count() == 0
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert compare_multiset(lines, lines).count() == 0


def test_sides_swap(spark):
    left, right = random_rows(1, 40), random_rows(2, 40)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    there = {(r["k"], r["j"]): r["status"] for r in compare_rows(a, b, ["k", "j"]).collect()}
    back = {(r["k"], r["j"]): r["status"] for r in compare_rows(b, a, ["k", "j"]).collect()}
    turned = {"added": "removed", "removed": "added"}
    assert back == {key: turned.get(status, status) for key, status in there.items()}


def test_null_is_told_from_its_neighbour(spark):
    """Hashing passes over NULLs: (NULL, 'x') and ('x', NULL) must still differ."""
    schema = "k int, a string, b string"
    left = spark.createDataFrame([(1, None, "x"), (2, "x", None)], schema)
    right = spark.createDataFrame([(1, "x", None), (2, "x", None)], schema)
    assert {r["k"]: r["status"] for r in compare_rows(left, right, ["k"]).collect()} == {1: "changed", 2: "same"}


def test_nested_values(spark):
    schema = "k int, m map<string,int>, l array<struct<x:int,y:string>>"
    left = spark.createDataFrame([(1, {"a": 1, "b": 2}, [(1, None)]), (2, {"a": 1}, []), (3, None, None)], schema)
    right = spark.createDataFrame([(1, {"b": 2, "a": 1}, [(1, None)]), (2, {"a": 2}, []), (3, None, [])], schema)
    assert {r["k"]: r["status"] for r in compare_rows(left, right, ["k"]).collect()} \
        == {1: "same", 2: "changed", 3: "changed"}
    cells = {(r["k"], r["column_name"]): (r["old_value"], r["new_value"])
             for r in compare_cells(left, right, ["k"]).collect()}
    assert cells == {(2, "m"): ('[{"key":"a","value":1}]', '[{"key":"a","value":2}]'), (3, "l"): (None, "[]")}
    assert compare_multiset(left, right).count() == 4


def test_types_that_differ_are_compared_as_the_wider(spark):
    left = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    right = spark.createDataFrame([(1, 5.0), (2, 6.5)], "k bigint, v double")
    assert {r["k"]: r["status"] for r in compare_rows(left, right, ["k"]).collect()} == {1: "same", 2: "changed"}
    cells = compare_cells(left, right, ["k"]).collect()
    assert [(r["old_value"], r["new_value"]) for r in cells] == [("6.0", "6.5")]


def test_many_copies_of_one_key(spark):
    """One key with most of the rows: sums of hash pieces neither overflow nor lose a difference."""
    hot = spark.range(200_000).selectExpr("CAST(0 AS BIGINT) AS k", "id % 7 AS v")
    rest = spark.range(1, 1000).selectExpr("id AS k", "id AS v")
    left = hot.union(rest)
    assert {r["status"] for r in compare_summary(left, left, ["k"]).collect()} == {"same"}
    other = hot.where("v <> 3").union(hot.where("v = 3").selectExpr("k", "v + 1 AS v")).union(rest)
    found = {r["status"]: r["n_keys"] for r in compare_summary(left, other, ["k"]).collect()}
    assert found == {"same": 999, "changed": 1}
    cells = compare_cells(left, other, ["k"]).collect()
    assert {(r["old_value"], r["new_value"], r["n_cells"]) for r in cells} == {
        ("3", None, 28571), (None, "4", 28571)}


def test_schemas_and_tables(spark):
    left = spark.createDataFrame([], "id int, name string, gone date")
    right = spark.createDataFrame([], "id bigint, name string, extra double")
    assert {r["column_name"]: r["status"] for r in compare_schemas(left, right).collect()} == {
        "id": "retyped", "name": "same", "gone": "removed", "extra": "added"}
    one, two = Dataset(spark, {"a": left, "b": spark.range(3)}), Dataset(spark, {"b": spark.range(4), "c": right})
    assert {r["table_name"]: (r["presence"], r["left_rows"], r["right_rows"])
            for r in compare_tables(one, two).collect()} == {
        "a": ("only_left", 0, None), "b": ("both", 3, 4), "c": ("only_right", None, 0)}


def test_history(spark):
    rows = [(1, "2020-01-01", "a"), (1, "2020-01-02", "a"), (1, "2020-01-03", "b"), (1, "2020-01-05", None),
            (2, "2020-01-02", "z"), (3, "2020-01-01", "p"), (3, "2020-01-01", "q"), (3, "2020-01-02", "q"),
            (3, "2020-01-02", "p"), (None, "2020-01-01", "n"), (None, "2020-01-02", "m")]
    df = spark.createDataFrame(rows, "k int, d string, v string").selectExpr(
        "k", "CAST(d AS DATE) AS snapshot_date", "v")
    found = {r["k"]: (str(r["first_seen"]), str(r["last_seen"]), r["n_snapshots"], r["n_changes"])
             for r in record_history(df, ["k"]).collect()}
    assert found == {1: ("2020-01-01", "2020-01-05", 4, 2), 2: ("2020-01-02", "2020-01-02", 1, 0),
                     3: ("2020-01-01", "2020-01-02", 2, 0), None: ("2020-01-01", "2020-01-02", 2, 1)}


def test_numbers_are_compared_exactly_across_types(spark):
    big = 2 ** 53
    left = spark.createDataFrame([(1, big), (2, big + 1), (3, 0), (4, None), (5, 7), (6, 9223372036854775807)], "id int, n bigint")
    right = spark.createDataFrame([(1, float(big)), (2, float(big)), (3, -0.0), (4, None), (5, 7.5), (6, 9.223372036854775807e18)],
                                  "id int, n double")
    status = {r["id"]: r["status"] for r in compare_rows(left, right, ["id"]).collect()}
    assert status == {1: "same", 2: "changed", 3: "same", 4: "same", 5: "changed", 6: "changed"}
    cells = {(r["id"], r["old_value"], r["new_value"]) for r in compare_cells(left, right, ["id"]).where("id < 6").collect()}
    assert cells == {(2, "9007199254740993", "9007199254740992"), (5, "7", "7.5")}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,)], "x double")
    assert compare_multiset(odd, spark.createDataFrame([(1,)], "x bigint")).count() == 4
    assert compare_multiset(spark.createDataFrame([(5.0,)], "x double"), spark.createDataFrame([(5,)], "x bigint")).count() == 0
    # As a union, both are read as the same text.
    both = union_snapshots({"2020-01-01": left.limit(2), "2020-01-02": right.limit(2)})
    assert {r["n"] for r in both.collect()} == {"9007199254740992", "9007199254740993"}


def test_dotted_names(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` int, `c.d` string")
    right = spark.createDataFrame([(1, "x"), (2, "z")], "`a.b` int, `c.d` string")
    assert {tuple(r)[:2] for r in compare_rows(left, right, ["a.b"]).collect()} == {(1, "same"), (2, "changed")}
    assert [tuple(r) for r in compare_cells(left, right, ["a.b"]).collect()] == [(2, "c.d", "y", "z", 1)]
    assert compare_multiset(left, right).count() == 2
    assert filter_rows(left, {"column": "c.d", "op": "=", "value": "y"}).count() == 1
    nested = spark.createDataFrame([((1,),)], "s struct<f:int>")
    assert filter_rows(nested, {"column": "s.f", "op": "=", "value": 1}).count() == 1
