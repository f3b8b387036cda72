"""A key with a third of the rows is split over tasks by adaptive execution, and nothing is lost."""

import pytest
from pyspark.sql import functions as F

from snapledger.operators.compare import compare_cells
from snapledger.operators.rules import ForeignKey, cascade_delete, orphan_keys, orphan_rows

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture
def like_large_data(spark):
    """Sizes at which Spark shuffles and splits, brought down to what the test data has."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_rows(spark):
    """A third of the rows have parent 7, the others 30,000 parents."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 30_000)
    return spark.range(ROWS, numPartitions=8).select("id", key.alias("parent_id"), F.sha2(
        F.col("id").cast("string"), 256).alias("v"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphan_rows(spark, like_large_data):
    child = hot_rows(spark)
    parent = spark.range(30_000).where("id <> 7 AND id < 20000")
    rows = orphan_rows(child, "parent_id", parent, "id")
    assert "SortMergeJoin(skew=true)" in final_plan(rows)
    expected = child.where("parent_id = 7 OR parent_id >= 20000").count()
    assert rows.count() == expected and rows.select("id").distinct().count() == expected
    assert orphan_keys(child, "parent_id", parent, "id").agg(F.sum("n_rows")).first()[0] == expected


def test_cascade(spark, like_large_data):
    tables = {"child": hot_rows(spark), "parent": spark.range(30_000)}
    marked = cascade_delete(tables, [ForeignKey("child", "parent_id", "parent", "id", "CASCADE")],
                            {"parent": "id < 100"})
    assert "SortMergeJoin(skew=true)" in final_plan(marked["child"])
    assert marked["child"].count() == ROWS
    assert marked["child"].where("deleted").count() == tables["child"].where("parent_id < 100").count()


def test_changed_cells(spark, like_large_data):
    left = hot_rows(spark)
    right = left.withColumn("v", F.when(F.col("id").isin(3, 5), "changed").otherwise(F.col("v")))
    cells = compare_cells(left.drop("id"), right.drop("id"), ["parent_id"])
    assert "SortMergeJoin(skew=true)" in final_plan(cells)
    found = {(r["parent_id"], r["new_value"]) for r in cells.collect() if r["new_value"]}
    assert found == {(7, "changed"), (5, "changed")} and cells.count() == 4
