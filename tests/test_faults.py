"""Cases that once gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import checks, cleaning, forest, identifiers, leakage, models


def test_sequential_ids_beyond_double_precision(spark):
    df = spark.range(5000).selectExpr("id + 1152921504606846976 as big", "id * 2 as two", "id * id as square")
    assert identifiers.sequential_columns(df) == ["big", "two"]


def test_rule_in_with_null_and_other_kinds(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (None, "1", 2.0, None), (3, None, None, False)], "n int, t string, x double, b boolean")

    def broken(column, value):
        rows = checks.rule_violations(df, [{"column": column, "type": "in", "value": value}]).collect()
        return rows[0]["count"] if rows else 0

    assert broken("n", [1, None, 3]) == 0
    assert broken("n", [1, 3]) == 1
    assert broken("n", [1.0, "3"]) == 2
    assert broken("n", []) == 3
    assert broken("t", ["a", 1]) == 2
    assert broken("t", ["a", "1", None]) == 0
    assert broken("x", [2, 1.5]) == 1
    assert broken("b", [1, None]) == 1


def test_baseline_of_few_kinds_of_rows(spark):
    df = spark.range(1200).selectExpr("id % 2 as x", "if(id % 2 = 0, 'no', 'yes') as y")
    row = models.baseline_metrics(df, "y").first()
    assert row["error"] is None and row["accuracy"] > 0.9


def test_sparse_column_gets_its_forest(spark):
    df = spark.range(60_000).selectExpr("cast(id as double) as full", "if(id % 1500 = 0, cast(id as double), null) as sparse")
    found = forest.fit_forest(df, ["full", "sparse"], per_column=True)
    assert set(found.forests) == {"full", "sparse"}


def test_one_minority_row_is_copied_over_many_tasks(spark):
    df = spark.range(30_001).selectExpr("id", "if(id = 30000, 'rare', if(id < 100, null, 'many')) as k")
    got = cleaning.fix_imbalance(df, "k").cache()
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"rare": 29_900, "many": 29_900, None: 100}
    rows = got.where("k = 'rare'").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 15_000


def test_oversampling_remainder_is_drawn_from_all_rows(spark):
    df = spark.range(3000).selectExpr("id", "if(id < 1000, 'b', 'a') as k").coalesce(1)
    twice = cleaning.fix_imbalance(df.where("id < 2500"), "k").where("k = 'b'").groupBy("id").count().where("count = 2")
    assert twice.count() == 500 and twice.where("id < 500").count() < 350


@pytest.mark.parametrize("levels", [95, 120, 400])
def test_an_exact_leak_is_seen_whatever_its_levels(spark, levels):
    rows = spark.range(40 * levels).select((F.col("id") % levels).alias("x"), (F.col("id") % levels * 7919 % levels).cast("double").alias("y"), F.rand(3).alias("noise"))
    rows = rows.withColumn("held", F.rand(5) < 0.3)
    found = {r[0]: r[1] for r in leakage.numeric_power(rows, "y", F.col("held")).collect()}
    assert found["x"] > 0.999 and found["noise"] < 0.1
    by_class = rows.withColumn("y", F.concat(F.lit("c"), F.col("y").cast("int")))
    found = {r[0]: r[1] for r in leakage.class_power(by_class, "y", F.col("held")).collect()}
    assert found["x"] == 1.0 and found["noise"] < 0.5
