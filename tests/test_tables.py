"""Sources, sinks, checks, cleaning and the steps on small frames."""

import pytest
from pyspark.sql import functions as F

from tablewarden.functions.columns import normalize_missing
from tablewarden.operators import checks, cleaning, identifiers, profile, targets
from tablewarden.plans.steps import run_steps
from tablewarden.sources.reader import format_of, load_dataset
from tablewarden.sources.writer import read_results, write_cleaned, write_results


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i int, s string, d double")
    write_cleaned(df, str(tmp_path / "x.csv"))
    write_cleaned(df, str(tmp_path / "x.parquet"), format="parquet")
    df.coalesce(1).write.json(str(tmp_path / "x.json"))
    for name, kind in (("x.csv", None), ("x.PARQUET".lower(), None), ("x.json", "jsonl")):
        got = load_dataset(spark, str(tmp_path / name), kind).select("i", "s", "d").orderBy("i").collect()
        assert [tuple(r) for r in got] == [(1, "a", 1.5), (2, None, None)], name
    (tmp_path / "doc.json").write_text('[{"i": 1},\n {"i": 2}]')
    assert load_dataset(spark, str(tmp_path / "doc.json")).count() == 2
    assert format_of("A/B.CSV") == "csv"
    with pytest.raises(ValueError, match="Unsupported"):
        load_dataset(spark, "x.xlsx")


def test_results_by_run(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for run, value in (("r1", 1), ("r2", 2), ("r1", 3)):
        write_results({"t": df.select(F.lit(value).alias("a"))}, str(tmp_path), run)
    assert [r["a"] for r in read_results(spark, str(tmp_path), "t", "r1").collect()] == [3]
    assert read_results(spark, str(tmp_path), "t").count() == 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, 3)], "a double, b int")
    assert profile.missing_values(df).collect() == [("a", 2, pytest.approx(200 / 3))]
    assert normalize_missing(df).where("a is null").count() == 2
    assert profile.duplicate_ratio(df.select("a")).first()[0] == pytest.approx(1 / 3)


def test_dictionary_flags(spark):
    df = spark.createDataFrame(
        [(f"u{i}@example.com", "x" if i else "y", str(i) if i else "n/a", None) for i in range(50)],
        "mail string, one_sided string, digits string, empty double",
    )
    rows = {r["column"]: r for r in profile.data_dictionary(df).collect()}
    assert rows["mail"]["pii_warning"] and not rows["one_sided"]["pii_warning"]
    assert rows["one_sided"]["imbalance_warning"] and not rows["mail"]["imbalance_warning"]
    assert rows["digits"]["format_warning"] and not rows["mail"]["format_warning"]
    assert rows["empty"]["unique_count"] == 0 and rows["empty"]["missing_percentage"] == 100.0
    assert rows["mail"]["sample_values"] == ["u0@example.com", "u10@example.com", "u11@example.com"]


def test_sequential(spark):
    df = spark.range(500).selectExpr("id * 3 as seq", "id * id as squares", "500 - id as down", "id % 7 as few")
    assert identifiers.sequential_columns(df.repartition(4)) == ["seq", "down"]
    mixed = df.selectExpr("seq", "case when seq = 30 then 900000 else seq end as jump", "down")
    assert identifiers.sequential_columns(mixed, row_key="seq") == ["seq", "down"]
    assert identifiers.is_monotone(mixed, "down", "seq") and not identifiers.is_monotone(mixed, "jump", "seq")


def test_text_rules(spark):
    df = spark.createDataFrame([("5",), (" 12 ",), ("5d",), ("x",), (None,), ("-3",)], "v string")
    rules = [{"column": "v", "type": "min", "value": 0}, {"column": "v", "type": "max", "value": 10}]
    got = {r["rule_type"]: r["count"] for r in checks.rule_violations(df, rules).collect()}
    assert got == {"min": 1, "max": 1}


def test_issue_rows_do_not_repeat(spark):
    df = spark.range(100).selectExpr("id % 2 as y", "case when id > 10 then id end as a")
    rule = {"column": "a", "type": "not_null", "value": None}
    found = checks.detect_issues(df, "y", [rule, rule]).collect()
    assert sorted(r["type"] for r in found) == ["custom_rule_violation", "missing_values"]


def test_label_table_matches_expression(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    small = cleaning.label_encode(df)
    joined = cleaning.label_encode(df, limit=1)
    assert sorted(r[0] for r in small.collect()) == sorted(r[0] for r in joined.collect()) == [-1, 0, 0, 1, 2]
    with pytest.raises(ValueError, match="more than 2 levels"):
        cleaning.one_hot(df, limit=2)


def test_oversampling_is_exact(spark):
    df = spark.range(1000).selectExpr("id", "case when id < 700 then 'a' when id < 930 then 'b' when id < 1000 then 'c' end as k")
    got = cleaning.fix_imbalance(df.repartition(6), "k")
    assert {r["k"]: r["n"] for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 700, "b": 700, "c": 700}
    assert got.select("id").distinct().count() == 1000


def test_steps(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, s string")
    result, log = run_steps(
        df,
        [{"step": "impute_missing", "params": {"strategy": "median"}}, {"step": "scale_features", "params": {"columns": ["zz"]}},
         {"step": "twice"}],
        {"twice": lambda d: (d.unionByName(d), {"step_name": "Twice", "transformation_applied": "x2", "rows_affected": 3})},
    )
    assert sorted(r["x"] for r in result.collect()) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    rows = log.orderBy("position").collect()
    assert rows[0]["rows_affected"] == 2 and rows[1]["transformation_applied"].startswith("FAILED: ")
    with pytest.raises(ValueError, match="Unknown"):
        run_steps(df, [{"step": "nope"}])


def test_clean_skips_booleans(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 2.0), (True, 900.0), (True, 900.0)], "b boolean, x double")
    rows = cleaning.clean(df).collect()
    assert len(rows) == 3 and all(r["b"] is True for r in rows)


def test_candidate_proxies(spark):
    df = spark.range(60).selectExpr("id % 2 as label", "id % 2 as label_copy", "cast(id as double) as v")
    row = targets.target_candidates(df, with_proxies=True).where("column = 'label'").first()
    assert row["score"] == 0.99 and [p["column"] for p in row["proxies"]] == ["label_copy"]
