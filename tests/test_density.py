import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import density, outliers


def brute_noise(z, eps, needed):
    near = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= needed
    return ~core & ~near[:, core].any(axis=1)


def blobs(seed, n, d):
    rng = np.random.default_rng(seed)
    z = np.vstack([rng.normal(size=(n, d)), rng.normal(size=(n // 4, d)) * 0.2 + 4, rng.uniform(-9, 9, (n // 10, d))])
    return np.round(z, 9)


@pytest.mark.parametrize("eps,needed", [(0.7, 12), (0.3, 30), (3.0, 5)])
def test_nd_matches_brute_force(spark, eps, needed, monkeypatch):
    # Deep trees, and lists that cut the rows of a cell on both sides.
    monkeypatch.setattr(density, "PAIR_WORK", 20)
    monkeypatch.setattr(density, "LIST_ROWS", 3)
    z = blobs(3, 300, 3)
    df = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b", "c"]))
    found = {tuple(r) for r in density.noise_nd(df, needed, eps).collect()}
    assert found == {tuple(r) for r in z[brute_noise(z, eps, needed)]}


def test_nd_beyond_the_cell_columns_and_with_repeated_rows(spark):
    z = blobs(4, 200, 5)
    z = np.vstack([z, np.repeat(z[:3], 9, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(z, columns=list("abcde")))
    found = {tuple(r) for r in density.noise_nd(df, 8, 1.5).collect()}
    assert found == {tuple(r) for r in z[brute_noise(z, 1.5, 8)]}


def test_compared_rows_follow_the_border(spark, monkeypatch):
    monkeypatch.setattr(density, "PAIR_WORK", 64)
    shares = []
    for n in (1_000, 4_000, 16_000):
        z = np.round(np.random.default_rng(n).normal(size=(n, 2)), 9)
        points = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b"])).withColumn("weight", F.lit(1).cast("bigint"))
        compared = []
        found = density.rows_near(points, points.drop("weight"), 0.5, n // 100, compared).count()
        near = np.array([((z - q) ** 2).sum(axis=1) <= 0.25 for q in z]).sum(axis=1) >= n // 100
        assert found == near.sum()
        shares.append(compared[0] / n**2)
    assert max(shares) < 0.01


def test_pairs_of_boxes_stay_few_when_cells_are_full(spark, monkeypatch):
    # Cells of up to thousands of rows are compared in their small boxes, by many groups, and not cut into cells of a row each.
    monkeypatch.setattr(density, "GROUP_ROWS", (16, 64))
    seen = []
    real = density.materialize
    monkeypatch.setattr(density, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    z = blobs(6, 2_000, 3)
    df = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b", "c"]))
    found = {tuple(r) for r in density.noise_nd(df, 40, 0.4).collect()}
    assert found == {tuple(r) for r in z[brute_noise(z, 0.4, 40)]}
    assert max(s.count() for s in seen if "within" in s.columns) < len(z)


def test_few_rows_are_held_against_rows(spark, monkeypatch):
    # Small boxes settle most rows, and boxes of half their side most others.
    seen = []
    monkeypatch.setattr(density, "MANY_ROWS", 0)
    real = density._narrowed
    monkeypatch.setattr(density, "_narrowed", lambda rows, *args: seen.append(rows.count()) or real(rows, *args))
    z = np.round(np.random.default_rng(7).normal(size=(20_000, 3)), 9)
    points = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b", "c"])).withColumn("weight", F.lit(1).cast("bigint"))
    found = {tuple(r) for r in density.rows_near(points, points.drop("weight"), 0.5, 200).collect()}
    near = np.array([((z - q) ** 2).sum(axis=1) <= 0.25 for q in z]).sum(axis=1) >= 200
    assert found == {tuple(r) for r in z[near]}
    assert len(seen) == 2 and seen[1] < 0.7 * seen[0] < 0.5 * len(z)


def test_lists_chunks_and_blocks_of_few_rows(spark, monkeypatch):
    for name, value in {"FEW_ROWS": 0, "MANY_ROWS": 0, "BOX_ROWS": 4, "LIST_ROWS": 5, "GROUP_ROWS": (16, 64), "CHUNK_ROWS": 64, "LIST_BLOCK": 4, "BLOCK": 64}.items():
        monkeypatch.setattr(density, name, value)
    z = blobs(8, 500, 3)
    z = np.vstack([z, np.repeat(z[:40], 4, axis=0), [[2e3, 0.0, 0.0]]])
    df = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b", "c"]))
    found = {tuple(r) for r in density.noise_nd(df, 15, 0.6).collect()}
    assert found == {tuple(r) for r in z[brute_noise(z, 0.6, 15)]}


def test_nd_of_no_rows_and_of_one_value(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert density.noise_nd(none, 5, 1.0).count() == 0
    same = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert density.noise_nd(same, 5, 1.0).count() == 1 and density.noise_nd(same, 4, 1.0).count() == 0


@pytest.mark.parametrize("eps,needed", [(0.05, 5), (0.5, 20), (3.0, 8)])
def test_1d_matches_brute_force(spark, eps, needed):
    z = blobs(5, 300, 1)
    z = np.vstack([z, np.full((60, 1), 12.5)])
    df = spark.createDataFrame(pd.DataFrame({"x": z[:, 0]}))
    counts = df.groupBy("x").count().selectExpr("'x' as column", "x as value", "count as n")
    limits = spark.createDataFrame([("x", needed)], "column string, min_samples bigint")
    found = {r["value"] for r in density.noise_1d(counts, limits, eps).collect()}
    assert found == set(z[brute_noise(z, eps, needed), 0])


def test_planted_outliers_are_flagged(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(1003), "a": rng.normal(size=1003), "b": rng.normal(size=1003)})
    pdf.loc[1000, ["a", "b"]] = [40.0, 0.0]
    pdf.loc[1001, ["a", "b"]] = [0.0, -40.0]
    pdf.loc[1002, "a"] = np.nan
    flagged = outliers.flag_outliers(spark.createDataFrame(pdf), columns=["a", "b"], row_key="id")
    rows = {r["id"]: r for r in flagged.where("id >= 1000").collect()}
    assert rows[1000]["is_outlier"] and rows[1000]["primary_anomaly_column"] == "a"
    assert rows[1000]["anomaly_reason"] == "a contains an unusually high value compared to the dataset distribution."
    assert rows[1001]["primary_anomaly_column"] == "b" and "low value" in rows[1001]["anomaly_reason"]
    assert rows[1000]["detectors_triggered"] == "Z-SCORE, MAD, ISOLATION FOREST, DBSCAN"
    assert rows[1002]["isolation_forest"] == 0.0 and rows[1002]["dbscan"] == 0
    assert flagged.count() == 1003
    scores = flagged.agg({"isolation_forest": "max"}).first()[0]
    assert 0.5 < scores < 1.0


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert outliers.outlier_summary(outliers.flag_outliers(df)).first()["percentage_flagged"] == 0.0


def test_univariate_matches_single_column(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": np.append(rng.normal(size=500), [50, 60]), "b": np.append(rng.normal(size=500), [0, 0])})
    df = spark.createDataFrame(pdf)
    found = {r[0]: r[1] for r in outliers.univariate_outliers(df, use_forest=False).collect()}
    one = outliers.flag_outliers(df, columns=["a"], use_forest=False)
    assert found["a"] == round(outliers.outlier_summary(one).first()["percentage_flagged"], 2) > 0
