import numpy as np
import pandas as pd

from tablewarden.operators import eda, gram


def wide(n, columns, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, columns)) @ rng.normal(size=(columns, columns)) * rng.uniform(0.1, 1e3, columns) + rng.uniform(-1e4, 1e4, columns)
    z[rng.random(z.shape) < 0.1] = np.nan
    z[:, 3] = 7.0
    z[:, 4] = np.nan
    return pd.DataFrame(z, columns=[f"c{i}" for i in range(columns)])


def test_many_columns_equal_pairwise_correlation(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK_ROWS", 64)
    pdf = wide(700, 30)
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.corr(min_periods=2)
    found = {(r["left"], r["right"]): r["corr"] for r in eda.correlation_pairs(df).collect()}
    names = [c for c in pdf.columns if pdf[c].notna().any()]
    assert len(found) == len(pdf.columns) * (len(pdf.columns) - 1) // 2
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if "c3" in (a, b):
                assert found[a, b] is None
            else:
                assert abs(found[a, b] - want.loc[a, b]) < 1e-9
    assert all(v is None for (a, b), v in found.items() if "c4" in (a, b))


def test_matrix_path_equals_spelled_out_path(spark, monkeypatch):
    df = spark.createDataFrame(wide(300, 8, 2))
    plain = {(r["i"], r["j"]): r["corr"] for r in eda.correlation_pairs(df).collect()}
    monkeypatch.setattr(eda, "PAIRS_PER_PASS", 1)
    for key, value in {(r["i"], r["j"]): r["corr"] for r in eda.correlation_pairs(df).collect()}.items():
        assert (value is None) == (plain[key] is None) and (value is None or abs(value - plain[key]) < 1e-9)


def test_three_hundred_columns_are_read_twice(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 300)), columns=[f"c{i}" for i in range(300)])
    out = eda.correlation_pairs(spark.createDataFrame(pdf))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {(r["i"], r["j"]): r["corr"] for r in out.collect()}
    want = np.corrcoef(pdf.to_numpy().T)
    assert len(rows) == 300 * 299 // 2 and all(abs(v - want[k]) < 1e-9 for k, v in rows.items())
