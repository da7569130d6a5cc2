import numpy as np
import pandas as pd
import pytest

from tablewarden.operators import quantiles
from tablewarden.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(5)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_matches_numpy(spark, limit):
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(size=5001),
        "hot": np.where(rng.random(5001) < 0.4, 7.0, rng.exponential(size=5001) * 10),
        "few": rng.integers(0, 3, 5001).astype(float),
        "constant": np.full(5001, 2.5),
    }
    # A coarse sketch and a small limit force the narrowing rounds.
    found = exact_quantiles(frame(spark, **data), list(data), PROBS, accuracy=50, gather_limit=limit)
    for name, values in data.items():
        assert np.allclose(found[name], np.quantile(values, PROBS), atol=1e-12), name


def test_missing_and_tiny(spark):
    df = spark.createDataFrame(
        [(1.0, None, 1), (float("nan"), None, 2), (3.0, None, None)], "a double, b double, c int"
    )
    found = exact_quantiles(df, ["a", "b", "c"], [0.5])
    assert found == {"a": [2.0], "b": [None], "c": [1.5]}
    assert quantiles.iqr_fences(df, ["b"]) == {}
