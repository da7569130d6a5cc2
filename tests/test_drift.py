from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import drift, eda


def np_psi(a, b):
    edges = np.unique(np.percentile(a, np.arange(11) * 10))
    p = np.clip(np.histogram(a, edges)[0] / len(a), 1e-4, None)
    q = np.clip(np.histogram(b, edges)[0] / len(b), 1e-4, None)
    return ((q - p) * np.log(q / p)).sum()


def np_kl(a, b):
    edges = np.histogram_bin_edges(np.concatenate([a, b]), 20)
    p, q = (np.histogram(v, edges, density=True)[0] + 1e-10 for v in (a, b))
    p, q = p / p.sum(), q / q.sum()
    return (p * np.log(p / q)).sum()


def np_distances(a, b):
    v = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), v, "right") / len(a)
    g = np.searchsorted(np.sort(b), v, "right") / len(b)
    return (np.diff(v) * np.abs(f - g)[:-1]).sum(), np.abs(f - g).max()


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(7)
    a = pd.DataFrame({"x": rng.normal(size=2000), "hot": np.where(rng.random(2000) < 0.5, 1.0, rng.random(2000)), "same": np.arange(2000.0)})
    b = pd.DataFrame({"x": rng.normal(0.4, 1.3, 1500), "hot": np.where(rng.random(1500) < 0.3, 1.0, rng.random(1500)), "same": np.arange(1500.0)})
    return a, b, spark.createDataFrame(a), spark.createDataFrame(b)


def test_metrics_match_numpy(sides):
    a, b, ref, cur = sides
    rows = {r["column"]: r for r in drift.drift_report(ref, cur).collect()}
    assert set(rows) == {"x", "hot", "same"}
    for c in rows:
        far, ks = np_distances(a[c].to_numpy(), b[c].to_numpy())
        assert rows[c]["psi"] == pytest.approx(np_psi(a[c], b[c]), abs=1e-9)
        assert rows[c]["kl_divergence"] == pytest.approx(np_kl(a[c], b[c]), abs=1e-9)
        assert rows[c]["wasserstein"] == pytest.approx(far, abs=1e-9)
        assert rows[c]["ks_statistic"] == pytest.approx(ks, abs=1e-12)


def test_identical_and_moved(spark, sides):
    _, _, ref, _ = sides
    for r in drift.drift_report(ref, ref).collect():
        assert r["psi"] == pytest.approx(0) and r["wasserstein"] == pytest.approx(0)
        assert r["ks_statistic"] == 0 and r["ks_pvalue"] == 1.0 and r["severity"] == "low"
    moved = ref.select((F.col("x") + 3).alias("x"))
    row = drift.drift_report(ref, moved).first()
    assert row["wasserstein"] == pytest.approx(3, abs=1e-9) and row["severity"] == "high"


def test_pvalue_series(spark):
    row = spark.range(1).select(drift.ks_pvalue(F.lit(0.01), F.lit(40000), F.lit(300)).alias("p")).first()
    assert row["p"] == pytest.approx(1.0)
    row = spark.range(1).select(drift.ks_pvalue(F.lit(0.01), F.lit(40000), F.lit(30000)).alias("p")).first()
    root = (40000 * 30000 / 70000) ** 0.5
    lam = (root + 0.12 + 0.11 / root) * 0.01
    expected = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert row["p"] == pytest.approx(expected, abs=1e-12)


def by_enumeration(n, m):
    """Share of all orders whose largest |i m - j n| is at least each value."""
    tops = []
    for chosen in combinations(range(n + m), n):
        steps = np.full(n + m, -n)
        steps[list(chosen)] = m
        tops.append(np.abs(np.cumsum(steps)).max())
    tops = np.array(tops)
    return {int(g): (tops >= g).mean() for g in np.unique(tops)}


@pytest.mark.parametrize("n,m", [(1, 1), (1, 8), (3, 5), (4, 4), (6, 8), (8, 7), (8, 8)])
def test_exact_pvalue_equals_enumeration(spark, n, m):
    expected = by_enumeration(n, m)
    rows = [(g / (n * m), n, m, float(p)) for g, p in expected.items()]
    found = spark.createDataFrame(rows, "d double, n long, m long, p double").select(
        "p", drift.ks_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("found")
    )
    for r in found.collect():
        assert r["found"] == pytest.approx(r["p"], rel=1e-12)
    assert drift.stray_probability(n, m, n * m) == pytest.approx(2 / comb(n + m, n), rel=1e-12)


def test_exact_pvalue_far_out_and_at_the_switch(spark):
    # Two samples apart: only two of all orders are as far out. The logarithm of the count keeps the digits.
    assert np.log(drift.stray_probability(200, 300, 60_000)) == pytest.approx(np.log(2) - np.log(float(comb(500, 200))), rel=1e-10)
    at = spark.createDataFrame([(10_000, 10_000), (10_000, 10_001), (0, 5)], "n long, m long").select(
        "m", drift.ks_pvalue(F.lit(0.02), F.col("n"), F.col("m")).alias("p"),
        drift.ks_series(F.lit(0.02), F.col("n"), F.col("m")).alias("series"),
    )
    rows = {r["m"]: r for r in at.collect()}
    assert rows[10_000]["p"] != rows[10_000]["series"] and rows[10_000]["p"] == pytest.approx(rows[10_000]["series"], rel=0.02)
    assert rows[10_001]["p"] == rows[10_001]["series"]


def test_stored_histogram_ignores_values_outside(spark):
    train = spark.createDataFrame([("x", [0.0, 1.0, 2.0], [50, 50]), ("empty", [0.0, 1.0], [0])],
                                  "column string, bin_edges array<double>, counts array<bigint>")
    batch = spark.createDataFrame([(0.5,)] * 9 + [(2.0,)] + [(77.0,)] * 30, "x double")
    row = drift.psi_against_histograms(batch, train).first()
    assert row["psi"] == pytest.approx((0.9 - 0.5) * np.log(0.9 / 0.5) + (0.1 - 0.5) * np.log(0.1 / 0.5))
    assert row["severity"] == "HIGH"
    outside = spark.createDataFrame([(77.0,)], "x double")
    assert drift.psi_against_histograms(outside, train).count() == 0


def test_repartitioning_changes_nothing(sides):
    _, _, ref, cur = sides
    first = drift.distribution_distances(ref, cur).orderBy("column").collect()
    again = drift.distribution_distances(ref.repartition(7), cur.repartition(3)).orderBy("column").collect()
    for a, b in zip(first, again):
        assert a["ks_statistic"] == b["ks_statistic"] and a["wasserstein"] == pytest.approx(b["wasserstein"], abs=1e-12)


def test_histogram_matches_numpy(sides):
    a, _, ref, _ = sides
    for c in ("x", "hot"):
        rows = eda.histogram(ref, columns=[c]).orderBy("bin").collect()
        counts, edges = np.histogram(a[c], bins=10)
        assert [r["count"] for r in rows] == counts.tolist()
        assert np.allclose([r["lo"] for r in rows], edges[:-1])
    packed = eda.histogram_arrays(eda.histogram(ref)).where("column = 'x'").first()
    assert len(packed["bin_edges"]) == 11 and sum(packed["counts"]) == 2000


def test_stream_measures_each_batch(spark, sides, tmp_path):
    from tablewarden.streaming.drift_stream import watch_drift

    _, _, ref, cur = sides
    source = str(tmp_path / "in")
    cur.select((F.col("x") + 2).alias("x")).coalesce(1).write.parquet(source)
    stored = eda.histogram_arrays(eda.histogram(ref))
    stream = spark.readStream.schema("x double").parquet(source)
    run = watch_drift(stream, stored, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    run.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["batch_id"], r["column"], r["severity"]) for r in rows] == [(0, "x", "HIGH")]


def test_stream_windows_equal_the_table(spark, tmp_path):
    from tablewarden.streaming.drift_stream import watch_window_drift

    stored = spark.createDataFrame(
        [("x", [0.0, 1.0, 2.0], [50, 50]), ("y", [0.0, 1.0, 2.0, 3.0], [0, 10, 30]), ("absent", [0.0, 1.0], [5])],
        "column string, bin_edges array<double>, counts array<bigint>",
    )
    schema = "ts timestamp, x double, y int"

    def rows(text):
        return [(pd.Timestamp(f"2024-01-01 {t}").to_pydatetime(), x, y) for t, x, y in text]

    files = [
        # 10:05 stands after 10:50: late, but its window is still open.
        rows([("10:10", 0.5, 1), ("10:20", 0.5, 2), ("10:50", 1.5, None), ("10:05", 0.2, 2), ("11:01", None, 9)]),
        # 10:58 comes behind 11:01 and still counts; 77 lies outside the edges.
        rows([("10:58", 0.1, 0), ("11:30", 1.5, 1), ("11:31", 77.0, 1), ("13:00", 0.5, 2)]),
        # The watermark is 12:30 now: 10:59 is too late and dropped.
        rows([("10:59", 1.9, 2), ("12:45", 2.0, 2), ("12:50", float("nan"), 1), ("15:00", 1.0, 1)]),
        rows([("18:00", 1.0, 1)]),
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = watch_window_drift(
            stream, stored, out, str(tmp_path / "cp"), "ts", "1 hour", "30 minutes", availableNow=True
        )
        run.awaitTermination(120)
    kept = spark.createDataFrame([r for part in files for r in part if r[0].strftime("%H:%M") != "10:59"], schema)
    closed = drift.psi_per_window(kept, stored, "ts", "1 hour").where("window_end <= '2024-01-01 17:30:00'")
    order = ["window_start", "column"]
    expected = [tuple(r) for r in closed.orderBy(*order).collect()]
    found = [tuple(r) for r in spark.read.parquet(out).orderBy(*order).select(closed.columns).collect()]
    assert len(expected) >= 4 and found == expected
    with_dropped = spark.createDataFrame([r for part in files for r in part], schema)
    other = drift.psi_per_window(with_dropped, stored, "ts", "1 hour").where("window_end <= '2024-01-01 17:30:00'")
    assert [tuple(r) for r in other.orderBy(*order).collect()] != expected


def test_windows_by_hand(spark):
    stored = spark.createDataFrame([("x", [0.0, 1.0, 2.0], [50, 50])], "column string, bin_edges array<double>, counts array<bigint>")
    times = [pd.Timestamp("2024-01-01 10:00").to_pydatetime()] * 10 + [None]
    df = spark.createDataFrame([(t, v) for t, v in zip(times, [0.5] * 9 + [2.0] + [0.5])], "ts timestamp, x double")
    row = drift.psi_per_window(df, stored, "ts", "1 hour").collect()
    assert len(row) == 1 and row[0]["severity"] == "HIGH"
    assert row[0]["psi"] == pytest.approx((0.9 - 0.5) * np.log(0.9 / 0.5) + (0.1 - 0.5) * np.log(0.1 / 0.5))
    assert drift.psi_per_window(df.where("false"), stored, "ts", "1 hour").count() == 0
    assert drift.psi_per_window(df.select("ts"), stored, "ts", "1 hour").count() == 0
