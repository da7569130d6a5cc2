"""Drift between a reference and a current dataset, or against stored histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import as_double, col, normalize_missing, numeric_columns
from tablewarden.functions.runtime import together
from tablewarden.functions.stats import clamp, ratio
from tablewarden.operators.eda import bin_index, binned_counts, equal_width_edges, ranges_of
from tablewarden.operators.ordered import melt_with_range, range_edges, running_sums
from tablewarden.operators.quantiles import exact_quantiles
from tablewarden.operators.values import missing_counts

SHARE_FLOOR = 1e-4
DENSITY_FLOOR = 1e-10
SERIES_TERMS = 100
# Largest sample for which the KS p-value is counted exactly; beyond it the series is used.
EXACT_KS = 10_000
DRIFT_SCHEMA = (
    "column string, psi double, kl_divergence double, wasserstein double, ks_statistic double,"
    " ks_pvalue double, drift_detected boolean, severity string"
)


def _psi_term(train: Column, test: Column) -> Column:
    return (test - train) * F.ln(test / train)


def _usable_histograms(df: DataFrame, histograms: DataFrame) -> dict[str, tuple[list, list]]:
    """Edges and counts of the numeric columns of ``df``; one row per column of the training table."""
    numeric = set(numeric_columns(df))
    return {
        r["column"]: (list(r["bin_edges"]), list(r["counts"]))
        for r in histograms.collect()
        if r["column"] in numeric and r["bin_edges"] and sum(r["counts"] or []) > 0
    }


def psi_against_histograms(
    df: DataFrame, histograms: DataFrame, report_above: float = 0.1, high_above: float = 0.2
) -> DataFrame:
    """PSI of each numeric column against its stored histogram ``column, bin_edges, counts``.

    Current values outside the stored edges are left out, also from the total. Columns
    above the report mark come back as ``column, psi, severity``.
    """
    df = normalize_missing(df)
    stored = _usable_histograms(df, histograms)
    schema = "column string, psi double, severity string"
    if not stored:
        return df.sparkSession.createDataFrame([], schema)
    counted = binned_counts(df, {c: edges for c, (edges, _) in stored.items()})
    slots = [(c, b, int(n), int(sum(ns))) for c, (_, ns) in stored.items() for b, n in enumerate(ns)]
    frame = df.sparkSession.createDataFrame(slots, "column string, bin int, train bigint, train_total bigint")
    totals = counted.groupBy("column").agg(F.sum("n").alias("test_total"))
    return _verdict_on_shares(frame, counted, totals, report_above, high_above)


def _verdict_on_shares(
    frame: DataFrame, counted: DataFrame, totals: DataFrame, report_above: float, high_above: float,
    keys: tuple[str, ...] = ("column",),
) -> DataFrame:
    def share(n: Column, total: Column) -> Column:
        return F.when(n == 0, F.lit(SHARE_FLOOR)).otherwise(ratio(n, total))

    train = share(F.col("train"), F.col("train_total"))
    test = share(F.coalesce("n", F.lit(0)), F.col("test_total"))
    psi = (
        frame.join(totals, "column")
        .join(counted, [*keys, "bin"], "left")
        .groupBy(*keys)
        .agg(F.sum(_psi_term(train, test)).alias("psi"))
    )
    return (
        psi.where(F.col("psi") > report_above)
        .select(*keys, "psi", F.when(F.col("psi") > high_above, "HIGH").otherwise("MEDIUM").alias("severity"))
        .orderBy(F.desc("psi"), *keys)
    )


def psi_per_window(
    df: DataFrame,
    histograms: DataFrame,
    time: str,
    width: str,
    late: str | None = None,
    report_above: float = 0.1,
    high_above: float = 0.2,
) -> DataFrame:
    """``window_start, window_end, column, psi, severity`` of each event-time window that drifted.

    Works on a table and on a stream; on a stream ``late`` is how long rows may lag behind the
    newest one before their window closes. Rows without a time belong to no window. Values
    outside the stored edges are left out, and windows without a value inside them as well.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    stored = _usable_histograms(df, histograms)
    if late is not None:
        df = df.withWatermark(time, late)
    cells = [
        F.struct(F.lit(c).alias("column"), bin_index(as_double(c), edges).alias("bin"))
        for c, (edges, _) in stored.items()
    ] or [F.struct(F.lit("").alias("column"), F.lit(None).cast("int").alias("bin"))]
    bins = max((len(counts) for _, counts in stored.values()), default=1)
    counted = (
        df.select(F.window(col(time), width).alias("window"), F.explode(F.array(*cells)).alias("cell"))
        .where("cell.bin is not null")
        .groupBy("window", F.col("cell.column").alias("column"))
        .agg(*[F.count_if(F.col("cell.bin") == b).alias(f"n{b}") for b in range(bins)])
        .select("window", "column", F.array(*[f"n{b}" for b in range(bins)]).alias("counts"))
    )
    shares = [(c, [n / sum(ns) if n else SHARE_FLOOR for n in ns]) for c, (_, ns) in stored.items()]
    train = spark.createDataFrame(shares, "column string, train array<double>")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    test = F.transform(
        F.slice("counts", 1, F.size("train")),
        lambda n: F.when(n == 0, F.lit(SHARE_FLOOR)).otherwise(n / F.col("total")),
    )
    psi = F.aggregate(F.zip_with("train", test, _psi_term), F.lit(0.0), lambda s, term: s + term)
    return (
        counted.join(F.broadcast(train), "column")  # one row per column
        .withColumn("total", total)
        .withColumn("psi", psi)
        .where(F.col("psi") > report_above)
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "column",
            "psi",
            F.when(F.col("psi") > high_above, "HIGH").otherwise("MEDIUM").alias("severity"),
        )
    )


def common_numeric_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Numeric columns of both tables with values on both sides, in reference order."""
    shared = [c for c in numeric_columns(reference) if c in set(numeric_columns(current))]
    if not shared:
        return []
    present = []
    counted = together(
        lambda: missing_counts(normalize_missing(reference), shared),
        lambda: missing_counts(normalize_missing(current), shared),
    )
    for rows, missing in counted:
        present.append({c for c in shared if missing[c] < rows})
    return [c for c in shared if c in present[0] and c in present[1]]


def both_sides(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """One frame of the shared columns as doubles with ``side`` 0 (reference) or 1 (current)."""
    wide = [as_double(c).alias(c) for c in columns]
    return reference.select(F.lit(0).alias("side"), *wide).unionByName(
        current.select(F.lit(1).alias("side"), *wide)
    )


def _side_counts(binned: DataFrame) -> DataFrame:
    return binned.groupBy("column", "bin").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("ref"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("n"))), F.lit(0)).alias("cur"),
    )


def psi_quantile_bins(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 10
) -> DataFrame:
    """``column, psi`` on the unique deciles of the reference. Shares are of all values of a
    side and floored at 0.0001; columns with fewer than two unique edges get 0."""
    names = common_numeric_columns(reference, current) if columns is None else columns
    spark = reference.sparkSession
    deciles = exact_quantiles(reference, names, [i / bins for i in range(bins + 1)])
    edges = {c: sorted(set(deciles[c])) for c in names}
    usable = {c: e for c, e in edges.items() if len(e) > 1}
    listed = spark.createDataFrame([(c,) for c in names], "column string")
    if not usable:
        return listed.select("column", F.lit(0.0).alias("psi"))
    slots = [(c, b) for c, e in usable.items() for b in range(len(e) - 1)]
    counted = _side_counts(binned_counts(both_sides(reference, current, names), usable, ("side",), outside=True))
    totals = counted.groupBy("column").agg(F.sum("ref").alias("ref_total"), F.sum("cur").alias("cur_total"))
    frame = spark.createDataFrame(slots, "column string, bin int").join(totals, "column")

    def share(n: str, total: str) -> Column:
        return F.greatest(ratio(F.coalesce(n, F.lit(0)), F.col(total)), F.lit(SHARE_FLOOR))

    psi = (
        frame.join(counted, ["column", "bin"], "left")
        .groupBy("column")
        .agg(F.sum(_psi_term(share("ref", "ref_total"), share("cur", "cur_total"))).alias("psi"))
    )
    return listed.join(psi, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def kl_divergence(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 20
) -> DataFrame:
    """``column, kl_divergence`` in nats over equal-width bins of both sides together.

    The small constant is added to densities, which are then rescaled to sum to 1.
    """
    names = common_numeric_columns(reference, current) if columns is None else columns
    both = both_sides(reference, current, names)
    edges = {
        c: equal_width_edges(*((lo, hi) if hi > lo else (lo - 0.5, lo + 0.5)), bins)
        for c, (lo, hi) in ranges_of(both, names).items()
    }
    spark = reference.sparkSession
    slots = [(c, b, e[b + 1] - e[b]) for c, e in edges.items() for b in range(bins)]
    frame = spark.createDataFrame(slots, "column string, bin int, width double")
    counted = _side_counts(binned_counts(both, edges, ("side",), even=True))
    totals = counted.groupBy("column").agg(F.sum("ref").alias("ref_total"), F.sum("cur").alias("cur_total"))

    def density(n: str, total: str) -> Column:
        return ratio(F.coalesce(n, F.lit(0)), F.col(total)) / F.col("width") + DENSITY_FLOOR

    p, q = F.col("p"), F.col("q")
    # With P and Q the sums: sum(p/P ln((p/P)/(q/Q))) = sum(p ln(p/q))/P + ln(Q/P).
    return (
        frame.join(totals, "column")
        .join(counted, ["column", "bin"], "left")
        .select("column", density("ref", "ref_total").alias("p"), density("cur", "cur_total").alias("q"))
        .groupBy("column")
        .agg(F.sum(p).alias("p_sum"), F.sum(q).alias("q_sum"), F.sum(p * F.ln(p / q)).alias("cross"))
        .select(
            "column",
            (F.col("cross") / F.col("p_sum") + F.ln(F.col("q_sum") / F.col("p_sum"))).alias("kl_divergence"),
        )
    )


def distribution_distances(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """``column, wasserstein, ks_statistic, ref_count, cur_count`` from the two empirical
    distribution functions over the merged distinct values.

    Values are combined before the exchange and ordered within value ranges, so neither a
    hot value nor a large column ends in one task.
    """
    names = common_numeric_columns(reference, current) if columns is None else columns
    both = both_sides(reference, current, names)
    edges = range_edges(both, names)
    points = (
        melt_with_range(both, names, edges, keep=["side"])
        .groupBy("column", "bucket", "value")
        .agg(
            F.count_if(F.col("side") == 0).alias("ref"),
            F.count_if(F.col("side") == 1).alias("cur"),
        )
    )
    curve = running_sums(points, ["ref", "cur"])
    totals = points.groupBy("column").agg(F.sum("ref").alias("ref_count"), F.sum("cur").alias("cur_count"))
    gap = F.abs(ratio(F.col("ref_to"), F.col("ref_count")) - ratio(F.col("cur_to"), F.col("cur_count")))
    return (
        curve.join(F.broadcast(totals), "column")  # one row per column
        .groupBy("column")
        .agg(
            F.coalesce(F.sum((F.col("next_value") - F.col("value")) * gap), F.lit(0.0)).alias("wasserstein"),
            F.max(gap).alias("ks_statistic"),
            F.first("ref_count").alias("ref_count"),
            F.first("cur_count").alias("cur_count"),
        )
    )


def stray_probability(n: int, m: int, gap: int) -> float:
    """Chance that a random order of ``n`` and ``m`` values ever has ``|i m - j n| >= gap`` after
    ``i`` of the one and ``j`` of the other.

    Orders are drawn value by value: the mass of each ``i`` moves on by the shares of values
    left, and what crosses the limit is added up and taken out. All terms are positive, so small
    chances are exact to rounding too. Work is the sum of the live positions over all steps.
    """
    if gap <= 0:
        return 1.0
    rows = n + m
    mass, low, strayed = np.ones(1), 0, 0.0
    for t in range(rows):
        i = np.arange(low, low + len(mass))
        moved = np.zeros(len(mass) + 1)
        moved[1:] = mass * ((n - i) / (rows - t))
        moved[:-1] += mass * ((m - t + i) / (rows - t))
        here = (t + 1) * n
        first = max((here - gap) // rows + 1, 0)
        last = min((here + gap - 1) // rows, n)
        start = min(max(first - low, 0), len(moved))
        stop = min(max(last - low + 1, start), len(moved))
        strayed += moved[:start].sum() + moved[stop:].sum()
        mass, low = moved[start:stop], low + start
        if not len(mass):
            break
    return float(min(1.0, strayed))


@F.pandas_udf(T.DoubleType())
def _exact_pvalues(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    rows = zip(gap, n, m)
    return pd.Series(
        [None if pd.isna(g) else stray_probability(int(a), int(b), int(g)) for g, a, b in rows], dtype="float64"
    )


def ks_series(statistic: Column, ref_count: Column, cur_count: Column) -> Column:
    """Two-sided p-value of the KS statistic by the asymptotic Kolmogorov series."""
    n, m = ref_count.cast("double"), cur_count.cast("double")
    root = F.sqrt(F.try_divide(n * m, n + m))
    lam = (root + 0.12 + F.try_divide(F.lit(0.11), root)) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    # Below 0.2 the probability is 1 to double precision and the series has not converged.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(clamp(series, 0.0, 1.0))


def ks_pvalue(statistic: Column, ref_count: Column, cur_count: Column) -> Column:
    """Two-sided p-value of the KS statistic: exact if both samples have at most 10,000 values,
    else by the series. The exact count runs once per row, so give it a row per column."""
    n, m = ref_count.cast("double"), cur_count.cast("double")
    small = (n <= EXACT_KS) & (m <= EXACT_KS) & (n > 0) & (m > 0)
    # The statistic is a whole number of steps of 1 / (n m).
    exact = _exact_pvalues(F.when(small, F.round(statistic * n * m)), n, m)
    return F.when(small, exact).otherwise(ks_series(statistic, ref_count, cur_count))


def with_verdict(metrics: DataFrame, psi_threshold: float = 0.1, ks_alpha: float = 0.05) -> DataFrame:
    """Add ``drift_detected`` and ``severity`` to rows with ``psi`` and ``ks_pvalue``."""
    psi, p = F.col("psi"), F.col("ks_pvalue")
    detected = (psi >= psi_threshold) | (p < ks_alpha)
    return metrics.withColumn("drift_detected", detected).withColumn(
        "severity",
        F.when(~detected, "low")
        .when((psi > 0.2) | (p < 0.01), "high")
        .when((psi > 0.1) | (p < 0.05), "moderate")
        .otherwise("low"),
    )


def drift_report(
    reference: DataFrame, current: DataFrame, psi_threshold: float = 0.1, ks_alpha: float = 0.05
) -> DataFrame:
    """All four metrics and the verdict for every shared numeric column."""
    names = common_numeric_columns(reference, current)
    if not names:
        return reference.sparkSession.createDataFrame([], DRIFT_SCHEMA)
    psi, kl, distances = together(
        lambda: psi_quantile_bins(reference, current, names),
        lambda: kl_divergence(reference, current, names),
        lambda: distribution_distances(reference, current, names),
    )
    metrics = (
        psi.join(kl, "column")
        .join(distances, "column")
        .repartition(min(len(names), reference.sparkSession.sparkContext.defaultParallelism), "column")
        .withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("ref_count"), F.col("cur_count")))
    )
    return with_verdict(metrics, psi_threshold, ks_alpha).select(
        "column", "psi", "kl_divergence", "wasserstein", "ks_statistic", "ks_pvalue",
        "drift_detected", "severity",
    )


def overall_drift(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("overall_drift_detected"))
