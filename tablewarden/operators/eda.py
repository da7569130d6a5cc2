"""Exploratory tables: histograms, value counts, correlations, boxplots, class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    as_double,
    categorical_columns,
    chunks,
    col,
    double_of,
    normalize_missing,
    numeric_columns,
)
from tablewarden.functions.runtime import together
from tablewarden.functions.stats import correlation_from_sums, pair_sums, ratio
from tablewarden.operators.gram import SUMS, pair_sums_of_all
from tablewarden.operators.quantiles import exact_quantiles, iqr_fences
from tablewarden.operators.values import distinct_estimates, value_counts

# Pairs of columns that are spelled out as aggregates of one pass; more become a matrix.
PAIRS_PER_PASS = 300


def ranges_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each non-empty column."""
    found = {}
    for part in chunks(columns, 200):
        aggs = []
        for i, c in enumerate(part):
            v = double_of(df, c)
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            if row[f"lo{i}"] is not None:
                found[c] = (row[f"lo{i}"], row[f"hi{i}"])
    return found


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def bin_index(value: Column, edges: list[float]) -> Column:
    """Bin of a value: ``[e_i, e_i+1)``, the last bin closed, NULL outside the edges."""
    inner = sum(((value >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((value >= edges[0]) & (value <= edges[-1]), inner)


def even_bin_index(value: Column, edges: list[float]) -> Column:
    """``bin_index`` for equal widths: a division finds the bin up to rounding and the edges
    beside it settle the rest, so the expression does not grow with the number of bins."""
    bins = len(edges) - 1
    width = (edges[-1] - edges[0]) / bins
    marks = F.array(*[F.lit(e) for e in edges])
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - edges[0]) / width).cast("int")))
    above = (guess < bins - 1) & (value >= F.get(marks, guess + 1))
    settled = guess - (value < F.get(marks, guess)).cast("int") + above.cast("int")
    return F.when((value >= edges[0]) & (value <= edges[-1]), settled)


def binned_counts(
    df: DataFrame,
    edges: dict[str, list[float]],
    keep: tuple[str, ...] = (),
    even: bool = False,
    outside: bool = False,
) -> DataFrame:
    """``(*keep, column, bin, n)`` of values inside the edges; one scan, and the exchange
    carries at most columns x bins rows per task. ``outside`` counts the others as bin -1."""
    names = list(edges)
    index = even_bin_index if even else bin_index
    cells = {c: index(double_of(df, c), edges[c]) for c in names}
    if outside:
        cells = {
            c: F.when(double_of(df, c).isNotNull(), F.coalesce(b, F.lit(-1))) for c, b in cells.items()
        }
    bins = df.select(*keep, *[b.alias(c) for c, b in cells.items()])
    return (
        bins.unpivot([F.col(k) for k in keep], [col(c) for c in names], "column", "bin")
        .where("bin is not null")
        .groupBy(*keep, "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, bins: int = 10, columns: list[str] | None = None) -> DataFrame:
    """``column, bin, lo, hi, label, count`` with empty bins; constant columns have none."""
    df = normalize_missing(df)
    names = numeric_columns(df) if columns is None else columns
    edges = {
        c: equal_width_edges(lo, hi, bins) for c, (lo, hi) in ranges_of(df, names).items() if hi > lo
    }
    spark = df.sparkSession
    schema = "column string, bin int, lo double, hi double"
    slots = [(c, b, e[b], e[b + 1]) for c, e in edges.items() for b in range(bins)]
    frame = spark.createDataFrame(slots, schema)
    if not edges:
        return frame.select("*", F.lit("").alias("label"), F.lit(0).cast("bigint").alias("count"))
    counted = binned_counts(df, edges, even=True)
    return frame.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        "lo",
        "hi",
        F.concat_ws(" - ", F.round("lo", 2).cast("string"), F.round("hi", 2).cast("string")).alias("label"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def histogram_arrays(hist: DataFrame) -> DataFrame:
    """``column, bin_edges, counts``: the stored form that drift compares against."""
    bars = F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "count")))
    packed = hist.groupBy("column").agg(bars.alias("bars"))
    return packed.select(
        "column",
        F.concat(
            F.transform("bars", lambda b: b["lo"]), F.slice(F.transform("bars", lambda b: b["hi"]), -1, 1)
        ).alias("bin_edges"),
        F.transform("bars", lambda b: b["count"]).alias("counts"),
    )


def top_value_counts(df: DataFrame, k: int = 10, max_distinct: int = 50, max_share: float = 0.5) -> DataFrame:
    """The ``k`` most frequent values of each text or boolean column of low cardinality."""
    df = normalize_missing(df)
    names = categorical_columns(df)
    _, estimates = distinct_estimates(df, names)
    names = [c for c in names if 0 < estimates[c][1] <= 2 * max_distinct]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, position int, value string, count bigint"
        )
    counts = value_counts(df, names)
    size = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("valid")
    )
    fit = size.where(
        (F.col("distinct") <= max_distinct) & (ratio(F.col("distinct"), F.col("valid")) <= max_share)
    ).select("column")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.join(F.broadcast(fit), "column", "left_semi")  # one row per column
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select("column", "position", "value", F.col("n").alias("count"))
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``i, j, left, right, corr`` for i < j in schema order; NULL if a side is constant.

    One pass finds each column's mean and spread; the next adds up products of the centred
    values. A pair of complete columns costs one sum, a pair with gaps six over its common
    rows. Passes move one row per task. Many pairs are added up as blocks of a matrix instead,
    in one pass as well.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    names = numeric_columns(df) if columns is None else columns
    schema = "i int, j int, left string, right string, corr double"
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return spark.createDataFrame([], schema)
    facts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        v = double_of(df, c)
        facts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    seen = df.agg(*facts).first()
    rows = seen["rows"]
    centred = df.select(
        *[(double_of(df, c) - F.lit(seen[f"m{i}"] or 0.0)).alias(f"v{i}") for i, c in enumerate(names)]
    )
    if len(pairs) > PAIRS_PER_PASS:
        sums = pair_sums_of_all(centred)
        label = F.array(*[F.lit(c) for c in names])
        return sums.select(
            "i", "j", F.element_at(label, F.col("i") + 1).alias("left"), F.element_at(label, F.col("j") + 1).alias("right"),
            correlation_from_sums(*[F.col(c) for c in SUMS]).alias("corr"),
        )
    aggs, values = [], []
    for i, j in pairs:
        x, y = F.col(f"v{i}"), F.col(f"v{j}")
        if seen[f"n{i}"] == rows and seen[f"n{j}"] == rows:
            aggs.append(F.sum(x * y).alias(f"p{i}_{j}"))
            spread = rows * (seen[f"s{i}"] or 0.0) * (seen[f"s{j}"] or 0.0)
            values.append(F.try_divide(F.col(f"p{i}_{j}"), F.lit(float(spread))))
        else:
            values.append(correlation_from_sums(*pair_sums(x, y, f"{i}_{j}", aggs)))
    out = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("left"),
                F.lit(names[j]).alias("right"), r.alias("corr"),
            )
            for (i, j), r in zip(pairs, values)
        ]
    )
    return centred.agg(*aggs).select(F.inline(out))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Full matrix ``left, right, corr`` with 0 where undefined and 1 on the diagonal of
    columns that vary."""
    df = normalize_missing(df)
    names = numeric_columns(df)
    if len(names) < 2:
        return correlation_pairs(df, []).select("left", "right", "corr")
    pairs, varying = together(lambda: correlation_pairs(df, names), lambda: ranges_of(df, names))
    upper = pairs.select("left", "right", "corr")
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, 1.0 if c in varying and varying[c][0] < varying[c][1] else 0.0) for c in names],
        "left string, right string, corr double",
    )
    lower = upper.select(F.col("right").alias("left"), F.col("left").alias("right"), "corr")
    both = upper.unionByName(lower).select("left", "right", F.coalesce("corr", F.lit(0.0)).alias("corr"))
    return both.unionByName(diagonal)


def boxplot(df: DataFrame) -> DataFrame:
    """``column, min, q1, median, q3, max, lower_bound, upper_bound`` of numeric columns."""
    df = normalize_missing(df)
    names = numeric_columns(df)
    rows = []
    for c, (low, q1, q2, q3, high) in exact_quantiles(df, names, [0.0, 0.25, 0.5, 0.75, 1.0]).items():
        if low is not None:
            spread = 1.5 * (q3 - q1)
            rows.append((c, low, q1, q2, q3, high, q1 - spread, q3 + spread))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, min double, q1 double, median double, q3 double, max double,"
        " lower_bound double, upper_bound double",
    )


def boxplot_outliers(df: DataFrame, k: int | None = None) -> DataFrame:
    """Values outside the fences: all of them without an order (``position`` is null), or per column the ``k`` furthest
    from the median.

    The rank filter runs per task before the exchange, so a task ships ``k`` rows per column.
    """
    df = normalize_missing(df)
    fences = iqr_fences(df, numeric_columns(df))
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, position int, value double")
    cells = []
    for c, f in fences.items():
        v = as_double(c)
        cells.append(
            F.when(
                (v < f["lower"]) | (v > f["upper"]),
                F.struct(v.alias("value"), F.abs(v - f["median"]).alias("distance")),
            ).alias(c)
        )
    order = Window.partitionBy("column").orderBy(F.desc("cell.distance"), F.asc("cell.value"))
    found = df.select(*cells).unpivot([], [col(c) for c in fences], "column", "cell").where("cell is not null")
    if k is None:
        return found.select("column", F.lit(None).cast("int").alias("position"), "cell.value")
    return (
        found.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select("column", "position", "cell.value")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``class, count, share`` of a target, with the smallest and largest share alongside."""
    df = normalize_missing(df)
    counts = (
        df.where(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = counts.agg(
        F.sum("count").alias("total"), F.min("count").alias("low"), F.max("count").alias("high")
    ).first()
    n = F.lit(total["total"])
    return counts.select(
        "class",
        "count",
        ratio(F.col("count"), n).alias("share"),
        ratio(F.lit(total["low"]), n).alias("min_share"),
        ratio(F.lit(total["high"]), n).alias("max_share"),
    )
