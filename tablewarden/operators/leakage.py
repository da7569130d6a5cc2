"""Target leakage: five signals per feature, their score and the resulting category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    as_double,
    col,
    is_numeric,
    normalize_missing,
    numeric_columns,
    plain_columns,
)
from tablewarden.functions.runtime import materialize, together
from tablewarden.functions.stats import n_log_n, pair_correlation, ratio
from tablewarden.operators.profile import one_row_per_column
from tablewarden.operators.quantiles import exact_quantiles
from tablewarden.operators.values import distinct_estimates

MIN_PAIRS = 30
# Values of a number up to which its information is that of its values, and of its deciles beyond.
MAX_LEVELS = 100
BINS = 10
# Categories by rising priority.
CATEGORIES = ["NORMAL_FEATURE", "STRONG_PREDICTOR", "HIGH_RISK_PROXY", "CONFIRMED_LEAKAGE"]


def features_of(df: DataFrame, target: str) -> list[str]:
    return plain_columns(df, [target])


def valid_pairs(df: DataFrame, target: str) -> DataFrame:
    """``feature, pairs``: rows in which both the feature and the target are present."""
    df = normalize_missing(df)
    names = features_of(df, target)
    aggs = [F.count(F.when(col(target).isNotNull(), col(c))).alias(f"n{i}") for i, c in enumerate(names)]
    fields = {c: {"pairs": f"n{i}"} for i, c in enumerate(names)}
    return one_row_per_column(df.agg(*aggs), fields).withColumnRenamed("column", "feature")


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """``feature, correlation``: absolute Pearson; 0 for text or where undefined."""
    df = normalize_missing(df)
    names = features_of(df, target)
    numbers = set(numeric_columns(df)) if is_numeric(df, target) else set()
    aggs, fields = [F.lit(0.0).alias("none"), F.count(F.lit(1)).alias("rows")], {}
    for i, c in enumerate(names):
        fields[c] = {"correlation": f"r{i}" if c in numbers else "none"}
        if c in numbers:
            r = pair_correlation(as_double(c), as_double(target))
            aggs.append(F.coalesce(F.abs(r), F.lit(0.0)).alias(f"r{i}"))
    return one_row_per_column(df.agg(*aggs), fields).withColumnRenamed("column", "feature")


def decile_bin(value: Column, edges: list[float]) -> Column:
    return sum(((value >= e).cast("int") for e in edges), F.lit(0)) if edges else F.lit(0)


def _inner_deciles(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    found = exact_quantiles(df, columns, [i / BINS for i in range(1, BINS)])
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


#: Marks the decile form of a number beside its values.
DECILES = "\x01"


def binned_features(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Text form of each feature: the decile of a number, the value of any other."""
    edges = _inner_deciles(df, [c for c in names if is_numeric(df, c)])
    return {
        c: F.when(as_double(c).isNotNull(), decile_bin(as_double(c), edges[c]).cast("string"))
        if c in edges
        else col(c).cast("string")
        for c in names
    }


def few_valued(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of at most ``MAX_LEVELS`` values, counted exactly where the sketch does not rule it out."""
    _, estimates = distinct_estimates(df, names) if names else (0, {})
    near = [c for c in names if estimates[c][1] <= 2 * MAX_LEVELS]
    found = df.agg(*[F.count_distinct(col(c)).alias(c) for c in near]).first() if near else {}
    return [c for c in near if found[c] <= MAX_LEVELS]


def value_and_decile(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Every feature by its values, and numbers by their deciles too (named with a mark)."""
    binned = binned_features(df, [c for c in names if is_numeric(df, c)])
    return {c: col(c).cast("string") for c in names} | {DECILES + c: x for c, x in binned.items()}


def best_form(powers: DataFrame) -> DataFrame:
    """The power of the better form of each feature."""
    name = F.regexp_replace("feature", f"^{DECILES}", "").alias("feature")
    return powers.groupBy(name).agg(F.max("predictive_power").alias("predictive_power"))


def contingency(
    df: DataFrame, target: str, x: dict[str, Column], y: Column, sums: dict[str, Column] | None = None
) -> DataFrame:
    """``feature, x, y, n, <sums>`` over valid pairs, stored because several totals follow.

    Counts are combined before the exchange, so a hot value costs one row per task.
    """
    sums = sums or {}
    wide = df.where(col(target).isNotNull()).select(
        y.alias("_y"), *[v.alias(f"_{k}") for k, v in sums.items()], *[v.alias(c) for c, v in x.items()]
    )
    keep = ["_y", *[f"_{k}" for k in sums]]
    parts = wide.unpivot([F.col(k) for k in keep], [col(c) for c in x], "feature", "x").where("x is not null")
    return materialize(
        parts.groupBy("feature", "x", F.col("_y").alias("y")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"_{k}").alias(k) for k in sums]
        )
    )


def mutual_information(table: DataFrame) -> DataFrame:
    """``feature, mutual_information`` in nats of a contingency table.

    From count entropies: each sum needs one grouping and none needs both margins at once.
    """
    joint = table.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum(n_log_n(F.col("n"))).alias("joint")
    )

    def margin(key: str) -> DataFrame:
        counts = table.groupBy("feature", key).agg(F.sum("n").alias("n"))
        return counts.groupBy("feature").agg(F.sum(n_log_n(F.col("n"))).alias(f"by_{key}"))

    value = F.ln("total") + (F.col("joint") - F.col("by_x") - F.col("by_y")) / F.col("total")
    return (
        joint.join(margin("x"), "feature")
        .join(margin("y"), "feature")
        .select("feature", F.greatest(value, F.lit(0.0)).alias("mutual_information"))
    )


def class_information(df: DataFrame, target: str) -> DataFrame:
    """Exact mutual information of every feature's values with a class target."""
    df = normalize_missing(df)
    x = {c: col(c).cast("string") for c in features_of(df, target)}
    return mutual_information(contingency(df, target, x, col(target).cast("string")))


def numeric_information(df: DataFrame, target: str) -> DataFrame:
    """Mutual information of feature values with the deciles of a numeric target; numbers of more than 100 values count by deciles."""
    df = normalize_missing(df)
    names = features_of(df, target)
    x, edges, few = together(
        lambda: binned_features(df, names), lambda: _inner_deciles(df, [target]),
        lambda: few_valued(df, [c for c in names if is_numeric(df, c)]),
    )
    x |= {c: col(c).cast("string") for c in few}
    y = decile_bin(as_double(target), edges.get(target, []))
    return mutual_information(contingency(df, target, x, y))


def held_out(df: DataFrame, row_key: str | None = None) -> Column:
    """True for the 30 % of the rows that single-feature lookups are tested on."""
    keys = [row_key] if row_key else plain_columns(df)
    return F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(10)) >= 7


def class_power(df: DataFrame, target: str, test: Column | None = None) -> DataFrame:
    """``feature, predictive_power``: held-out accuracy of predicting each value's most
    frequent training class; unseen values get the overall one. A number counts by its
    values or its deciles, whichever predict better."""
    df = normalize_missing(df)
    test = held_out(df) if test is None else test
    x = value_and_decile(df, features_of(df, target))
    train_row, test_row = F.when(test, 0).otherwise(1), F.when(test, 1).otherwise(0)
    table = contingency(df, target, x, col(target).cast("string"), {"train": train_row, "test": test_row})
    best = F.min(F.struct((-F.col("train")).alias("order"), "y"))
    overall = (
        table.groupBy("feature", "y").agg(F.sum("train").alias("train"))
        .groupBy("feature").agg(best["y"].alias("fallback"))
    )
    # One row per value: its winning class with that class's test rows, and all test rows.
    lookup = table.groupBy("feature", "x").agg(
        F.sum("train").alias("seen"),
        F.sum("test").alias("tested"),
        F.min(F.struct((-F.col("train")).alias("order"), "y", "test"))["test"].alias("right"),
    )
    seen = lookup.groupBy("feature").agg(
        F.sum("tested").alias("tested"), F.sum(F.when(F.col("seen") > 0, F.col("right"))).alias("right")
    )
    unseen = (
        table.join(lookup.where("seen = 0").select("feature", "x"), ["feature", "x"], "left_semi")
        .join(F.broadcast(overall), "feature")  # one row per feature
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("y") == F.col("fallback"), F.col("test"))).alias("extra"))
    )
    right = F.coalesce("right", F.lit(0)) + F.coalesce("extra", F.lit(0))
    return best_form(
        seen.join(unseen, "feature", "left").select(
            "feature", F.coalesce(ratio(right, F.col("tested")), F.lit(0.0)).alias("predictive_power")
        )
    )


def numeric_power(df: DataFrame, target: str, test: Column | None = None) -> DataFrame:
    """``feature, predictive_power``: 1 − RMSE / spread on held-out rows of predicting each
    value's training mean, at least 0; unseen values get the overall mean. A number counts by
    its values or its deciles, whichever predict better."""
    df = normalize_missing(df)
    test = held_out(df) if test is None else test
    x = value_and_decile(df, features_of(df, target))
    center = df.agg(F.avg(as_double(target))).first()[0]
    y = as_double(target) - F.lit(center)
    zero = F.lit(0.0)
    sums = {
        "train": F.when(test, 0).otherwise(1),
        "train_y": F.when(test, zero).otherwise(y),
        "test": F.when(test, 1).otherwise(0),
        "test_y": F.when(test, y).otherwise(zero),
        "test_yy": F.when(test, y * y).otherwise(zero),
    }
    table = contingency(df, target, x, F.lit(0), sums)
    overall = table.groupBy("feature").agg(ratio(F.sum("train_y"), F.sum("train")).alias("fallback"))
    mean = F.coalesce(ratio(F.col("train_y"), F.col("train")), F.col("fallback"), zero)
    error = F.col("test_yy") - 2 * mean * F.col("test_y") + F.col("test") * mean * mean
    totals = (
        table.join(F.broadcast(overall), "feature")  # one row per feature
        .groupBy("feature")
        .agg(
            F.sum(error).alias("sse"), F.sum("test").alias("n"),
            F.sum("test_y").alias("sy"), F.sum("test_yy").alias("syy"),
        )
    )
    n = F.col("n")
    rmse = F.sqrt(F.greatest(F.try_divide(F.col("sse"), n), zero))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("syy"), n) - F.pow(F.try_divide(F.col("sy"), n), 2), zero))
    power = F.greatest(zero, 1 - rmse / F.greatest(spread, F.lit(1e-6)))
    return best_form(totals.select("feature", F.coalesce(power, zero).alias("predictive_power")))


def score_signals(signals: DataFrame) -> DataFrame:
    """Add raw score, confidence and category to rows with the five signals."""
    corr, mi = F.col("correlation"), F.col("mutual_information")
    power, perm, abl = F.col("predictive_power"), F.col("permutation_importance"), F.col("ablation_impact")
    raw = (
        F.when(corr >= 0.95, 60.0).when(corr > 0.8, 20.0).otherwise(0.0)
        + F.when(power >= 0.99, 40.0).when(power > 0.90, 15.0).otherwise(0.0)
        + F.least(mi * 10, F.lit(20.0))
    )
    strong = ((power > 0.75) | (perm > 0.30) | (abl > 0.10)) & (corr < 0.95)
    confidence = F.lit(100.0) / (1 + F.exp(F.lit(-0.06) * (F.col("_raw") - 30)))
    normal, predictor, proxy, confirmed = CATEGORIES
    category = (
        F.when((corr >= 0.95) | (F.col("_raw") >= 85), confirmed)
        .when((F.col("_raw") >= 60) & ~strong, proxy)
        .when(strong, predictor)
        .otherwise(normal)
    )
    return (
        signals.withColumn("_raw", raw)
        .withColumn("category", category)
        .withColumn("leakage_score", F.round(confidence, 1))
        .withColumn("raw_score", F.round("_raw", 2))
        .drop("_raw")
    )


def category_priority(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category) - 1


def worst_category(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The category of highest priority, over all rows or per key."""
    top = F.max(F.struct(category_priority(F.col("category")).alias("priority"), F.col("category")))
    return scored.groupBy(*(keys or [])).agg(top["category"].alias("worst_category"))


SIGNALS = ["correlation", "mutual_information", "predictive_power", "permutation_importance", "ablation_impact"]


def detect_leakage(
    df: DataFrame,
    target: str,
    problem_type: str,
    impacts: DataFrame | None = None,
    test: Column | None = None,
) -> DataFrame:
    """``feature, category, leakage_score, raw_score`` and the five signals of every feature
    with at least 30 valid pairs. ``impacts`` is the feature impact table, if there is one."""
    df = normalize_missing(df)
    is_class = problem_type == "classification"
    information, power = together(
        lambda: (class_information if is_class else numeric_information)(df, target),
        lambda: (class_power if is_class else numeric_power)(df, target, test),
    )
    signals = (
        valid_pairs(df, target)
        .where(F.col("pairs") >= MIN_PAIRS)
        .join(target_correlation(df, target), "feature", "left")
        .join(information, "feature", "left")
        .join(power, "feature", "left")
    )
    if impacts is None:
        signals = signals.withColumn("permutation_importance", F.lit(0.0)).withColumn("ablation_impact", F.lit(0.0))
    else:
        measured = impacts.select(
            "feature",
            F.col("importance_score").alias("permutation_importance"),
            F.col("performance_impact").alias("ablation_impact"),
        )
        signals = signals.join(measured, "feature", "left")
    filled = signals.select("feature", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS])
    return score_signals(filled).select(
        "feature", "category", "leakage_score", "raw_score", *[F.round(s, 4).alias(s) for s in SIGNALS]
    )
