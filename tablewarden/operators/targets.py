"""Ranking columns by how likely they are the target, and columns that stand in for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import is_numeric, normalize_missing, numeric_columns, plain_columns, type_name
from tablewarden.functions.patterns import TARGET_EXACT_ONLY, TARGET_NAMES
from tablewarden.functions.stats import clamp, ratio
from tablewarden.operators.eda import correlation_pairs
from tablewarden.operators.profile import drop_junk_columns
from tablewarden.operators.values import distinct_summary, missing_counts

# The reason texts.
EXACT_NAME = "Exact match with common ML label naming conventions."
PARTIAL_NAME = "Partial match with common ML label naming conventions."
BINARY = "Binary distribution detected (standard classification target)."
BALANCED = "Classes are relatively balanced."
LOPSIDED = "Warning: Highly imbalanced binary classes."
CONTINUOUS = "Continuous numeric variable with sufficient variance (regression-compatible)."
FEW_CLASSES = "Low cardinality categorical variable (multi-class classification)."
GAPS = "Warning: Contains >20% missing values. Requires imputation if selected."
NOTHING = "Valid column but no specific ML target heuristics triggered."


def target_candidates(df: DataFrame, with_proxies: bool = False) -> DataFrame:
    """``column, score, reason, dtype, nunique, missing_pct`` by falling score."""
    df = normalize_missing(drop_junk_columns(df))
    names = plain_columns(df)
    rows, missing = missing_counts(df, names)
    listed = df.sparkSession.createDataFrame(
        [(c, type_name(df, c), is_numeric(df, c), rows, missing[c]) for c in names],
        "column string, dtype string, numeric boolean, rows bigint, missing bigint",
    )
    profile = listed.join(
        distinct_summary(df, names).select("column", "unique_count", "valid_count", "low_count"),
        "column",
        "left",
    ).withColumn("nunique", F.coalesce("unique_count", F.lit(0)))
    share = ratio(F.col("missing"), F.col("rows"))
    name, n = F.lower("column"), F.col("nunique")
    exact = name.isin(*TARGET_NAMES, *TARGET_EXACT_ONLY)
    partial = F.lit(False)
    for part in TARGET_NAMES:
        partial = partial | name.contains(part)
    partial = ~exact & partial
    binary = n == 2
    balanced = binary & (ratio(F.col("low_count"), F.col("valid_count")) > 0.1)
    continuous = F.col("numeric") & (n > 10)
    few = ~F.col("numeric") & (n > 2) & (n < 20)
    gaps = share > 0.2

    def points(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    score = (
        points(exact, 0.4) + points(partial, 0.2) + points(binary, 0.5) + points(balanced, 0.1)
        + points(continuous, 0.3) + points(few, 0.2) - points(gaps, 0.2)
    )
    reasons = F.array_compact(
        F.array(
            F.when(exact, EXACT_NAME).when(partial, PARTIAL_NAME),
            F.when(binary, BINARY),
            F.when(balanced, BALANCED).when(binary, LOPSIDED),
            F.when(continuous, CONTINUOUS),
            F.when(few, FEW_CLASSES),
            F.when(gaps, GAPS),
        )
    )
    ranked = (
        profile.where((share <= 0.8) & ~((n == F.col("rows")) & (F.col("rows") > 10)))
        .select(
            "column",
            F.round(clamp(score, 0.01, 0.99), 2).alias("score"),
            F.when(F.size(reasons) == 0, F.array(F.lit(NOTHING))).otherwise(reasons).alias("reason"),
            "dtype",
            "nunique",
            F.round(share * 100, 1).alias("missing_pct"),
        )
    )
    if with_proxies:
        found = (
            target_proxies(df)
            .groupBy(F.col("target").alias("column"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("proxy").alias("column"), "reason"))).alias("proxies"))
        )
        ranked = ranked.join(found, "column", "left")  # bounded by the number of columns
    return ranked.orderBy(F.desc("score"), "column")


def target_proxies(df: DataFrame, target: str | None = None) -> DataFrame:
    """``target, proxy, reason``: columns whose name contains the target's or the other way
    round, else columns correlated with it above 0.95."""
    df = normalize_missing(drop_junk_columns(df))
    names = df.columns
    wanted = names if target is None else [target]

    def bare(c: str) -> str:
        return c.lower().replace("_", "").replace("-", "")

    alike = {(t, c) for t in wanted for c in names if c != t and (bare(t) in bare(c) or bare(c) in bare(t))}
    texts = [(t, c, f"Semantic overlap with target name ('{c}' ~ '{t}').") for t, c in sorted(alike)]
    spark = df.sparkSession
    by_name = spark.createDataFrame(texts, "target string, proxy string, reason string")
    pairs = correlation_pairs(df, numeric_columns(df))
    both = pairs.select(F.col("left").alias("target"), F.col("right").alias("proxy"), "corr").unionByName(
        pairs.select(F.col("right").alias("target"), F.col("left").alias("proxy"), "corr")
    )
    strength = F.abs("corr")
    by_correlation = (
        both.where((strength > 0.95) & F.col("target").isin(*wanted))
        .join(by_name.select("target", "proxy"), ["target", "proxy"], "left_anti")
        .select(
            "target",
            "proxy",
            F.format_string(
                "Extremely high mathematical correlation (%.2f) with target."
                " Likely a duplicate or data leakage.",
                strength,
            ).alias("reason"),
        )
    )
    return by_name.unionByName(by_correlation)
