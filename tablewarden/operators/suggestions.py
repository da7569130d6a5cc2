"""Issue texts, severities, arbitration and ranking, as expressions on the issues table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.patterns import MEDIAN_NAMES

# Description and suggestion per issue type. {c} is the column, {p} the
# percentage, {r} the class ratio, {w} the correlated columns, {k} the kind of personal
# data, {t} the rule type and {e} the expected value.
TEXTS = {
    "missing_values": (
        "Missing values in '{c}' ({p}%) affecting model reliability",
        "Impute missing values (mean/median/mode)",
    ),
    "class_imbalance": (
        "Severe class imbalance detected ({r})",
        "Apply SMOTE, oversampling, or class weights",
    ),
    "high_correlation": (
        "Feature '{c}' is highly correlated with {w}",
        "Drop '{c}' to reduce multicollinearity",
    ),
    "outliers": (
        "Outliers detected in '{c}' ({p}% of data) impacting model stability",
        "Remove or cap extreme values using IQR or Z-score",
    ),
    "data_leakage": (
        "Data leakage: '{c}' is strongly correlated with target",
        "Remove '{c}' to prevent model overfitting",
    ),
    "uniqueness_violation": (
        "Duplicate identifiers found in ID column '{c}'",
        "Ensure unique identifiers or drop duplicates",
    ),
    "high_cardinality": (
        "Column '{c}' has very high cardinality",
        "Apply encoding (target/embedding) or drop feature",
    ),
    "pii_detected": (
        "Security Risk: '{c}' contains {k} ({p}%)",
        "Anonymize, hash, or drop this column before training!",
    ),
    "custom_rule_violation": (
        "Rule Violation: '{c}' failed '{t}' ({e})",
        "Review the data points that violate your custom business logic",
    ),
}
OTHER_TEXT = ("Detected issue: {i}", "Further investigation required")
MEDIAN_SUGGESTION = "Use median imputation for robustness"
# Least impact of an issue type whose severity is always HIGH.
SECURITY_IMPACT = {"pii_detected": 10.0, "custom_rule_violation": 8.0}


def _fill(template: str) -> Column:
    parts = {
        "c": F.coalesce(F.col("column"), F.lit("unknown")),
        "p": F.format_string("%.1f", F.coalesce("percentage", F.lit(0.0))),
        "r": F.coalesce(F.col("ratio"), F.lit("unknown")),
        "w": F.concat_ws(", ", "correlated_with"),
        "k": F.coalesce(F.col("pii_type"), F.lit("Sensitive Data")),
        "t": F.coalesce(F.col("rule_type"), F.lit("")),
        "e": F.coalesce(F.col("expected"), F.lit("None")),
        "i": F.col("type"),
    }
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        pieces += [F.lit(before), parts[key]]
    return F.concat(*pieces, F.lit(rest))


def _by_type(position: int) -> Column:
    chain = None
    for kind, texts in TEXTS.items():
        text = _fill(texts[position])
        chain = F.when(F.col("type") == kind, text) if chain is None else chain.when(F.col("type") == kind, text)
    return chain.otherwise(_fill(OTHER_TEXT[position]))


def severity_of(impact: Column) -> Column:
    return (
        F.when((impact > 5) | (F.col("type") == "data_leakage"), "HIGH")
        .when(impact > 2, "MEDIUM")
        .otherwise("LOW")
    )


def format_issues(issues: DataFrame) -> DataFrame:
    """Add severity, display text, description and suggestion to issues with an ``impact``."""
    impact = F.coalesce(F.col("impact").cast("double"), F.lit(0.0))
    shown = F.concat(
        F.when(impact >= 0, "+").otherwise(""), F.round(impact, 2).cast("string"), F.lit("%")
    )
    is_security = F.col("type").isin(*SECURITY_IMPACT)
    raised = impact
    for kind, least in SECURITY_IMPACT.items():
        raised = F.when(F.col("type") == kind, F.greatest(impact, F.lit(least))).otherwise(raised)
    name = F.lower("column")
    by_median = F.lit(False)
    for part in MEDIAN_NAMES:
        by_median = by_median | name.contains(part)
    return (
        issues.withColumn("severity", F.when(is_security, "HIGH").otherwise(severity_of(impact)))
        .withColumn("impact_display", shown)
        .withColumn("description", _by_type(0))
        .withColumn(
            "suggestion",
            F.when((F.col("type") == "missing_values") & by_median, MEDIAN_SUGGESTION).otherwise(_by_type(1)),
        )
        .withColumn("impact", raised)
    )


def severity_rank() -> Column:
    return F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)


def total_impact(formatted: DataFrame) -> DataFrame:
    return formatted.agg(
        F.round(F.coalesce(F.sum(F.greatest("impact", F.lit(0.0))), F.lit(0.0)), 2).alias("total_impact")
    )


def rank_issues(formatted: DataFrame) -> DataFrame:
    """Issues by falling impact and severity, with the summed positive impact alongside."""
    total = total_impact(formatted).first()["total_impact"]
    return formatted.withColumn("total_impact", F.lit(total)).orderBy(
        F.desc("impact"), F.desc(severity_rank()), "type", "column"
    )


def arbitrate(issues: DataFrame, outlier_percentage: float) -> DataFrame:
    """Leave out correlation findings, and outlier findings while under 5 % of rows are
    outliers by consensus."""
    weak = (F.col("type") == "outliers") & (F.lit(outlier_percentage) < 5.0)
    return issues.where((F.col("type") != "high_correlation") & ~weak)
