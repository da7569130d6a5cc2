"""Issue detection. Every check returns rows of one ``issues`` table."""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import (
    as_double,
    col,
    is_text,
    normalize_missing,
    numeric_columns,
    present,
    text_columns,
)
from tablewarden.functions.patterns import PARSABLE_NUMBER, PII_PATTERNS
from tablewarden.functions.stats import percent, ratio
from tablewarden.functions.runtime import together
from tablewarden.operators.eda import correlation_pairs
from tablewarden.operators.identifiers import has_identifier_name
from tablewarden.operators.profile import missing_values, one_row_per_column
from tablewarden.operators.quantiles import iqr_fences
from tablewarden.operators.values import distinct_estimates, distinct_summary

ISSUE_FIELDS = {
    "type": "string",
    "column": "string",
    "percentage": "double",
    "count": "bigint",
    "pii_type": "string",
    "ratio": "string",
    "min_class": "double",
    "correlated_with": "array<string>",
    "rule_type": "string",
    "expected": "string",
}
ISSUE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ISSUE_FIELDS.items())


def as_issues(found: DataFrame, issue_type: str) -> DataFrame:
    """Bring the rows of one check to the common issue columns."""
    have = set(found.columns)
    values = {"type": F.lit(issue_type)}
    return found.select(
        *[
            values.get(n, F.col(n) if n in have else F.lit(None)).cast(kind).alias(n)
            for n, kind in ISSUE_FIELDS.items()
        ]
    )


def no_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def uniqueness(df: DataFrame) -> DataFrame:
    """Columns named like an identifier that repeat a value; missing counts as one value."""
    df = normalize_missing(df)
    names = [c for c in df.columns if has_identifier_name(c)]
    if not names:
        return no_issues(df).select("column", "count", "percentage")
    rows = df.count()
    listed = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    # Missing rows are the rows without a present value; together they stand for one value.
    missing = F.lit(rows) - F.coalesce("valid_count", F.lit(0))
    extra = (
        F.lit(rows)
        - F.coalesce("unique_count", F.lit(0))
        - F.when(missing > 0, 1).otherwise(0)
    )
    return (
        listed.join(distinct_summary(df, names), "column", "left")
        .where(extra > 0)
        .select("column", extra.alias("count"), percent(extra, F.lit(rows)).alias("percentage"))
    )


def high_cardinality(df: DataFrame, share: float = 0.9, at_least: int = 50) -> DataFrame:
    """Text columns with more distinct values than 90 % of the rows, and more than 50."""
    df = normalize_missing(df)
    names = text_columns(df)
    rows, estimates = distinct_estimates(df, names)
    close = [c for c in names if estimates[c][1] >= 0.9 * share * rows]
    if not close:
        return no_issues(df).select("column", "count")
    count = F.col("unique_count")
    return (
        distinct_summary(df, close)
        .where((count > rows * share) & (count > at_least))
        .select("column", count.alias("count"))
    )


def pii(df: DataFrame, threshold: float = 5.0, columns: list[str] | None = None) -> DataFrame:
    """Text columns in which a kind of personal data is in more than ``threshold`` % of the
    present values; the first kind in the fixed order wins. All values are searched."""
    df = normalize_missing(df)
    names = text_columns(df) if columns is None else columns
    if not names:
        return no_issues(df).select("column", "pii_type", "percentage")
    aggs, fields = [], {}
    for i, c in enumerate(names):
        aggs.append(F.count(col(c)).alias(f"v{i}"))
        fields[c] = {"valid": f"v{i}"}
        for k, pattern in enumerate(PII_PATTERNS.values()):
            aggs.append(F.count_if(col(c).rlike(pattern)).alias(f"m{i}_{k}"))
            fields[c][f"m{k}"] = f"m{i}_{k}"
    shares = [
        F.struct(F.lit(kind).alias("pii_type"), percent(F.col(f"m{k}"), F.col("valid")).alias("percentage"))
        for k, kind in enumerate(PII_PATTERNS)
    ]
    found = F.get(F.filter(F.array(*shares), lambda s: s["percentage"] > threshold), F.lit(0))
    return (
        one_row_per_column(df.agg(*aggs), fields)
        .select("column", found.alias("found"))
        .where("found is not null")
        .select("column", "found.pii_type", "found.percentage")
    )


def class_imbalance(df: DataFrame, target: str, below: float = 0.1) -> DataFrame:
    """One row if the smallest class of a categorical target holds less than 10 %."""
    df = normalize_missing(df)
    summary = distinct_summary(df, [target])
    low = ratio(F.col("low_count"), F.col("valid_count"))
    high = ratio(F.col("top_count"), F.col("valid_count"))
    categorical = F.lit(True) if is_text(df, target) else F.col("unique_count") < 20
    return summary.where(categorical & (low < below)).select(
        "column",
        F.concat(F.lit("1:"), F.floor(F.try_divide(high, low)).cast("bigint").cast("string")).alias("ratio"),
        (low * 100).alias("min_class"),
    )


def high_correlation(df: DataFrame, above: float = 0.85) -> DataFrame:
    """Numeric columns with the earlier columns they correlate with, in schema order."""
    strong = correlation_pairs(df).where(F.abs("corr") > above)
    listed = F.sort_array(F.collect_list(F.struct("i", "left")))  # at most one entry per column
    return strong.groupBy(F.col("right").alias("column")).agg(
        F.transform(listed, lambda s: s["left"]).alias("correlated_with")
    )


def iqr_outliers(df: DataFrame, above: float = 1.0, min_values: int = 10) -> DataFrame:
    """Numeric columns with more than 1 % of the values outside the 1.5·IQR fences."""
    df = normalize_missing(df)
    fences = iqr_fences(df, numeric_columns(df))
    if not fences:
        return no_issues(df).select("column", "count", "percentage")
    aggs, fields = [], {}
    for i, (c, f) in enumerate(fences.items()):
        v = as_double(c)
        aggs += [
            F.count(v).alias(f"v{i}"),
            F.count_if((v < f["lower"]) | (v > f["upper"])).alias(f"o{i}"),
        ]
        fields[c] = {"valid": f"v{i}", "count": f"o{i}"}
    share = percent(F.col("count"), F.col("valid"))
    return (
        one_row_per_column(df.agg(*aggs), fields)
        .where((F.col("valid") >= min_values) & (share > above))
        .select("column", "count", share.alias("percentage"))
    )


def parsed_number(df: DataFrame, name: str) -> Column:
    """Number in a column, or NULL where its text is not one."""
    if is_text(df, name):
        return F.when(col(name).rlike(PARSABLE_NUMBER), F.trim(col(name)).try_cast("double"))
    return as_double(name)


def _violation(df: DataFrame, rule: dict) -> Column | None:
    name, kind, value = rule.get("column"), rule.get("type"), rule.get("value")
    if kind == "min" and value is not None:
        return parsed_number(df, name) < value
    if kind == "max" and value is not None:
        return parsed_number(df, name) > value
    if kind == "in" and isinstance(value, list):
        # A missing cell is allowed only if the list names null; values of another kind than the column never match.
        allowed = _comparable(df, name, [v for v in value if v is not None])
        return F.when(col(name).isNull(), F.lit(None not in value)).otherwise(~allowed)
    if kind == "not_null":
        return col(name).isNull()
    return None


def _comparable(df: DataFrame, name: str, values: list) -> Column:
    """Whether a present cell equals one of the values of the column's own kind."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        fit = [bool(v) for v in values if isinstance(v, (bool, int, float)) and v in (0, 1)]
        cell = col(name)
    elif isinstance(kind, T.NumericType):
        fit = [v for v in values if isinstance(v, (bool, int, float))]
        whole = [int(v) for v in fit if isinstance(v, (bool, int)) or float(v).is_integer()]
        parts = [float(v) for v in fit if not isinstance(v, (bool, int)) and not float(v).is_integer()]
        if not isinstance(kind, T.IntegralType):
            whole, parts = [], [float(v) for v in fit]
        tests = [col(name).cast("decimal(38,0)").isin([Decimal(v) for v in whole])] if whole else []
        tests += [as_double(name).isin(parts)] if parts else []
        return reduce(Column.__or__, tests) if tests else F.lit(False)
    else:
        fit = [v for v in values if isinstance(v, str)]
        cell = col(name) if is_text(df, name) else col(name).cast("string")
    return cell.isin(fit) if fit else F.lit(False)


def _expected_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def rule_violations(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows breaking each ``{column, type, value}`` rule; all rules share one scan.

    Rules on unknown columns or of unknown type are skipped.
    """
    df = normalize_missing(df)
    usable = [r for r in rules if present(df, [r.get("column")])]
    checks = [(r, v) for r in usable if (v := _violation(df, r)) is not None]
    if not checks:
        return no_issues(df).select("column", "rule_type", "expected", "count", "percentage")
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(f"b{i}") for i, (_, v) in enumerate(checks)]
    )
    rows = [
        F.struct(
            F.lit(r["column"]).alias("column"),
            F.lit(r["type"]).alias("rule_type"),
            F.lit(_expected_text(r.get("value"))).cast("string").alias("expected"),
            F.col(f"b{i}").alias("count"),
            percent(F.col(f"b{i}"), F.col("rows")).alias("percentage"),
        )
        for i, (r, _) in enumerate(checks)
    ]
    return summary.select(F.inline(F.array(*rows))).where(F.col("count") > 0)


def detect_issues(
    df: DataFrame, target: str, rules: list[dict] | None = None, pii_threshold: float = 5.0
) -> DataFrame:
    """All checks as one issues table without repeated findings."""
    df = normalize_missing(df)
    parts = together(
        lambda: as_issues(iqr_outliers(df), "outliers"),
        lambda: as_issues(high_correlation(df), "high_correlation"),
        lambda: as_issues(high_cardinality(df), "high_cardinality"),
        lambda: as_issues(uniqueness(df), "uniqueness_violation"),
        lambda: as_issues(missing_values(df), "missing_values"),
        lambda: as_issues(pii(df, pii_threshold), "pii_detected"),
        lambda: as_issues(class_imbalance(df, target), "class_imbalance"),
        lambda: as_issues(rule_violations(df, rules or []), "custom_rule_violation"),
    )
    return reduce(DataFrame.unionByName, parts).dropDuplicates(
        ["type", "column", "pii_type", "rule_type", "expected"]
    )
