"""Column profile: missing cells, distinct values, ranges, warnings; and projections on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    TEXT_TYPES,
    as_double,
    col,
    is_numeric,
    normalize_missing,
    numeric_columns,
    plain_columns,
    present,
    text_columns,
    type_name,
)
from tablewarden.functions.patterns import JUNK_PREFIX, NUMBER_LIKE, PII_WHOLE_VALUES
from tablewarden.functions.stats import percent, ratio
from tablewarden.operators.values import (
    distinct_estimates,
    distinct_summary,
    missing_counts,
    sample_values,
)


def one_row_per_column(summary: DataFrame, fields: dict[str, dict[str, str]]) -> DataFrame:
    """Turn a one-row aggregate into a row per column.

    ``fields[column][output] = aggregate name``; every column lists the same outputs.
    """
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(src).alias(out) for out, src in outs.items()])
        for c, outs in fields.items()
    ]
    return summary.select(F.inline(F.array(*rows)))


def missing_values(df: DataFrame) -> DataFrame:
    """``column, count, percentage`` for columns with missing cells."""
    df = normalize_missing(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    fields = {c: {"rows": "rows", "valid": f"c{i}"} for i, c in enumerate(df.columns)}
    missing = F.col("rows") - F.col("valid")
    return (
        one_row_per_column(df.agg(*aggs), fields)
        .where(missing > 0)
        .select("column", missing.alias("count"), percent(missing, F.col("rows")).alias("percentage"))
    )


def missingness(df: DataFrame) -> DataFrame:
    """Missing cells over all cells, as one row."""
    df = normalize_missing(df)
    cells = F.count(F.lit(1)) * len(df.columns)
    valid = sum((F.count(col(c)) for c in df.columns), F.lit(0))
    return df.agg(ratio(cells - valid, cells).alias("missingness_ratio"))


def duplicate_ratio(df: DataFrame) -> DataFrame:
    """Rows after the first of each group of equal rows, over all rows.

    Two missing cells are equal. Copies are combined before the exchange.
    """
    df = normalize_missing(df)
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        ratio(F.sum("copies") - F.count(F.lit(1)), F.sum("copies")).alias("duplicate_ratio")
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return normalize_missing(df).dropDuplicates()


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*present(df, names))


def drop_junk_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(JUNK_PREFIX)])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    df = normalize_missing(df)
    rows, missing = missing_counts(df)
    return df.drop(*[c for c in df.columns if missing[c] == rows])


def drop_sparse_columns(
    df: DataFrame, threshold: float = 0.5, inclusive: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """Drop columns whose missing ratio is above (or, inclusive, at) the threshold."""
    df = normalize_missing(df)
    names = df.columns if columns is None else present(df, columns)
    rows, missing = missing_counts(df, names)
    if rows == 0:
        return df

    def sparse(share: float) -> bool:
        return share >= threshold if inclusive else share > threshold

    return df.drop(*[c for c in names if sparse(missing[c] / rows)])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return normalize_missing(df).where(col(target).isNotNull())


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = normalize_missing(df)
    return df.dropna(subset=columns or numeric_columns(df))


def unique_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """``column, unique_count`` without missing values; a sketch if ``exact`` is off."""
    df = normalize_missing(df)
    names = plain_columns(df)
    if exact:
        found = distinct_summary(df).select("column", "unique_count")
        listed = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
        return listed.join(found, "column", "left").select(
            "column", F.coalesce("unique_count", F.lit(0)).alias("unique_count")
        )
    aggs = [F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    fields = {c: {"unique_count": f"c{i}"} for i, c in enumerate(names)}
    return one_row_per_column(df.agg(*aggs), fields)


def _any_match(value: Column, patterns: list[str]) -> Column:
    matched = F.lit(False)
    for p in patterns:
        matched = matched | value.rlike(p)
    return F.max(matched)


def pii_warning(df: DataFrame) -> DataFrame:
    """Text columns with at least one value that is personal data as a whole."""
    names = text_columns(df)
    aggs = [
        F.coalesce(_any_match(col(c), PII_WHOLE_VALUES), F.lit(False)).alias(f"c{i}")
        for i, c in enumerate(names)
    ]
    fields = {c: {"pii_warning": f"c{i}"} for i, c in enumerate(names)}
    return one_row_per_column(df.agg(*aggs), fields)


def _format_flag(valid: Column, numbers: Column) -> Column:
    return (valid >= 10) & (numbers > valid * 0.8) & (numbers < valid)


def format_warning(df: DataFrame) -> DataFrame:
    """Text columns in which most, but not all, values look like numbers."""
    names = text_columns(df)
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count(col(c)).alias(f"v{i}"), F.count_if(col(c).rlike(NUMBER_LIKE)).alias(f"n{i}")]
    fields = {c: {"valid": f"v{i}", "numbers": f"n{i}"} for i, c in enumerate(names)}
    return one_row_per_column(df.agg(*aggs), fields).select(
        "column", _format_flag(F.col("valid"), F.col("numbers")).alias("format_warning")
    )


def imbalance_warning(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Non-numeric columns of 2 to 20 values in which one value holds over 95 %."""
    if summary is None:
        names = [c for c in plain_columns(df) if not is_numeric(df, c)]
        _, estimates = distinct_estimates(df, names)
        names = [c for c in names if 0 < estimates[c][1] <= 40]
        if not names:
            return df.sparkSession.createDataFrame([], "column string, imbalance_warning boolean")
        summary = distinct_summary(df, names)
    return summary.select("column", _imbalance_flag().alias("imbalance_warning"))


def _imbalance_flag() -> Column:
    return F.col("unique_count").between(2, 20) & (
        ratio(F.col("top_count"), F.col("valid_count")) > 0.95
    )


def data_dictionary(
    df: DataFrame, identifiers: list[str] | None = None, outlier_shares: DataFrame | None = None
) -> DataFrame:
    """One row per column: type, missing and distinct counts, samples, range or most
    frequent value, warnings, and the share of outliers of numeric columns.

    ``outlier_shares`` is ``column, outlier_percentage`` (see ``univariate_outliers``);
    identifiers have none.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    names = plain_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    fields: dict[str, dict[str, str]] = {}
    aggs += [
        F.lit(None).cast("double").alias("no_number"),
        F.lit(None).cast("boolean").alias("no_flag"),
        F.lit(0).cast("bigint").alias("no_count"),
    ]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"c{i}"))
        out = {
            "rows": "rows", "valid": f"c{i}", "min": "no_number", "max": "no_number",
            "mean": "no_number", "pii": "no_flag", "numbers": "no_count",
        }
        if is_numeric(df, c):
            v = as_double(c)
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}")]
            out.update({"min": f"lo{i}", "max": f"hi{i}", "mean": f"m{i}"})
        elif isinstance(df.schema[c].dataType, TEXT_TYPES):
            # The text of a time or a truth value matches none of the patterns.
            text = col(c)
            aggs += [
                _any_match(text, PII_WHOLE_VALUES).alias(f"p{i}"),
                F.count_if(text.rlike(NUMBER_LIKE)).alias(f"f{i}"),
            ]
            out.update({"pii": f"p{i}", "numbers": f"f{i}"})
        fields[c] = out
    base = one_row_per_column(df.agg(*aggs), fields)
    samples = sample_values(df, names)
    listed = spark.createDataFrame(
        [(c, type_name(df, c), is_numeric(df, c), samples.get(c, [])) for c in df.columns],
        "column string, data_type string, numeric boolean, sample_values array<string>",
    )
    joined = listed.join(base, "column").join(distinct_summary(df, names), "column", "left")
    if outlier_shares is None:
        joined = joined.withColumn("outlier_percentage", F.lit(None).cast("double"))
    else:
        joined = joined.join(outlier_shares, "column", "left")
    if identifiers:
        joined = joined.withColumn(
            "outlier_percentage", F.when(~F.col("column").isin(identifiers), F.col("outlier_percentage"))
        )
    text_only = ~F.col("numeric")
    return joined.select(
        "column",
        "data_type",
        "rows",
        (F.col("rows") - F.col("valid")).alias("missing_count"),
        F.round(percent(F.col("rows") - F.col("valid"), F.col("rows")), 2).alias("missing_percentage"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "sample_values",
        "min",
        "max",
        "mean",
        F.when(text_only, F.col("top_value")).alias("top_value"),
        "outlier_percentage",
        (text_only & F.coalesce("pii", F.lit(False))).alias("pii_warning"),
        (text_only & F.coalesce(_imbalance_flag(), F.lit(False))).alias("imbalance_warning"),
        (text_only & _format_flag(F.col("valid"), F.col("numbers"))).alias("format_warning"),
    )
