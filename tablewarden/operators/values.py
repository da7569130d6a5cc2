"""Value counts of many columns in one long table, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    FRACTIONAL_TYPES,
    INTEGRAL_TYPES,
    as_double,
    col,
    columns_of,
    plain_columns,
)


def melt(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """Long form ``(column, value)`` without missing values."""
    if as_type == "double":
        wide = df.select(*[as_double(c).alias(c) for c in columns])
    else:
        wide = df.select(*[col(c).cast(as_type).alias(c) for c in columns])
    return wide.unpivot([], [col(c) for c in columns], "column", "value").where("value is not null")


def value_counts(df: DataFrame, columns: list[str], as_type: str = "string") -> DataFrame:
    """``(column, value, n)``; map-side combined, so a hot value costs one row per task."""
    return melt(df, columns, as_type).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _families(df: DataFrame, columns: list[str]) -> list[tuple[str, list[str]]]:
    """Split columns by the type in which their values are grouped; each family reads its
    own columns only, so together they cost one scan."""
    chosen = set(columns)
    integral = [c for c in columns_of(df, INTEGRAL_TYPES) if c in chosen]
    fractional = [c for c in columns_of(df, FRACTIONAL_TYPES) if c in chosen]
    rest = [c for c in plain_columns(df) if c in chosen and c not in {*integral, *fractional}]
    return [(t, cs) for t, cs in (("bigint", integral), ("double", fractional), ("string", rest)) if cs]


def distinct_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``unique_count``, ``valid_count``, ``top_value`` (smallest of the
    most frequent), ``top_count``, ``low_count`` and ``sample_values`` (three smallest).

    Columns without any value are absent.
    """
    columns = plain_columns(df) if columns is None else columns
    parts = []
    for as_type, names in _families(df, columns):
        counts = value_counts(df, names, as_type)
        summary = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.sum("n").alias("valid_count"),
            F.min(F.struct((-F.col("n")).alias("order"), F.col("value"))).alias("top"),
            F.min("n").alias("low_count"),
        )
        parts.append(
            summary.select(
                "column",
                "unique_count",
                "valid_count",
                F.col("top.value").cast("string").alias("top_value"),
                (-F.col("top.order")).alias("top_count"),
                "low_count",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> dict[str, list]:
    """The ``k`` smallest distinct values per column, as text in value order.

    Each round takes the smallest value above the previous one: ``k`` scans that move one
    row per task, instead of a shuffle of every distinct value.
    """
    columns = plain_columns(df) if columns is None else columns
    data = df.select(*[col(c) for c in columns])
    found: dict[str, list] = {c: [] for c in columns}
    text: dict[str, list] = {c: [] for c in columns}
    active = list(columns)
    for _ in range(k):
        if not active:
            break
        aggs = []
        for i, c in enumerate(active):
            lowest = F.min(F.when(col(c) > F.lit(found[c][-1]), col(c)) if found[c] else col(c))
            aggs += [lowest.alias(f"v{i}"), lowest.cast("string").alias(f"t{i}")]
        row = data.agg(*aggs).first()
        for i, c in enumerate(list(active)):
            if row[f"v{i}"] is None:
                active.remove(c)
            else:
                found[c].append(row[f"v{i}"])
                text[c].append(row[f"t{i}"])
    return text


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Smallest most frequent value per column, typed as the column's family."""
    found: dict[str, object] = {}
    for as_type, names in _families(df, columns):
        rows = (
            value_counts(df, names, as_type)
            .groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("order"), F.col("value"))).alias("top"))
            .collect()  # one row per column
        )
        found.update({r["column"]: r["top"]["value"] for r in rows})
    return found


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and missing cells per column, in one pass over null flags."""
    columns = df.columns if columns is None else columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return row["rows"], {c: row["rows"] - row[f"c{i}"] for i, c in enumerate(columns)}


def distinct_estimates(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, tuple[int, int]]]:
    """Row count and ``(valid, estimated distinct)`` per column from one sketch pass.

    Used only to leave columns out of an exact count that they are far from qualifying for;
    the sketch error is 2 %.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"c{i}"), F.approx_count_distinct(col(c), 0.02).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    return row["rows"], {c: (row[f"c{i}"], row[f"d{i}"]) for i, c in enumerate(columns)}
