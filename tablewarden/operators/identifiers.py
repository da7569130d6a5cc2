"""Identifier columns: by name, by sequential values, or by near-unique text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    as_double,
    col,
    integral_columns,
    is_text,
    normalize_missing,
    plain_columns,
    text_columns,
)
from tablewarden.functions.patterns import IDENTIFIER_NAME, POTENTIAL_IDENTIFIER_NAME
from tablewarden.operators.ordered import melt_with_range, range_edges
from tablewarden.operators.values import distinct_estimates, distinct_summary

UNIQUE_RATIO = 0.995
GAP_SHARE = 0.95
ESTIMATE_SLACK = 0.9

IDENTIFIER = "IDENTIFIER_COLUMN_DETECTED"
POTENTIAL = "POTENTIAL_IDENTIFIER"
UNIQUE_TEXT = "HIGH_CARDINALITY_TEXT"


def has_identifier_name(name: str) -> bool:
    return re.search(IDENTIFIER_NAME, name.lower()) is not None


def near_unique_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns whose distinct share of present values is above 0.995.

    A sketch rules out columns far below the mark; only the rest are counted exactly.
    """
    _, estimates = distinct_estimates(df, columns)
    close = [c for c in columns if estimates[c][0] and estimates[c][1] >= ESTIMATE_SLACK * estimates[c][0]]
    if not close:
        return set()
    rows = distinct_summary(df, close).select("column", "unique_count", "valid_count").collect()
    return {r["column"] for r in rows if r["unique_count"] > UNIQUE_RATIO * r["valid_count"]}


def sequential_columns(
    df: DataFrame, columns: list[str] | None = None, row_key: str | None = None
) -> list[str]:
    """Integer columns of near-unique values with one dominant gap between neighbours.

    More than 95 % of the gaps of the ordered values are equal and not 0 (that gap is then
    the median gap). With ``row_key`` the values must also rise or fall throughout in key order.
    """
    df = normalize_missing(df)
    names = integral_columns(df) if columns is None else columns
    names = [c for c in names if c in near_unique_columns(df, names)]
    if not names:
        return []
    df = _from_least(df, names)
    edges = range_edges(df, names)
    cells = melt_with_range(df, names, edges)
    inside = Window.partitionBy("column", "bucket").orderBy("value")
    gaps = cells.select("column", (F.lead("value").over(inside) - F.col("value")).alias("gap")).where(
        "gap is not null"
    )
    ends = cells.groupBy("column", "bucket").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    across = Window.partitionBy("column").orderBy("bucket")  # one row per range
    border = ends.select("column", (F.lead("low").over(across) - F.col("high")).alias("gap")).where(
        "gap is not null"
    )
    counted = gaps.unionByName(border).groupBy("column", "gap").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        counted.groupBy("column")
        .agg(F.sum("n").alias("total"), F.max(F.struct("n", "gap")).alias("top"))
        .collect()  # one row per column
    )
    found = {
        r["column"]
        for r in rows
        if r["top"]["gap"] != 0 and r["top"]["n"] > GAP_SHARE * r["total"]
    }
    return [c for c in names if c in found and (row_key is None or is_monotone(df, c, row_key))]


def _from_least(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns counted from their least value, so that neighbouring 64-bit ids stay apart as doubles."""
    least = df.agg(*[F.min(col(c)).cast("decimal(38,0)").alias(f"m{i}") for i, c in enumerate(names)]).first()
    shifted = {c: (col(c).cast("decimal(38,0)") - F.lit(least[f"m{i}"])).cast("double") for i, c in enumerate(names) if least[f"m{i}"] is not None}
    return df.select(*[shifted.get(c, col(c)).alias(c) for c in df.columns])


def is_monotone(df: DataFrame, column: str, row_key: str) -> bool:
    """Whether ``column`` never falls, or never rises, in the order of a numeric row key."""
    if column == row_key:
        return True
    rows = normalize_missing(df).where(col(column).isNotNull()).select(
        as_double(row_key).alias("key"), as_double(column).alias("follower")
    )
    ranged = melt_with_range(rows, ["key"], range_edges(rows, ["key"]), keep=["follower"])
    inside = Window.partitionBy("bucket").orderBy("value", "follower")
    steps = ranged.select(
        "bucket", "value", "follower", F.lead("follower").over(inside).alias("next_follower")
    )
    step = F.col("next_follower") - F.col("follower")
    ends = (
        steps.groupBy("bucket")
        .agg(
            F.min_by("follower", F.struct("value", "follower")).alias("first"),
            F.max_by("follower", F.struct("value", "follower")).alias("last"),
            F.max(step).alias("rise"),
            F.min(step).alias("fall"),
        )
        .orderBy("bucket")
        .collect()  # one row per range
    )
    joins = [b["first"] - a["last"] for a, b in zip(ends, ends[1:])]
    rises = joins + [e["rise"] for e in ends if e["rise"] is not None]
    falls = joins + [e["fall"] for e in ends if e["fall"] is not None]
    return max(rises, default=0) <= 0 or min(falls, default=0) >= 0


def identifier_classes(
    df: DataFrame, target: str | None = None, row_key: str | None = None
) -> DataFrame:
    """``column, class`` for identifier columns; the target is never one."""
    found = classify_identifiers(df, target, row_key)
    rows = [(c, kind) for kind, names in found.items() for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, class string")


def classify_identifiers(
    df: DataFrame, target: str | None = None, row_key: str | None = None
) -> dict[str, list[str]]:
    df = normalize_missing(df)
    names = plain_columns(df, [target] if target else [])
    found: dict[str, list[str]] = {IDENTIFIER: [], POTENTIAL: [], UNIQUE_TEXT: []}
    by_name = [c for c in names if has_identifier_name(c)]
    if by_name:
        row = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(by_name)]).first()
        by_name = [c for i, c in enumerate(by_name) if row[f"c{i}"] > 0]
    others = [c for c in names if not has_identifier_name(c)]
    numbers = [c for c in integral_columns(df) if c in others]
    may_match = {
        c for c in others
        if c in numbers or is_text(df, c) or re.search(POTENTIAL_IDENTIFIER_NAME, c.lower())
    }
    unique = near_unique_columns(df, [c for c in others if c in may_match]) if may_match else set()
    sequential = sequential_columns(df, [c for c in numbers if c in unique], row_key) if unique else []
    for c in names:
        if c in by_name or c in sequential:
            found[IDENTIFIER].append(c)
        elif c in unique and re.search(POTENTIAL_IDENTIFIER_NAME, c.lower()):
            found[POTENTIAL].append(c)
        elif c in unique and c in text_columns(df):
            found[UNIQUE_TEXT].append(c)
    return found


def drop_identifiers(df: DataFrame, target: str | None = None, row_key: str | None = None) -> DataFrame:
    found = classify_identifiers(df, target, row_key)
    return df.drop(*[c for names in found.values() for c in names])
