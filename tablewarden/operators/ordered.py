"""Running sums and neighbours over a global order, split into value ranges.

A window without (or with a very coarse) partition key would run in one task. Here each
value gets a range number from quantile edges, windows run inside one range, and the small
table of range totals carries sums and neighbours across range borders.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import as_double, chunks
from tablewarden.functions.runtime import task_buckets


def range_edges(df: DataFrame, columns: list[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Ascending inner edges per column that split its rows into about equal ranges."""
    buckets = buckets or task_buckets(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    edges: dict[str, list[float]] = {}
    for part in chunks(columns, 60):
        row = df.agg(
            *[
                F.percentile_approx(as_double(c), probs, 10 * buckets).alias(f"e{i}")
                for i, c in enumerate(part)
            ]
        ).first()
        edges.update({c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(part)})
    return edges


def melt_with_range(
    df: DataFrame, columns: list[str], edges: dict[str, list[float]], keep: list[str] = ()
) -> DataFrame:
    """Long form ``(*keep, column, bucket, value)`` of numeric columns without missing values."""
    names = [f"v{i}" for i in range(len(columns))]
    wide = df.select(*keep, *[as_double(c).alias(v) for c, v in zip(columns, names)])
    ranged = Bucketizer(
        splitsArray=[[-float("inf"), *edges[c], float("inf")] for c in columns],
        inputCols=names,
        outputCols=[f"b{i}" for i in range(len(columns))],
        handleInvalid="keep",
    ).transform(wide)
    cells = [
        F.struct(F.col(f"b{i}").cast("int").alias("bucket"), F.col(v).alias("value")).alias(c)
        for i, (c, v) in enumerate(zip(columns, names))
    ]
    ids = [F.col(k) for k in keep]
    return (
        ranged.select(*keep, *cells)
        .unpivot(ids, [F.col("`" + c + "`") for c in columns], "column", "cell")
        .where("cell.value is not null")
        .select(*keep, "column", "cell.bucket", "cell.value")
    )


def _earlier(total: str) -> Column:
    """Sum of a total over the ranges before this one; runs on the table of ranges."""
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def running_sums(points: DataFrame, sums: list[str]) -> DataFrame:
    """Add ``<name>_to`` (sum up to and including the value) for each count column and
    ``next_value``. ``points`` has one row per ``(column, bucket, value)``."""
    totals = points.groupBy("column", "bucket").agg(
        *[F.sum(s).alias(f"total_{s}") for s in sums], F.min("value").alias("first_value")
    )
    follow = Window.partitionBy("column").orderBy("bucket")
    offsets = totals.select(
        "column",
        "bucket",
        *[_earlier(f"total_{s}").alias(f"offset_{s}") for s in sums],
        F.lead("first_value").over(follow).alias("next_first"),
    )
    inside = Window.partitionBy("column", "bucket").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = points.select(
        "*",
        *[F.sum(s).over(upto).alias(f"local_{s}") for s in sums],
        F.lead("value").over(inside).alias("local_next"),
    )
    # offsets holds columns x ranges rows, at most 2000 ranges per column.
    return local.join(F.broadcast(offsets), ["column", "bucket"]).select(
        *points.columns,
        *[(F.col(f"local_{s}") + F.col(f"offset_{s}")).alias(f"{s}_to") for s in sums],
        F.coalesce("local_next", "next_first").alias("next_value"),
    )
