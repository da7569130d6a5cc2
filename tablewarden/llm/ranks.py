"""Gapless places of rows within their groups, without a window over a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import removed, stored, tasks, without

#: Rows that one task sorts.
ROWS_PER_TASK = 1_000_000
_AT_BITS = 33


def same(names: list[str], left: str, right: str) -> Column:
    """Equality of columns of two aliased tables in which null equals null."""
    return reduce(Column.__and__, [F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`")) for n in names])


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (gapless from 0 in each group, ascending by ``order``, nulls first) and ``group_rows``.

    Sampled splitters deal all rows into ranges of (group, order); each task sorts its range, and a table with one row
    per group and range carries the places on. Rows that are equal in ``order`` stand in the order of the input, which
    is stored once, so that a hot group or a repeated row is split like any other. An empty table stays empty.
    """
    first = stored(without(rows, "rank", "group_rows").withColumn("_tie", F.monotonically_increasing_id()))
    ranges = tasks(rows.sparkSession, first.count(), ROWS_PER_TASK)
    keys = [F.col(f"`{c}`") for c in [*group, *order]] + [F.col("_tie")]
    # After the sort this id holds the number of the range and the place in it.
    placed = stored(first.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    removed(first)
    placed = placed.withColumn("_range", F.shiftright("_at", _AT_BITS))
    spans = placed.groupBy(*[F.col(f"`{c}`") for c in group], "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy(*[F.col(f"`{c}`") for c in group])
    earlier = by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("group_rows", F.sum("_n").over(by))
    out = placed.alias("p").join(spans.alias("s"), same([*group, "_range"], "p", "s"))
    kept = [F.col(f"p.`{c}`") for c in first.columns if c != "_tie"]
    return out.select(*kept, (F.col("p._at") - F.col("s._first") + F.col("s._before")).alias("rank"), "s.group_rows")
