"""Exact interpolated quantiles without gathering a column in one task.

A mergeable sketch brackets each wanted rank, a counting pass places the bracket, and
brackets that still hold many values are narrowed by another sketch of their inside.
Only the few values between the final bounds are shuffled and ordered, so the shuffle is
a small share of the data and no task sees more than ``gather_limit`` values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import chunks, double_of

EXPRESSIONS_PER_PASS = 240


@dataclass
class _Slot:
    """One wanted quantile: ranks ``first`` and ``second`` (0-based) of one column."""

    column: int
    prob: float
    count: int
    first: int
    second: int
    low: float
    high: float
    below: int = 0
    inside: int = 0
    between: int = 0
    result: float | None = None

    def placed(self) -> bool:
        return self.below <= self.first and self.second < self.below + self.inside


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    accuracy: int = 2000,
    gather_limit: int = 1_000_000,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, skipping missing values.

    Returns one list per column, in the order of ``probs``; all ``None`` for an empty column.
    """
    if not columns:
        return {}
    data = df.select(*[double_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    slots = _sketch_brackets(data, len(columns), probs, accuracy)
    open_slots = [s for s in slots if s.result is None]
    rounds = 0
    while open_slots:
        _count_brackets(data, open_slots)
        for s in open_slots:
            if s.placed() and s.low == s.high:
                s.result = s.low
        open_slots = [s for s in open_slots if s.result is None]
        large = [s for s in open_slots if s.placed() and s.between > gather_limit]
        if large:
            _count_between(data, large)
        wide = [s for s in open_slots if not s.placed() or s.between > gather_limit]
        if not wide:
            break
        rounds += 1
        _narrow(data, wide, accuracy * rounds)
    if open_slots:
        _read_ranks(data, open_slots)
    by_key = {(s.column, s.prob): s.result for s in slots}
    return {c: [by_key.get((i, p)) for p in probs] for i, c in enumerate(columns)}


def _sketch_brackets(data: DataFrame, width: int, probs: list[float], accuracy: int) -> list[_Slot]:
    margin = 2.0 / accuracy
    ends = sorted({p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))})
    slots: list[_Slot] = []
    for part in chunks(list(range(width)), 60):
        aggs = []
        for i in part:
            v = F.col(f"v{i}")
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.min(v).alias(f"lo{i}"),
                F.max(v).alias(f"hi{i}"),
                F.percentile_approx(v, [float(e) for e in ends], accuracy).alias(f"e{i}"),
            ]
        row = data.agg(*aggs).first()
        for i in part:
            n = row[f"n{i}"]
            if n == 0:
                continue
            edge = dict(zip(ends, row[f"e{i}"]))
            for p in dict.fromkeys(probs):
                position = (n - 1) * p
                slot = _Slot(
                    i, p, n, math.floor(position), math.ceil(position),
                    edge[max(0.0, p - margin)], edge[min(1.0, p + margin)],
                )
                if p - margin <= margin:
                    slot.low = row[f"lo{i}"]
                if p + margin >= 1.0 - margin:
                    slot.high = row[f"hi{i}"]
                if slot.second == 0:
                    slot.result = row[f"lo{i}"]
                elif slot.first == n - 1:
                    slot.result = row[f"hi{i}"]
                elif slot.low == slot.high == row[f"lo{i}"] == row[f"hi{i}"]:
                    slot.result = slot.low
                slots.append(slot)
    return slots


def _count_brackets(data: DataFrame, slots: list[_Slot]) -> None:
    for part in chunks(slots, EXPRESSIONS_PER_PASS // 2):
        aggs = []
        for k, s in enumerate(part):
            v = F.col(f"v{s.column}")
            aggs += [F.count_if(v < s.low).alias(f"b{k}"), F.count_if(v <= s.high).alias(f"u{k}")]
        row = data.agg(*aggs).first()
        for k, s in enumerate(part):
            s.below, s.inside = row[f"b{k}"], row[f"u{k}"] - row[f"b{k}"]
            s.between = s.inside


def _count_between(data: DataFrame, slots: list[_Slot]) -> None:
    """Leave the two ends of a bracket out of its size: each is one value however often it occurs."""
    for part in chunks(slots, EXPRESSIONS_PER_PASS):
        aggs = [
            F.count_if((F.col(f"v{s.column}") > s.low) & (F.col(f"v{s.column}") < s.high)).alias(f"o{k}")
            for k, s in enumerate(part)
        ]
        row = data.agg(*aggs).first()
        for k, s in enumerate(part):
            s.between = row[f"o{k}"]


def _narrow(data: DataFrame, slots: list[_Slot], accuracy: int) -> None:
    """Replace each bracket by a tighter one; a bracket that missed its rank starts over."""
    margin = 2.0 / accuracy
    for part in chunks(slots, 60):
        aggs = []
        for k, s in enumerate(part):
            v = F.col(f"v{s.column}")
            if s.placed():
                inner: Column = F.when((v >= s.low) & (v <= s.high), v)
                start, stop = (s.first - s.below) / s.inside, (s.second + 1 - s.below) / s.inside
            else:
                inner, start, stop = v, s.first / s.count, (s.second + 1) / s.count
            ends = [max(0.0, start - 2 * margin), min(1.0, stop + 2 * margin)]
            aggs.append(F.percentile_approx(inner, ends, accuracy).alias(f"e{k}"))
        row = data.agg(*aggs).first()
        for k, s in enumerate(part):
            s.low, s.high = row[f"e{k}"]


def _read_ranks(data: DataFrame, slots: list[_Slot]) -> None:
    entries, any_hit = [], F.lit(False)
    for k, s in enumerate(slots):
        v = F.col(f"v{s.column}")
        hit = (v >= s.low) & (v <= s.high)
        any_hit = any_hit | hit
        entries.append(F.when(hit, F.struct(F.lit(k).alias("slot"), v.alias("v"))))
    counted = (
        data.where(any_hit)
        .select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.slot").alias("slot"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Every slot holds at most gather_limit distinct values plus its two ends.
    running = F.sum("n").over(Window.partitionBy("slot").orderBy("v"))
    ranked = counted.select("slot", "v", "n", (running - F.col("n")).alias("before"))
    wanted = F.array(
        *[F.array(F.lit(s.first - s.below), F.lit(s.second - s.below)) for s in slots]
    )
    pair = F.get(wanted, F.col("slot"))

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    rows = ranked.where(holds(pair[0]) | holds(pair[1])).collect()  # two rows per slot at most
    for k, s in enumerate(slots):
        value = {}
        for r in rows:
            if r["slot"] == k:
                for rank in (s.first - s.below, s.second - s.below):
                    if r["before"] <= rank < r["before"] + r["n"]:
                        value[rank] = r["v"]
        low, high = value[s.first - s.below], value[s.second - s.below]
        share = (s.count - 1) * s.prob - s.first
        s.result = low + (high - low) * share if s.second > s.first else low


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def iqr_fences(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Quartiles and the 1.5·IQR fences of every non-empty column."""
    fences = {}
    for c, (q1, q2, q3) in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        if q1 is not None:
            spread = q3 - q1
            fences[c] = {
                "q1": q1, "median": q2, "q3": q3,
                "lower": q1 - 1.5 * spread, "upper": q3 + 1.5 * spread,
            }
    return fences
