"""Cleaning, imputation, encoding, scaling and the fixes applied to single issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import (
    FRACTIONAL_TYPES,
    as_double,
    col,
    is_numeric,
    is_text,
    normalize_missing,
    numeric_columns,
    plain_columns,
    present,
    text_columns,
)
from tablewarden.functions.runtime import materialize, task_buckets
from tablewarden.operators.profile import drop_sparse_columns
from tablewarden.operators.quantiles import exact_quantiles, iqr_fences, medians
from tablewarden.operators.values import missing_counts, modes

MAX_LEVELS = 1000
# Copies of one row that a task makes at once, and slices that the rows of a class are drawn into.
COPY_BLOCK = 1000
DRAW_SLICES = 1024
DRAW_SEED = 42


def replace_columns(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns in place."""
    return df.select(*[values[c].alias(c) if c in values else col(c) for c in df.columns])


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value on both sides; missing stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def clean(df: DataFrame) -> DataFrame:
    """Distinct rows without columns over half missing; numbers filled with the median and
    clipped to their 1st..99th percentile, other columns filled with the mode.

    The distinct rows are written once because several passes read them.
    """
    df = drop_sparse_columns(materialize(normalize_missing(df).dropDuplicates()))
    numbers = numeric_columns(df)
    _, missing = missing_counts(df)
    middle = medians(df, [c for c in numbers if missing[c]])
    filled = {
        c: F.coalesce(as_double(c), F.lit(middle[c])) if c in middle else as_double(c) for c in numbers
    }
    bounds = exact_quantiles(replace_columns(df, filled), numbers, [0.01, 0.99])
    result = {c: clip(filled[c], *bounds[c]) for c in numbers if bounds[c][0] is not None}
    others = [c for c in plain_columns(df, numbers) if missing[c]]
    for c, value in modes(df, others).items() if others else []:
        result[c] = F.coalesce(col(c), F.lit(value).cast(df.schema[c].dataType))
    return replace_columns(df, result)


def impute(
    df: DataFrame, strategy: str = "mean", columns: list[str] | None = None
) -> tuple[DataFrame, int]:
    """Fill missing cells and count them. Numbers take the mean, median or mode; every other
    column its mode, or "Missing" if it has no value at all."""
    df = normalize_missing(df)
    names = _known(df, columns) if columns is not None else plain_columns(df)
    rows, missing = missing_counts(df, names)
    gaps = [c for c in names if missing[c]]
    by_number = [c for c in gaps if is_numeric(df, c) and strategy in ("mean", "median")]
    fills: dict[str, object] = {}
    if by_number and strategy == "mean":
        row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(by_number)]).first()
        fills = {c: row[f"m{i}"] for i, c in enumerate(by_number)}
    elif by_number:
        fills = medians(df, by_number)
    by_mode = [c for c in gaps if c not in by_number]
    if by_mode:
        found = modes(df, by_mode)
        fills.update({c: found.get(c, "Missing" if is_text(df, c) else None) for c in by_mode})
    values = {}
    for c, fill in fills.items():
        if fill is None:
            continue
        kind = df.schema[c].dataType
        whole = isinstance(fill, float) and not fill.is_integer()
        if c in by_number and whole and not isinstance(kind, FRACTIONAL_TYPES):
            kind = T.DoubleType()
        values[c] = F.coalesce(col(c).cast(kind), F.lit(fill).cast(kind))
    return replace_columns(df, values), sum(missing[c] for c in gaps)


def _known(df: DataFrame, columns: list[str]) -> list[str]:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return columns


def levels_of(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> list:
    """Sorted distinct values of a column; more than ``limit`` is an error, not a cut."""
    rows = (
        df.where(col(column).isNotNull()).select(col(column).alias("level")).distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"column '{column}' has more than {limit} levels")
    return sorted(r["level"] for r in rows)


def one_hot(df: DataFrame, columns: list[str] | None = None, limit: int = MAX_LEVELS) -> DataFrame:
    """Replace each column by one flag per level except the smallest, named ``column_level``.

    A missing cell sets no flag.
    """
    df = normalize_missing(df)
    names = text_columns(df) if columns is None else _known(df, columns)
    flags = []
    for c in names:
        for level in levels_of(df, c, limit)[1:]:
            flags.append(F.coalesce(col(c) == F.lit(level), F.lit(False)).alias(f"{c}_{level}"))
    return df.select(*[col(c) for c in df.columns if c not in set(names)], *flags)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``level, code`` with codes 0.. in sorted order of the distinct values.

    The levels are range-partitioned and stored with their range number; each range starts
    after the levels of the ranges before it, so no task numbers all levels.
    """
    levels = df.where(col(column).isNotNull()).select(col(column).alias("level")).distinct()
    ranged = materialize(
        levels.repartitionByRange("level").withColumn("range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("level")
    return (
        ranged.withColumn("position", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "range")
        .select("level", (F.col("start") + F.col("position")).cast("int").alias("code"))
    )


def label_encode(df: DataFrame, columns: list[str] | None = None, limit: int = MAX_LEVELS) -> DataFrame:
    """Replace each column by the code of its value in sorted order, -1 for missing.

    Up to ``limit`` levels become an expression; a larger level table is joined.
    """
    df = normalize_missing(df)
    names = text_columns(df) if columns is None else _known(df, columns)
    order = df.columns
    for c in names:
        try:
            levels = levels_of(df, c, limit)
        except ValueError:
            codes = label_codes(df, c).select(F.col("level").alias(c), F.col("code").alias("_code"))
            joined = df.join(codes, c, "left").withColumn(c, F.coalesce("_code", F.lit(-1)))
            df = joined.drop("_code").select(*[col(n) for n in order])
            continue
        positions = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<string>")
        code = F.array_position(positions, col(c)).cast("int") - 1
        df = replace_columns(df, {c: F.coalesce(code, F.lit(-1))})
    return df


def scale(df: DataFrame, method: str = "standard", columns: list[str] | None = None) -> DataFrame:
    """Standard (population spread, 1 if constant) or min-max scaling in place."""
    df = normalize_missing(df)
    names = numeric_columns(df) if columns is None else _known(df, columns)
    if not names or method not in ("standard", "minmax"):
        return df
    low, spread = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda v: F.max(v) - F.min(v))
    aggs = []
    for i, c in enumerate(names):
        aggs += [low(as_double(c)).alias(f"a{i}"), spread(as_double(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    values = {
        c: (as_double(c) - F.lit(row[f"a{i}"])) / F.lit(row[f"s{i}"] or 1.0)
        for i, c in enumerate(names)
        if row[f"a{i}"] is not None
    }
    return replace_columns(df, values)


def fix_missing(df: DataFrame, column: str, default: str = "Unknown") -> DataFrame:
    """Fill one column with its median or mode; text without any value takes ``default``."""
    df = normalize_missing(df)
    if is_numeric(df, column):
        middle = medians(df, [column])[column]
        if middle is None:
            return df
        return replace_columns(df, {column: F.coalesce(as_double(column), F.lit(middle))})
    fill = modes(df, [column]).get(column, default if is_text(df, column) else None)
    if fill is None:
        return df
    return replace_columns(df, {column: F.coalesce(col(column), F.lit(fill).cast(df.schema[column].dataType))})


def fix_outliers(df: DataFrame, column: str) -> DataFrame:
    """Clip one numeric column to its 1.5·IQR fences."""
    df = normalize_missing(df)
    f = iqr_fences(df, [column]).get(column)
    return df if f is None else replace_columns(df, {column: clip(as_double(column), f["lower"], f["upper"])})


def fix_cardinality(df: DataFrame, column: str, keep: int = 10, other: str = "Other") -> DataFrame:
    """Keep the most frequent values of a column; the rest and missing become ``other``."""
    df = normalize_missing(df)
    top = (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("level"))
        .limit(keep)
        .collect()
    )
    kept = [r["level"] for r in top]
    value = col(column).cast("string")
    return replace_columns(df, {column: F.when(col(column).isin(kept), value).otherwise(F.lit(other))})


def fix_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Top up every class to the size of the largest by repeating its rows.

    Each row is repeated as often as all rows of its class can be; a class's remainder goes
    to rows drawn at random. Class sizes come out exact without sorting or gathering a class. The copies of
    a row are spread over tasks in blocks, so a single row of a class is not expanded in one task. Rows
    without a class stay as they are.
    """
    df = normalize_missing(df)
    sizes = {
        r["level"]: r["n"]
        for r in df.where(col(target).isNotNull())
        .groupBy(col(target).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .limit(MAX_LEVELS + 1)
        .collect()
    }
    if len(sizes) > MAX_LEVELS:
        raise ValueError(f"target '{target}' has more than {MAX_LEVELS} classes")
    largest = max(sizes.values(), default=0)
    copies = F.lit(1)
    for v, n in sizes.items():
        if largest // n > 1:
            copies = F.when(col(target) == F.lit(v), F.lit(largest // n)).otherwise(copies)
    repeated = _copied(df, copies, max((largest // n for n in sizes.values()), default=1))
    short = {v: largest % n for v, n in sizes.items() if largest % n}
    return repeated.unionByName(_some_rows(df, target, short)) if short else repeated


def _copied(df: DataFrame, copies: Column, most: int) -> DataFrame:
    """Every row ``copies`` times (at most ``most``)."""
    once = df.withColumn("_copies", copies)
    few = once.where(F.col("_copies") <= COPY_BLOCK)
    few = few.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
    if most <= COPY_BLOCK:
        return few
    blocks = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPY_BLOCK).cast("int"))
    many = once.where(F.col("_copies") > COPY_BLOCK).withColumn("_block", F.explode(blocks))
    many = many.repartition(task_buckets(df.sparkSession))
    here = F.least(F.lit(COPY_BLOCK), F.col("_copies") - F.col("_block") * COPY_BLOCK)
    return few.unionByName(many.withColumn("_copy", F.explode(F.sequence(F.lit(1), here))).drop("_copy", "_copies", "_block"))


def _some_rows(df: DataFrame, target: str, wanted: dict) -> DataFrame:
    """Exactly ``wanted[class]`` rows of each class, drawn at random: whole slices of a stored draw first."""
    stored = materialize(
        df.where(col(target).isin(list(wanted))).withColumn("_part", F.floor(F.rand(DRAW_SEED) * DRAW_SLICES).cast("int"))
    )
    counted = (
        stored.groupBy(col(target).alias("level"), "_part").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("level", "_part")
        .collect()  # classes x slices
    )
    whole, border, limits = F.lit(False), F.lit(False), F.lit(0)
    for v, need in wanted.items():
        taken = 0
        for r in counted:
            if r["level"] != v:
                continue
            if taken + r["n"] > need:
                at_border = (col(target) == F.lit(v)) & (F.col("_part") == r["_part"])
                whole = whole | ((col(target) == F.lit(v)) & (F.col("_part") < r["_part"]))
                border = border | at_border
                limits = F.when(at_border, F.lit(need - taken)).otherwise(limits)
                break
            taken += r["n"]
    # A border group is one slice of a class; any of its rows will do.
    order = Window.partitionBy(col(target), "_part").orderBy(F.monotonically_increasing_id())
    cut = (
        stored.where(border)
        .withColumn("_limit", limits)
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") <= F.col("_limit"))
        .drop("_row", "_limit")
    )
    return stored.where(whole).unionByName(cut).drop("_part")


def clip_all(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip every numeric column to its 1st..99th percentile."""
    df = normalize_missing(df)
    bounds = exact_quantiles(df, numeric_columns(df), [low, high])
    return replace_columns(
        df, {c: clip(as_double(c), *b) for c, b in bounds.items() if b[0] is not None}
    )


def remediate(df: DataFrame, issue: dict) -> DataFrame:
    """Apply the fix of one issue ``{type, column}``; types are matched in any letter case.

    Issues without a fix leave the data unchanged.
    """
    kind, column = (issue.get("type") or "").lower(), issue.get("column")
    if kind == "outliers_consensus":
        return clip_all(df)
    if not present(df, [column]):
        return df
    if kind == "missing_values":
        return fix_missing(df, column)
    if kind == "outliers" and is_numeric(df, column):
        return fix_outliers(df, column)
    if kind == "high_cardinality":
        return fix_cardinality(df, column)
    if kind in ("high_correlation", "data_leakage"):
        return df.drop(column)
    if kind == "class_imbalance":
        return fix_imbalance(df, column)
    return df
