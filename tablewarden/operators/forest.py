"""Isolation forest: random trees over small samples, grown per tree on the workers and
scored with Arrow batches over all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import col

TREES = 100
SAMPLE = 256
NODE_SCHEMA = "forest string, tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(node, feature, threshold, left, right, depth)``; a leaf has feature -1 and
    points at itself, and its depth includes the expected depth of its unsplit rows."""
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = []
    waiting = [(rows, 0, 0)]
    free = 1
    while waiting:
        part, node, depth = waiting.pop()
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, node, node, depth + average_path(len(part))))
            continue
        feature = int(rng.choice(usable))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, free, free + 1, 0.0))
        waiting += [(part[goes_left], free, depth + 1), (part[~goes_left], free + 1, depth + 1)]
        free += 2
    return sorted(nodes)


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        forest, tree = str(pdf["forest"].iloc[0]), int(pdf["tree"].iloc[0])
        rows = np.array(pdf.sort_values("position")["features"].tolist(), dtype="float64")
        nodes = grow_tree(rows, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        out.insert(0, "forest", forest)
        return out

    return grow


@dataclass
class IsolationForest:
    """Trees of one or more named forests as arrays, at most ~51,000 nodes per forest."""

    forests: dict[str, tuple[list[dict], float]]


def score_rows(forest: tuple[list[dict], float], rows: np.ndarray) -> np.ndarray:
    trees, scale = forest
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for t in trees:
        node = np.zeros(len(rows), dtype="int32")
        for _ in range(t["levels"]):
            value = rows[index, t["feature"][node]]
            node = np.where(value <= t["threshold"][node], t["left"][node], t["right"][node])
        total += t["depth"][node]
    return np.power(2.0, -total / len(trees) / scale)


def _pool(df: DataFrame, columns: list[str], row_key: str | None, seed: int) -> DataFrame:
    """At most TREES x SAMPLE rows in random order, picked by a top-k per task."""
    shuffle = F.xxhash64(F.lit(seed), col(row_key)) if row_key else F.rand(seed)
    return df.select(F.array(*[col(c) for c in columns]).alias("features"), shuffle.alias("shuffle")).orderBy(
        "shuffle"
    ).limit(TREES * SAMPLE)


def fit_forest(
    df: DataFrame, columns: list[str], row_key: str | None = None, seed: int = 42, per_column: bool = False
) -> IsolationForest | None:
    """Fit on complete rows of double columns; ``per_column`` fits one forest per column.

    ``None`` if there are fewer than 10 rows.
    """
    if per_column:
        # Each column draws from its own present values, so that a sparse one still gets its forest.
        pools = [
            _pool(df.where(col(c).isNotNull()), [c], row_key, seed).withColumn("forest", F.lit(c)) for c in columns
        ]
        pool = reduce(DataFrame.unionByName, pools)
    else:
        pool = _pool(df, columns, row_key, seed).withColumn("forest", F.lit("rows"))
    # The pool is bounded, so numbering it in one task per forest is too.
    numbered = pool.withColumn(
        "position", F.row_number().over(Window.partitionBy("forest").orderBy("shuffle")) - 1
    ).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("forest")))
    psi = F.least(F.col("size"), F.lit(SAMPLE))
    # Tree t takes a run of the random order, wrapping round when the pool is small.
    trees = F.filter(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.pmod(F.col("position") - t * psi, F.col("size")) < psi
    )
    samples = numbered.where(F.col("size") >= 10).select(
        "forest", F.explode(trees).alias("tree"), "position", "features", "size"
    )
    nodes = samples.groupBy("forest", "tree").applyInPandas(_grow(seed), NODE_SCHEMA).toPandas()
    if nodes.empty:
        return None
    sizes = {r["forest"]: r["size"] for r in numbered.select("forest", "size").distinct().collect()}
    forests = {}
    for name, group in nodes.groupby("forest"):
        trees_of = []
        for _, t in group.sort_values(["tree", "node"]).groupby("tree"):
            feature = t["feature"].to_numpy()
            trees_of.append(
                {
                    "feature": np.maximum(feature, 0).astype("int32"),
                    "threshold": t["threshold"].to_numpy(),
                    "left": t["left"].to_numpy("int32"),
                    "right": t["right"].to_numpy("int32"),
                    "depth": t["depth"].to_numpy(),
                    "levels": int(math.ceil(math.log2(max(min(sizes[name], SAMPLE), 2)))),
                }
            )
        forests[name] = (trees_of, average_path(min(sizes[name], SAMPLE)))
    return IsolationForest(forests)


def row_score(spark, forest: IsolationForest | None, values: list[Column]) -> Column:
    """Anomaly score in 0..1 of each row; NULL where a value is missing or there is no forest."""
    if forest is None:
        return F.lit(None).cast("double")
    shared = spark.sparkContext.broadcast(forest.forests["rows"])

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        out = np.full(len(features), np.nan)
        known = features.notna().to_numpy()
        if known.any():
            out[known] = score_rows(shared.value, np.stack(features[known].to_list()).astype("float64"))
        return pd.Series(out)

    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    raw = score(F.when(complete, F.array(*values)))
    return F.when(~F.isnan(raw), raw)


def value_score(spark, forest: IsolationForest, column: Column, value: Column) -> Column:
    """Score of single values against the forest of their column."""
    shared = spark.sparkContext.broadcast(forest.forests)

    @F.pandas_udf("double")
    def score(names: pd.Series, values: pd.Series) -> pd.Series:
        forests = shared.value
        out = np.zeros(len(values))
        for name, index in names.groupby(names).indices.items():
            if name in forests:
                out[index] = score_rows(forests[name], values.to_numpy("float64")[index][:, None])
        return pd.Series(out)

    return score(column, value)
