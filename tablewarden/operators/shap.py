"""SHAP values of forests over all rows, segments of similar explanations, and their reading."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import col, normalize_missing, numeric_columns
from tablewarden.functions.runtime import materialize, spread_out, together
from tablewarden.operators.models import (
    DEPTH,
    SEED,
    Tree,
    assemble,
    forest,
    problem_type,
    tree_arrays,
)

TREES = 50
# Products held per tree and step.
CELLS = 200_000
# Stands for the share of a side that no training row took.
LEAST_SHARE = 1e-12
TOO_SMALL = "Dataset too small for segmented SHAP analysis."
SEGMENT_SCHEMA = "cluster string, feature string, importance double, rank int"


@dataclass
class Paths:
    """A tree as seen from its edges, one per node below the root, the nodes in order of depth.

    ``share`` is the share of training rows that all edges of the same feature let through down to the
    node, ``earlier`` the last such edge above it (-1: none), ``levels`` the first node of each depth, ``t`` and
    ``weights`` the nodes of the integral. Children of the inner nodes of a level follow each other in the next one.
    """

    feature: np.ndarray
    cut: np.ndarray
    goes_left: np.ndarray
    earlier: np.ndarray
    share: np.ndarray
    inner: np.ndarray
    value: np.ndarray
    levels: np.ndarray
    t: np.ndarray
    weights: np.ndarray


def tree_paths(tree: Tree) -> Paths:
    order, edges, starts = [0], [(0, 0.0, False, -1, 1.0)], [0]
    level = [(0, {})]
    while level:
        starts.append(len(order))
        below = []
        for node, last in level:
            if tree.left[node] == node:
                continue
            f = int(tree.feature[node])
            for child in (int(tree.left[node]), int(tree.right[node])):
                earlier = last.get(f, -1)
                part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
                share = max((edges[earlier][4] if f in last else 1.0) * part, LEAST_SHARE)
                below.append((child, {**last, f: len(order)}))
                order.append(child)
                edges.append((f, tree.threshold[node], child == tree.left[node], earlier, share))
        level = below
    inner = tree.left[order] != np.array(order)
    t, weights = np.polynomial.legendre.leggauss(max(1, (len(starts) - 1) // 2))
    return Paths(
        *[np.array(part) for part in zip(*edges)], inner, np.where(inner[:, None], 0.0, tree.value[order]),
        np.array(starts), (t + 1) / 2, weights / 2,
    )


def tree_shap(paths: Paths, columns: np.ndarray, which: int) -> np.ndarray:
    """Path-dependent SHAP values of one tree, ``features x rows`` as the input, for trees of any depth.

    With z the share of rows that the edges of a feature let through and o whether the row passes them, a
    leaf of value v gives feature i: v (o_i - z_i) times the integral over t from 0 to 1 of the product over its
    other features of ((1 - t) z + t o), since s! (D-s-1)! / D! is the integral of t^s (1-t)^(D-1-s).
    Gauss-Legendre nodes, half as many as the tree is deep, make it exact. The products run down the tree
    once; on the way up each edge divides its own factor out of the sum below it, and likewise the factor of an earlier
    edge of its feature, which it replaces for the leaves below. Work per row: nodes x depth / 2.
    """
    p, rows = paths, columns.shape[1]
    missed = (1 - p.t) * p.share[:, None]
    passed = missed + p.t
    met = (columns[p.feature] <= p.cut[:, None]) == p.goes_left[:, None]
    product = np.empty((len(p.feature), len(p.t), rows))
    product[0] = 1.0
    for top, start, end in zip(p.levels, p.levels[1:], p.levels[2:]):
        again = start + np.flatnonzero(p.earlier[start:end] >= 0)
        met[again] &= met[p.earlier[again]]
        above = product[top:start][p.inner[top:start]]
        part = product[start:end]
        part[:] = np.where(met[start:end, None], passed[start:end, :, None], missed[start:end, :, None])
        part.reshape(len(above), 2, len(p.t), rows)[:] *= above[:, None]
        e = p.earlier[again]
        product[again] *= np.where(met[e, None], 1 / passed[e, :, None], 1 / missed[e, :, None])
    product *= np.where(p.inner, 1.0, p.value[:, which])[:, None, None]
    for top, start, end in reversed(list(zip(p.levels, p.levels[1:], p.levels[2:]))):
        inner = top + np.flatnonzero(p.inner[top:start])
        product[inner] = product[start:end].reshape(len(inner), 2, len(p.t), rows).sum(axis=1)

    edges = np.arange(1, len(p.feature))
    again = edges[p.earlier[edges] >= 0]
    found = np.zeros(columns.shape)
    for below, edge, sign in ((edges, edges, 1.0), (again, p.earlier[again], -1.0)):
        if not len(below):
            continue
        by_feature = np.argsort(p.feature[below], kind="stable")
        below, edge = below[by_feature], edge[by_feature]
        share = p.share[edge][:, None]
        given = np.stack([p.weights * (1 - share) / passed[edge], -p.weights * share / missed[edge]], axis=1)
        sums = np.matmul(given, product[below])
        parts = np.where(met[edge], sums[:, 0], sums[:, 1])
        features, starts = np.unique(p.feature[below], return_index=True)
        found[features] += sign * np.add.reduceat(parts, starts, axis=0)
    return found


def expected_value(trees: list[Tree], which: int) -> float:
    """Mean prediction of the forest over its training rows."""
    leaves = [t.left == np.arange(len(t.left)) for t in trees]
    return float(np.mean([np.average(t.value[k, which], weights=t.cover[k]) for t, k in zip(trees, leaves)]))


def explain(features: Column, trees: list[Tree], which: int = 0) -> Column:
    """SHAP values, in feature order, of an array of doubles under the mean of ``trees``, in Arrow batches.

    The trees travel with the tasks: trees x 2^(depth+1) nodes at most. Rows are taken in parts of about
    ``CELLS`` products per tree.
    """
    paths = [tree_paths(t) for t in trees]

    @F.pandas_udf("array<double>")
    def values(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        columns = np.ascontiguousarray(np.stack(batch.to_list()).T)
        total = np.zeros(columns.shape)
        for path in paths:
            step = max(16, CELLS // (len(path.feature) * len(path.t)))
            for start in range(0, columns.shape[1], step):
                part = slice(start, start + step)
                total[:, part] += tree_shap(path, columns[:, part], which)
        return pd.Series(list(total.T / len(paths)))

    return values(features)


def shap_values(
    df: DataFrame, target: str, problem: str | None = None, depth: int = DEPTH, trees: int = TREES
) -> tuple[DataFrame, list[str], float]:
    """SHAP values of a forest for every complete row.

    ``depth`` is the depth of its trees, up to the 30 levels of Spark's forests; deeper trees have up to
    twice the nodes per level. Returns ``features, label, prediction, shap`` (an array in feature order) as a lazy frame,
    the feature names and the expected value. Class targets explain class index 1.
    """
    df = normalize_missing(df).where(col(target).isNotNull())
    names = numeric_columns(df, [target])
    problem = problem or problem_type(df, target)
    ready = assemble(df.dropna(subset=names), target, names, problem)
    is_class = problem == "classification"
    model = forest(problem, trees, depth).fit(ready.data)
    grown = tree_arrays(model, df.sparkSession, is_class)
    which = min(1, grown[0].value.shape[1] - 1) if is_class else 0
    explained = model.transform(ready.data).select(
        vector_to_array("features").alias("features"), "label", "prediction",
        *([vector_to_array("probability").alias("probability")] if is_class else []),
        explain(vector_to_array("features"), grown, which).alias("shap"),
    )
    return explained, names, expected_value(grown, which)


def choose_k(vectors: DataFrame, max_k: int = 4) -> int:
    """Number of clusters with the best silhouette for k = 2..4 over all rows."""
    few = len(vectors.take(20))
    if few < 20:
        return 2
    judge = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")

    def silhouette(k: int) -> float:
        model = _clusters(k).fit(vectors)
        one = sum(1 for n in model.summary.clusterSizes if n) < 2
        return -1.0 if one else judge.evaluate(model.transform(vectors))

    sizes = list(range(2, max_k + 1))
    scores = together(*[lambda k=k: silhouette(k) for k in sizes])
    best = max(scores)
    return sizes[scores.index(best)] if best > -1.0 else 3


def _clusters(k: int) -> KMeans:
    return KMeans(k=k, seed=SEED, featuresCol="vector", predictionCol="cluster")


def segment_shares(assigned: DataFrame, names: list[str]) -> DataFrame:
    """``cluster, feature, importance, rank``: mean absolute SHAP value per cluster, scaled to 1."""
    means = assigned.groupBy("cluster").agg(
        *[F.avg(F.abs(F.get("shap", F.lit(i)))).alias(f"m{i}") for i in range(len(names))]
    )
    entries = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(names)]
    )
    # Clusters x features rows from here on.
    long = means.select("cluster", F.explode(entries).alias("e"))
    total = F.sum("e.mean").over(Window.partitionBy("cluster"))
    order = Window.partitionBy("cluster").orderBy(F.desc("importance"), "position")
    return (
        long.select(
            "cluster", "e.feature", "e.position",
            F.coalesce(F.try_divide(F.col("e.mean"), total), F.lit(0.0)).alias("importance"),
        )
        .withColumn("rank", F.row_number().over(order))
        .select(
            F.concat(F.lit("cluster_"), (F.col("cluster") + 1).cast("string")).alias("cluster"),
            "feature", "importance", "rank",
        )
    )


def segmented_shap(df: DataFrame, target: str, problem: str | None = None, depth: int = DEPTH) -> DataFrame:
    """Segments of rows the forest explains alike, with each segment's feature shares; ``depth`` as in ``shap_values``."""
    df = normalize_missing(df).where(col(target).isNotNull())
    names = numeric_columns(df, [target])
    complete = df.dropna(subset=names) if names else df
    if len(names) < 2 or len(complete.take(20)) < 20:
        return df.sparkSession.createDataFrame([], SEGMENT_SCHEMA)
    explained, names, _ = shap_values(df, target, problem, depth)
    vectors = spread_out(materialize(explained.select("shap", array_to_vector("shap").alias("vector"))))
    model = _clusters(choose_k(vectors)).fit(vectors)
    return segment_shares(model.transform(vectors), names)


def segment_insight(name: Column, feature: Column, share: Column) -> Column:
    """Reading of a segment's leading feature."""
    shown = F.format_string("%.1f", share * 100)
    # The texts.
    return (
        F.when(
            share > 0.80,
            F.concat(
                F.lit("WARNING: Suspected causal leakage detected in "), name, F.lit(". Feature '"), feature,
                F.lit("' has overwhelming predictive power ("), shown,
                F.lit("%), indicating it may be a proxy for the target."),
            ),
        )
        .when(
            share > 0.50,
            F.concat(
                F.lit("In "), name, F.lit(", '"), feature, F.lit("' strongly influences the model ("), shown,
                F.lit("% importance)."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("In "), name, F.lit(", predictive power is distributed evenly, with '"), feature,
                F.lit("' leading slightly."),
            )
        )
    )


def segment_insights(segments: DataFrame) -> DataFrame:
    """``position, insight``: whether the segments differ, then one reading per segment."""
    leaders = segments.where("rank = 1")
    # The texts.
    overall = leaders.agg(F.count_distinct("feature").alias("tops")).select(
        F.lit("").alias("cluster"),
        F.when(
            F.col("tops") > 1,
            "Feature importance differs significantly across data segments, indicating complex behavioral patterns.",
        )
        .otherwise("The primary predictive feature remains consistent across all structural data segments.")
        .alias("insight"),
    )
    each = leaders.select("cluster", segment_insight(F.col("cluster"), F.col("feature"), F.col("importance")).alias("insight"))
    return overall.unionByName(each)
