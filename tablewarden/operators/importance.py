"""Feature impact: ablation, permutation importance, partial dependence and what they say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import as_double, col, normalize_missing, numeric_columns
from tablewarden.functions.rows import with_partners
from tablewarden.functions.runtime import heavy_tasks, materialize, together
from tablewarden.operators.models import (
    SEED,
    Assembled,
    alike,
    class_scores,
    cut_points,
    forest,
    inside_boxes,
    leaf_boxes,
    predict_rows,
    problem_type,
    train_baseline,
    tree_arrays,
    value_scores,
)
from tablewarden.operators.quantiles import exact_quantiles
from tablewarden.operators.values import distinct_estimates

TREES = 50
REPEATS = 5
GRID = 100
# Different rows that a task of partial dependence gathers before it looks at boxes.
HELD_ROWS = 50_000
TOO_SMALL = "Dataset too small or lacks numeric features for causal analysis."
IMPACT_SCHEMA = (
    "feature string, importance_score double, performance_impact double, marginal_effect_strength double,"
    " pdp_x array<double>, pdp_y array<double>"
)


def split_rows(ready: Assembled) -> tuple[DataFrame, DataFrame]:
    """80 % / 20 % by a draw per row, stored in random order of rows, so that equal rows fall on both sides."""
    slot = F.floor(F.rand(SEED) * 10)
    tasks = heavy_tasks(ready.data.sparkSession, ready.data.count())
    mixed = materialize(ready.data.select("features", "label", slot.alias("slot")).repartition(tasks, "slot", F.rand(SEED)))
    return mixed.where("slot >= 2").drop("slot"), mixed.where("slot < 2").drop("slot")


def _score(ready: Assembled, predicted: DataFrame) -> float:
    if ready.problem == "classification":
        return float(class_scores(predicted, []).first()["accuracy"] or 0.0)
    return float(value_scores(predicted, []).first()["r2"] or 0.0)


def ablation(ready: Assembled, train: DataFrame, test: DataFrame) -> tuple[dict[str, float], float, object]:
    """Loss of test score when a feature is left out and the forest retrained, at least 0."""
    model = forest(ready.problem, TREES).fit(train)
    base = _score(ready, model.transform(test))
    names = ready.features
    if len(names) < 2:
        return {c: max(0.0, base) for c in names}, base, model

    def without(i: int) -> float:
        slicer = VectorSlicer(
            inputCol="features", outputCol="kept", indices=[j for j in range(len(names)) if j != i]
        )

        def kept(df: DataFrame) -> DataFrame:
            return slicer.transform(df).select(F.col("kept").alias("features"), "label")

        return _score(ready, forest(ready.problem, TREES).fit(kept(train)).transform(kept(test)))

    scores = together(*[lambda i=i: without(i) for i in range(len(names))])
    return {c: max(0.0, base - s) for c, s in zip(names, scores)}, base, model


def permutation(ready: Assembled, model, test: DataFrame, repeats: int = REPEATS) -> dict[str, float]:
    """Mean loss of test score when a feature's values are shuffled over all test rows, at least 0.

    Each row meets ``repeats`` partners from anywhere in the table by one join and takes one
    feature at a time from them. All features and repeats are scored in one pass; tasks return
    one row per feature.
    """
    is_class = ready.problem == "classification"
    spark = test.sparkSession
    trees = tree_arrays(model, spark, is_class)
    width = len(ready.features)
    cuts = cut_points(trees, width)

    def losses(batches):
        total = np.zeros(width + 1)
        n = sy = syy = 0.0
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["features"].to_list())
            others = np.stack(batch["others"].to_list())
            y = batch["label"].to_numpy("float64")

            def loss(x):
                first, kind = alike(cuts, x)
                p = predict_rows(trees, x[first])[kind]
                return float((p.argmax(axis=1) != y).sum()) if is_class else float(((p[:, 0] - y) ** 2).sum())

            n, sy, syy = n + len(y), sy + y.sum(), syy + (y * y).sum()
            total[width] += loss(rows)
            for j in range(width):
                mixed = rows.copy()
                mixed[:, j] = others[:, j]
                total[j] += loss(mixed)
        index = np.arange(width + 1)
        yield pd.DataFrame({"feature": index, "loss": total, "n": n, "sy": sy, "syy": syy})

    paired = with_partners(test.select(vector_to_array("features").alias("features"), "label"), repeats, SEED)
    rows = (
        paired.select("own.features", "own.label", F.col("partner.features").alias("others"))
        .mapInPandas(losses, "feature int, loss double, n double, sy double, syy double")
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in ("loss", "n", "sy", "syy")])
        .collect()  # one row per feature
    )
    found = {r["feature"]: r for r in rows}
    if not found or not found[width]["n"]:
        return {c: 0.0 for c in ready.features}
    base = found[width]
    unit = base["n"] if is_class else base["syy"] - base["sy"] ** 2 / base["n"]
    return {
        c: max(0.0, (found[j]["loss"] - base["loss"]) / unit) if unit > 0 else 0.0
        for j, c in enumerate(ready.features)
    }


def _grids(df: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Distinct values of a feature if it has fewer than 100, else 100 steps from its 5th to
    its 95th percentile."""
    _, estimates = distinct_estimates(df, names)
    grids = {}
    wide = []
    for c in names:
        values = None
        if estimates[c][1] < 2 * GRID:
            rows = df.select(F.coalesce(as_double(c), F.lit(0.0)).alias("v")).distinct().limit(GRID).collect()
            values = sorted(r["v"] for r in rows) if len(rows) < GRID else None
        if values is None:
            wide.append(c)
        else:
            grids[c] = values
    filled = df.select(*[F.coalesce(as_double(c), F.lit(0.0)).alias(c) for c in wide]) if wide else df
    for c, (low, high) in exact_quantiles(filled, wide, [0.05, 0.95]).items():
        grids[c] = np.linspace(low, high, GRID).tolist()
    return grids


def _kinds(batches, cuts: list[np.ndarray]):
    """``rows, times``: the rows of all batches, those of a kind (``alike``) once as far as a task can hold them together."""

    def merged(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, kind = alike(cuts, rows)
        return rows[first], np.bincount(kind, times)

    rows, times = np.empty((0, len(cuts))), np.empty(0)
    for batch in batches:
        if not len(batch):
            continue
        new = np.stack(batch["features"].to_list())
        rows, times = merged(np.concatenate([rows, new]), np.concatenate([times, np.ones(len(new))]))
        if len(rows) > HELD_ROWS:
            yield rows, times
            rows, times = rows[:0], times[:0]
    if len(rows):
        yield rows, times


def partial_dependence(ready: Assembled, model, grids: dict[str, list[float]]) -> dict[str, tuple[list, list]]:
    """Average prediction over all rows with a feature set to each grid value.

    A leaf counts for a grid value by the rows that meet its other conditions, so one pass
    that counts rows per leaf and left-out feature serves every grid. Rows that no split tells
    apart are looked at once, with their number. Class targets use the first class, binary ones the second.
    """
    is_class = ready.problem == "classification"
    spark = ready.data.sparkSession
    trees = tree_arrays(model, spark, is_class)
    boxes, cuts = [leaf_boxes(t) for t in trees], cut_points(trees, len(ready.features))

    def counts(batches):
        totals = [np.zeros((len(b.feature), b.feature.shape[1] + 1)) for b in boxes]
        n = 0
        for values, times in _kinds(batches, cuts):
            for start in range(0, len(values), 1000):
                rows, many = values[start : start + 1000], times[start : start + 1000]
                n += many.sum()
                for t, b in enumerate(boxes):
                    ok = inside_boxes(b, rows)
                    misses = (~ok).sum(axis=2)
                    whole = misses == 0
                    totals[t][:, -1] += many @ whole
                    totals[t][:, :-1] += np.tensordot(many, whole[:, :, None] | ((misses == 1)[:, :, None] & ~ok), 1)
        if n:
            for t, table in enumerate(totals):
                leaf, slot = np.indices(table.shape)
                yield pd.DataFrame(
                    {"tree": t, "leaf": leaf.ravel(), "slot": slot.ravel(), "n": table.ravel(), "rows": float(n)}
                )

    found = (
        ready.data.select(vector_to_array("features").alias("features"))
        .mapInPandas(counts, "tree int, leaf int, slot int, n double, rows double")
        .groupBy("tree", "leaf", "slot")
        .agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        .toPandas()  # trees x leaves x depth rows
    )
    rows = float(found["rows"].iloc[0])
    which = (1 if len(ready.classes) == 2 else 0) if is_class else 0
    tables = [np.zeros((len(b.feature), b.feature.shape[1] + 1)) for b in boxes]
    for t, part in found.groupby("tree"):
        tables[t][part["leaf"], part["slot"]] = part["n"]
    curves = {}
    for j, c in enumerate(ready.features):
        x = np.array(grids[c], dtype="float64")
        y = np.zeros(len(x))
        for b, table in zip(boxes, tables):
            value = b.value[:, which]
            on_path = b.used & (b.feature == j)
            fixed = ~on_path.any(axis=1)
            y += (value[fixed] * table[fixed, -1]).sum()
            leaf, slot = np.nonzero(on_path)
            meets = (x[:, None] > b.low[leaf, slot]) & (x[:, None] <= b.high[leaf, slot])
            y += meets @ (value[leaf] * table[leaf, slot])
        curves[c] = (x.tolist(), (y / rows / len(boxes)).tolist())
    return curves


def feature_impact(df: DataFrame, target: str, problem: str | None = None) -> tuple[DataFrame, float | None]:
    """Impact table by falling permutation importance, and the test score of the full forest.

    Too small a dataset gives an empty table and no score.
    """
    spark = df.sparkSession
    df = normalize_missing(df).where(col(target).isNotNull())
    empty = spark.createDataFrame([], IMPACT_SCHEMA)
    if len(df.take(20)) < 20 or len(numeric_columns(df)) < 2:
        return empty, None
    problem = problem or problem_type(df, target)
    full, ready, _ = train_baseline(df, target, problem)
    train, test = split_rows(ready)
    lost, base, model = ablation(ready, train, test)
    shuffled = permutation(ready, model, test)
    curves = partial_dependence(ready, full, _grids(df, ready.features))
    rows = [
        (c, float(shuffled[c]), float(lost[c]), float(np.var(curves[c][1])), *curves[c]) for c in ready.features
    ]
    return spark.createDataFrame(rows, IMPACT_SCHEMA).orderBy(F.desc("importance_score"), "feature"), base


# What happened, why it matters, what to do. {f} is the feature, {d} the drop.
INSIGHTS = {
    "redundant": (
        "'{f}' showed high permutation importance but low ablation impact.",
        "This indicates possible feature redundancy or multicollinearity. The model relies on it, but if removed,"
        " another feature seamlessly takes its place.",
        "Investigate correlation with other top features and consider removing redundant ones to simplify the model.",
    ),
    "critical": (
        "'{f}' is structurally critical to model behavior. Removing it causes a {d}% drop in performance.",
        "This feature is driving the model's decisions. If this feature is a proxy for the target (data leakage),"
        " the model will fail in production.",
        "Verify this feature is logically available at the time of prediction. If it is, ensure its data quality is"
        " strictly monitored.",
    ),
    "sensitive": (
        "Model predictions are highly sensitive to changes in '{f}' (High PDP variability), despite low overall"
        " importance.",
        "The feature might only affect a very specific, small sub-population of your data, or it might be interacting"
        " with other features in complex ways.",
        "Review partial dependence plots for this feature to see exactly which ranges trigger drastic prediction"
        " changes.",
    ),
    "weak": (
        "'{f}' has weak influence on model predictions (low permutation and ablation).",
        "The feature provides almost no predictive signal.",
        "Consider dropping this feature to improve training speed and reduce maintenance overhead.",
    ),
    "moderate": (
        "'{f}' provides moderate predictive value.",
        "It contributes to the model's accuracy but is not the primary driver.",
        "Keep the feature unless you are aggressively pruning for simplicity.",
    ),
}


def insight_kind() -> Column:
    perm, abl = F.col("importance_score"), F.col("performance_impact")
    return (
        F.when((perm > 0.05) & (abl < 0.01), "redundant")
        .when(perm > 0.05, "critical")
        .when((perm < 0.01) & (abl < 0.01) & (F.col("marginal_effect_strength") > 0.1), "sensitive")
        .when((perm < 0.01) & (abl < 0.01), "weak")
        .otherwise("moderate")
    )


def drop_percent(base_score: Column) -> Column:
    """Loss by ablation as a bounded share of the score."""
    return F.tanh(F.col("performance_impact") / F.greatest(F.abs(base_score), F.lit(0.15))) * 100


def impact_insights(impact: DataFrame, base_score: Column, top: int | None = None) -> DataFrame:
    """Add ``kind``, ``drop_pct`` and ``insight`` to impact rows; ``top`` keeps the most important."""
    drop = F.format_string("%.1f", F.col("drop_pct"))
    text = None
    for kind, (happened, matters, action) in INSIGHTS.items():
        before, _, after = happened.partition("{f}")
        if "{d}" in after:
            left, _, right = after.partition("{d}")
            tail = F.concat(F.lit(left), drop, F.lit(right))
        else:
            tail = F.lit(after)
        line = F.concat(
            F.lit("**What happened:** " + before), F.col("feature"), tail,
            F.lit(f"\n\n**Why it matters:** {matters}\n\n**Recommended action:** {action}"),
        )
        text = F.when(F.col("kind") == kind, line) if text is None else text.when(F.col("kind") == kind, line)
    rows = impact if top is None else impact.orderBy(F.desc("importance_score"), "feature").limit(top)
    return rows.withColumn("kind", insight_kind()).withColumn("drop_pct", drop_percent(base_score)).withColumn(
        "insight", text
    )
