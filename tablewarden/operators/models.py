"""Model inputs, forests on pyspark.ml, and the cross-validated baseline of a dataset."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import (
    as_double,
    col,
    is_numeric,
    is_text,
    normalize_missing,
    numeric_columns,
    plain_columns,
)
from tablewarden.functions.runtime import ensure_checkpoint_dir, stored_evenly, together
from tablewarden.functions.stats import clamp
from tablewarden.operators.cleaning import label_codes
from tablewarden.operators.governance import stability_score
from tablewarden.operators.identifiers import classify_identifiers
from tablewarden.operators.profile import duplicate_ratio, missingness
from tablewarden.operators.quantiles import medians
from tablewarden.operators.values import distinct_estimates, distinct_summary

MAX_CLASSES = 1000
# Text levels that a stored index may hold; more are coded by a join, with the same codes.
MAX_CODED_LEVELS = 10_000
FOLDS = 3
SEED = 42
# Depth of forests unless a caller gives another.
DEPTH = 5
BASELINE_ERROR = "Insufficient data for baseline"


class NoUsableFeatures(ValueError):
    """The dataset has no column a model could use."""


def problem_type(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """``classification`` for non-numeric targets and those of few values, else ``regression``."""
    if not is_numeric(df, target):
        return "classification"
    _, estimates = distinct_estimates(df, [target])
    if estimates[target][1] > 2 * max_classes:
        return "regression"
    n = normalize_missing(df).select(F.count_distinct(col(target))).first()[0]
    return "classification" if n < max_classes else "regression"


def problem_types(df: DataFrame, max_classes: int = 20) -> DataFrame:
    """``column, problem_type`` of every column taken as the target."""
    counts = distinct_summary(normalize_missing(df)).select("column", "unique_count")
    numbers = numeric_columns(df)
    few = (F.col("unique_count") < max_classes) | ~F.col("column").isin(numbers)
    return counts.select("column", F.when(few, "classification").otherwise("regression").alias("problem_type"))


@dataclass
class Assembled:
    """Stored model input ``features, label[, fold]`` with the names behind it."""

    data: DataFrame
    features: list[str]
    problem: str
    classes: list[str]


def row_hash(df: DataFrame, row_key: str | None, salt: int = 0) -> Column:
    keys = [row_key] if row_key else plain_columns(df)
    return F.xxhash64(F.lit(salt), *[col(k) for k in keys])


def row_part(df: DataFrame, row_key: str | None, parts: int, salt: int = 0) -> Column:
    """Part 0 to ``parts`` - 1 of each row: by its key, else by a draw, so that equal rows do not all share a part.
    A draw must be stored with the rows before it is used twice."""
    if row_key:
        return F.pmod(row_hash(df, row_key, salt), F.lit(parts)).cast("int")
    return F.floor(F.rand(SEED + salt) * parts).cast("int")


def _coded(df: DataFrame, features: list[str], fill: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Add one double column per feature: numbers with gaps filled, times as seconds, text as
    the code of its sorted value. Above 10,000 levels or so the codes are joined instead of kept
    in a model; a level that many rows hold is split by the adaptive join of the session."""
    texts = [c for c in features if is_text(df, c)]
    _, estimates = distinct_estimates(df, texts) if texts else (0, {})
    indexed = [c for c in texts if estimates[c][1] <= MAX_CODED_LEVELS]
    names = [f"_f{i}" for i in range(len(features))]
    for c in indexed:
        df = df.withColumn(f"_text_{features.index(c)}", F.coalesce(col(c), F.lit("nan")))
    if indexed:
        where = [features.index(c) for c in indexed]
        df = (
            StringIndexer(
                inputCols=[f"_text_{i}" for i in where], outputCols=[f"_f{i}" for i in where],
                stringOrderType="alphabetAsc", handleInvalid="keep",
            )
            .fit(df)
            .transform(df)
        )
    for i, c in enumerate(features):
        kind = df.schema[c].dataType
        if c in indexed:
            continue
        if c in texts:
            df = df.withColumn(f"_text_{i}", F.coalesce(col(c), F.lit("nan")))
            codes = label_codes(df, f"_text_{i}")
            codes = codes.select(F.col("level").alias(f"_text_{i}"), F.col("code").cast("double").alias(names[i]))
            df = df.join(codes, f"_text_{i}", "left").drop(f"_text_{i}")
            continue
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.coalesce(F.unix_micros(col(c).cast("timestamp")) / 1e6, F.lit(0.0))
        elif isinstance(kind, T.BooleanType):
            value = F.coalesce(col(c).cast("double"), F.lit(0.0))
        else:
            value = F.coalesce(as_double(c), F.lit(fill.get(c, 0.0)))
        df = df.withColumn(names[i], value)
    return df, names


def assemble(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    problem: str | None = None,
    max_classes: int = 20,
    row_key: str | None = None,
    folds: int = 0,
    fill_median: bool = False,
) -> Assembled:
    """Model input of the rows with a target; ``folds`` adds a stable fold number per row."""
    df = normalize_missing(df).where(col(target).isNotNull())
    features = plain_columns(df, [target]) if features is None else features
    if not features:
        raise NoUsableFeatures("no usable features")
    problem = problem or problem_type(df, target, max_classes)
    fill = medians(df, [c for c in features if is_numeric(df, c)]) if fill_median else {}
    df = df.withColumn("fold", row_part(df, row_key, folds) if folds else F.lit(0))
    coded, names = _coded(df, features, {c: v for c, v in fill.items() if v is not None})
    classes: list[str] = []
    if problem == "classification":
        found = coded.select(col(target).cast("string").alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
        classes = sorted(r["c"] for r in found)
        if len(classes) > MAX_CLASSES:
            raise NoUsableFeatures(f"target '{target}' has more than {MAX_CLASSES} classes")
        codes = F.array(*[F.lit(c) for c in classes])
        label = (F.array_position(codes, col(target).cast("string")) - 1).cast("double")
    else:
        label = as_double(target)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(coded.withColumn("label", label))
    return Assembled(stored_evenly(ready.select("features", "label", "fold"), df), features, problem, classes)


def forest(problem: str, trees: int, depth: int = DEPTH):
    kind = RandomForestClassifier if problem == "classification" else RandomForestRegressor
    return kind(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label")


def class_scores(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and log loss per key of rows with ``label, prediction, probability``."""
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    safe = clamp(F.coalesce(p, F.lit(0.0)), 1e-15, 1 - 1e-15)
    return predicted.groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        (-F.avg(F.ln(safe))).alias("log_loss"),
    )


def value_scores(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """R², RMSE and MAE per key of rows with ``label, prediction``."""
    error = F.col("label") - F.col("prediction")
    return predicted.groupBy(*keys).agg(
        F.coalesce(1 - F.try_divide(F.avg(error * error), F.var_pop("label")), F.lit(0.0)).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


BASELINE_SCHEMA = (
    "problem_type string, accuracy double, log_loss double, r2 double, rmse double, mae double,"
    " stability_score double, missingness_ratio double, duplicate_ratio double, error string"
)


def baseline_metrics(df: DataFrame, target: str, row_key: str | None = None) -> DataFrame:
    """One row: three-fold scores of a small forest, stability, missing and duplicate shares."""
    spark = df.sparkSession
    df = normalize_missing(df)

    def failed(message: str) -> DataFrame:
        return spark.createDataFrame([(None,) * 9 + (message,)], BASELINE_SCHEMA)

    if target not in df.columns:
        return failed("Target column missing")
    if not plain_columns(df, [target]) or len(df.take(10)) < 10:
        return failed(BASELINE_ERROR)
    try:
        ready = assemble(df, target, max_classes=10, row_key=row_key, folds=FOLDS)
    except NoUsableFeatures as e:
        return failed(str(e))
    is_class = ready.problem == "classification"
    score = class_scores if is_class else value_scores
    filled = ready.data.select("fold").distinct().count()
    if filled < FOLDS:
        return failed(BASELINE_ERROR)

    def fold(k: int):
        train, test = ready.data.where(F.col("fold") != k), ready.data.where(F.col("fold") == k)
        return score(forest(ready.problem, 10, 3).fit(train).transform(test), []).first()

    *rows, gaps, copies = together(
        *[lambda k=k: fold(k) for k in range(FOLDS)],
        lambda: missingness(df).first()[0],
        lambda: duplicate_ratio(df).first()[0],
    )
    mean = {m: float(np.mean([r[m] for r in rows])) for m in rows[0].asDict()}
    spread = float(np.std([r["accuracy" if is_class else "r2"] for r in rows]))
    fields = ["accuracy", "log_loss", "r2", "rmse", "mae"]
    row = (ready.problem, *[mean.get(m) for m in fields], gaps, copies, spread)
    schema = (
        "problem_type string, accuracy double, log_loss double, r2 double, rmse double, mae double,"
        " missingness_ratio double, duplicate_ratio double, variation double"
    )
    stability = stability_score(F.col("variation"), F.col("missingness_ratio"), F.col("duplicate_ratio"))
    return spark.createDataFrame([row], schema).select(
        "problem_type", *fields, stability.alias("stability_score"), "missingness_ratio", "duplicate_ratio",
        F.lit(None).cast("string").alias("error"),
    )


def feature_importance(df: DataFrame, target: str, k: int | None = None, depth: int = DEPTH) -> DataFrame:
    """``feature, importance``: the importances in a forest of trees of ``depth`` over all rows, largest first; the
    ``k`` largest if given."""
    ready = assemble(df, target, max_classes=10, fill_median=True)
    model = forest(ready.problem, 50, depth).fit(ready.data)
    ranked = sorted(zip(ready.features, model.featureImportances.toArray().tolist()), key=lambda f: (-f[1], f[0]))
    return df.sparkSession.createDataFrame(ranked[:k], "feature string, importance double")


def model_features(df: DataFrame, target: str) -> list[str]:
    """Numeric columns that are neither the target nor an identifier."""
    found = classify_identifiers(df, target)
    ids = {c for names in found.values() for c in names}
    return numeric_columns(df, ids | {target})


def train_baseline(df: DataFrame, target: str, problem: str | None = None, trees: int = 100, depth: int = DEPTH):
    """Forest of trees of ``depth`` on the numeric features that are no identifiers: model, input, train-set score."""
    features = model_features(df, target)
    if not features:
        raise NoUsableFeatures("no usable features")
    ready = assemble(df, target, features, problem)
    model = forest(ready.problem, trees, depth).fit(ready.data)
    score = class_scores if ready.problem == "classification" else value_scores
    row = score(model.transform(ready.data), []).first()
    return model, ready, row["accuracy" if ready.problem == "classification" else "r2"]


@dataclass
class Tree:
    """One tree as arrays; a leaf points at itself. ``value`` holds class shares or the mean."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    levels: int


def tree_arrays(model, spark, is_class: bool) -> list[Tree]:
    """Read the trees of a fitted forest back from its saved form.

    Bounded by trees x 2^(depth+1) nodes, whatever the data size.
    """
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
            "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        )
        .orderBy("treeID", "id")
        .toPandas()
    )
    trees = []
    for _, t in nodes.groupby("treeID"):
        ids = t["id"].to_numpy("int32")
        leaf = t["leftChild"].to_numpy() < 0
        stats = np.stack(t["impurityStats"].to_list()).astype("float64")
        cover = stats.sum(axis=1) if is_class else stats[:, 0]
        value = stats / cover[:, None] if is_class else t["prediction"].to_numpy("float64")[:, None]
        threshold = np.array([v[0] if len(v) else 0.0 for v in t["leftCategoriesOrThreshold"]])
        left = np.where(leaf, ids, t["leftChild"]).astype("int32")
        right = np.where(leaf, ids, t["rightChild"]).astype("int32")
        depth = np.zeros(len(ids), dtype="int32")
        for i in ids:
            if not leaf[i]:
                depth[left[i]] = depth[right[i]] = depth[i] + 1
        feature = np.maximum(t["featureIndex"].to_numpy("int32"), 0)
        trees.append(Tree(feature, threshold, left, right, value, cover, int(depth.max())))
    return trees


def predict_rows(trees: list[Tree], rows: np.ndarray) -> np.ndarray:
    """Mean of the trees' values per row: one column, or one per class."""
    total = np.zeros((len(rows), trees[0].value.shape[1]))
    index = np.arange(len(rows))
    for t in trees:
        node = np.zeros(len(rows), dtype="int32")
        for _ in range(t.levels):
            goes_left = rows[index, t.feature[node]] <= t.threshold[node]
            node = np.where(goes_left, t.left[node], t.right[node])
        total += t.value[node]
    return total / len(trees)


def cut_points(trees: list[Tree], width: int) -> list[np.ndarray]:
    """The sorted thresholds of each of ``width`` features; Spark's forests have at most 31 per feature."""
    inner = [t.left != np.arange(len(t.left)) for t in trees]
    feature = np.concatenate([t.feature[k] for t, k in zip(trees, inner)])
    cut = np.concatenate([t.threshold[k] for t, k in zip(trees, inner)])
    return [np.unique(cut[feature == j]) for j in range(width)]


def alike(cuts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of every kind, and the kind of each row; rows of a kind lie on the same side of every cut."""
    code, size = np.zeros(len(rows), "int64"), 1
    for j, at in enumerate(cuts):
        if size * (len(at) + 1) >= 1 << 62:
            code, size = np.unique(code, return_inverse=True)[1], len(rows)
        code, size = code * (len(at) + 1) + np.searchsorted(at, rows[:, j]), size * (len(at) + 1)
    return np.unique(code, return_index=True, return_inverse=True)[1:]


@dataclass
class Leaves:
    """The leaves of one tree as boxes: per leaf up to ``depth`` features with an interval
    ``low < x <= high`` and the share of training rows that its splits let through."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    used: np.ndarray
    value: np.ndarray


def leaf_boxes(tree: Tree) -> Leaves:
    found = []
    waiting = [(0, {})]
    while waiting:
        node, box = waiting.pop()
        if tree.left[node] == node:
            found.append((box, tree.value[node]))
            continue
        f, cut = int(tree.feature[node]), float(tree.threshold[node])
        low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            part = share * tree.cover[child] / tree.cover[node]
            waiting.append((int(child), {**box, f: (*bounds, part)}))
    width = max(1, max(len(box) for box, _ in found))
    shape = (len(found), width)
    leaves = Leaves(
        np.zeros(shape, dtype="int32"), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape),
        np.zeros(shape, dtype=bool), np.stack([v for _, v in found]),
    )
    for i, (box, _) in enumerate(found):
        for d, (f, (low, high, share)) in enumerate(box.items()):
            leaves.feature[i, d], leaves.low[i, d], leaves.high[i, d] = f, low, high
            leaves.share[i, d], leaves.used[i, d] = share, True
    return leaves


def inside_boxes(leaves: Leaves, rows: np.ndarray) -> np.ndarray:
    """Per row, leaf and slot: whether the row meets the slot's interval."""
    x = rows[:, leaves.feature]
    return (x > leaves.low) & (x <= leaves.high)
