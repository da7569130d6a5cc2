"""What a fix changes: linear-model impact of an issue, and evaluation of all fixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import (
    as_double,
    categorical_columns,
    col,
    is_text,
    normalize_missing,
    numeric_columns,
)
from tablewarden.functions.runtime import stored_evenly, together
from tablewarden.operators.checks import ISSUE_FIELDS
from tablewarden.operators.cleaning import remediate
from tablewarden.operators.governance import (
    METRICS,
    confidence_points,
    metric_deltas,
    with_acceptance,
    with_confidence,
    with_impact,
)
from tablewarden.operators.models import FOLDS, baseline_metrics, problem_type, row_part
from tablewarden.operators.profile import drop_empty_columns
from tablewarden.operators.suggestions import SECURITY_IMPACT, format_issues
from tablewarden.operators.values import distinct_estimates, modes

ONE_HOT_LEVELS = 1000
HASHED_WIDTH = 1024
IMPACT_LIMIT = 30.0
TINY = 1e-6
NEGLIGIBLE = (
    " (Impact was negligible because the issue did not strictly degrade the model's structural distribution)."
)


@dataclass
class LinearScore:
    score: float
    std: float
    metric: str
    extra: float


def linear_score(df: DataFrame, target: str, row_key: str | None = None) -> LinearScore | None:
    """Three-fold score of a linear model: macro F1 and accuracy, or RMSE and R².

    Missing numbers are read as 0 on purpose, so that better fills can show. ``None`` if the
    target has fewer than 10 values or a single class.
    """
    if target not in df.columns:
        return None
    df = drop_empty_columns(df)
    if target not in df.columns:
        return None
    df = df.where(col(target).isNotNull())
    if len(df.take(10)) < 10:
        return None
    is_class = is_text(df, target) or problem_type(df, target) == "classification"
    numbers, texts = numeric_columns(df, [target]), categorical_columns(df, [target])
    fills = modes(df, texts) if texts else {}
    rows = df.select(
        *[F.coalesce(as_double(c), F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(numbers)],
        *[F.coalesce(col(c).cast("string"), F.lit(str(fills.get(c, "")))).alias(f"t{i}") for i, c in enumerate(texts)],
        (col(target).cast("string") if is_class else as_double(target)).alias("y"),
        row_part(df, row_key, FOLDS).alias("fold"),
    )
    _, estimates = distinct_estimates(df, texts) if texts else (0, {})
    small = [f"t{i}" for i, c in enumerate(texts) if estimates[c][1] <= ONE_HOT_LEVELS]
    large = [f"t{i}" for i, c in enumerate(texts) if estimates[c][1] > ONE_HOT_LEVELS]
    stages, parts = [], []
    if numbers:
        stages += [
            VectorAssembler(inputCols=[f"n{i}" for i in range(len(numbers))], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        ]
        parts.append("scaled")
    if small:
        stages += [
            StringIndexer(inputCols=small, outputCols=[f"{t}_i" for t in small], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{t}_i" for t in small], outputCols=[f"{t}_h" for t in small]),
        ]
        parts += [f"{t}_h" for t in small]
    if large:
        stages.append(FeatureHasher(inputCols=large, outputCol="hashed", numFeatures=HASHED_WIDTH))
        parts.append("hashed")
    if not parts:
        return None
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    rows = stored_evenly(rows, df)
    total = rows.count()
    if is_class:
        labels = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        rows = labels.transform(rows)
        if len(labels.labels) < 2:
            return None
        model = LogisticRegression(maxIter=100, regParam=1.0 / total)
    else:
        rows = rows.withColumn("label", F.col("y"))
        model = LinearRegression(regParam=1.0 / total)

    def fold(k: int) -> tuple[float, float]:
        fitted = Pipeline(stages=[*stages, model]).fit(rows.where(F.col("fold") != k))
        tested = fitted.transform(rows.where(F.col("fold") == k)).select("label", "prediction")
        return _class_fold(tested) if is_class else _value_fold(tested)

    first, second = zip(*together(*[lambda k=k: fold(k) for k in range(FOLDS)]))
    metric = "F1 Score" if is_class else "RMSE"
    return LinearScore(float(np.mean(first)), float(np.std(first)), metric, float(np.mean(second)))


def _class_fold(tested: DataFrame) -> tuple[float, float]:
    """Macro F1 and accuracy from the confusion counts (classes x classes rows)."""
    counts = tested.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    scores = []
    for c in {r["label"] for r in counts} | {r["prediction"] for r in counts}:
        hit = sum(r["n"] for r in counts if r["label"] == c and r["prediction"] == c)
        either = sum(r["n"] for r in counts if r["label"] == c) + sum(r["n"] for r in counts if r["prediction"] == c)
        scores.append(2.0 * hit / either if either else 0.0)
    right = sum(r["n"] for r in counts if r["label"] == r["prediction"])
    return (float(np.mean(scores)), right / total) if total else (0.0, 0.0)


def _value_fold(tested: DataFrame) -> tuple[float, float]:
    error = F.col("label") - F.col("prediction")
    row = tested.agg(F.avg(error * error).alias("mse"), F.var_pop("label").alias("var")).first()
    return float(np.sqrt(row["mse"] or 0.0)), (1 - row["mse"] / row["var"]) if row["var"] else 0.0


LINEAR_SCHEMA = (
    "type string, column string, impact double, baseline_score double, after_score double, metric string,"
    " confidence_score double, baseline_extra double, after_extra double"
)


def linear_impact(df: DataFrame, target: str, issues: list[dict], row_key: str | None = None) -> DataFrame:
    """Linear-model score before and after the fix of each issue, as relative impact in
    percent within ±30, with a confidence from the spread of the folds."""
    spark = df.sparkSession
    df = normalize_missing(df)
    before = linear_score(df, target, row_key)
    rows = []
    for issue in issues:
        kind, column = issue.get("type"), issue.get("column")
        if before is None:
            rows.append((kind, column, 0.0, None, None, None, 0.0, None, None))
            continue
        fixed = df.drop(column) if (kind or "").lower() == "high_cardinality" else remediate(df, issue)
        after = linear_score(fixed, target, row_key) or before
        gain = after.score - before.score if before.metric != "RMSE" else before.score - after.score
        size = abs(before.score) + TINY
        impact = max(-IMPACT_LIMIT, min(IMPACT_LIMIT, gain / size * 100))
        trust = max(0.0, min(100.0, 100 - before.std / size * 100))
        rows.append(
            (kind, column, round(impact, 2), round(before.score, 3), round(after.score, 3), before.metric,
             round(trust, 1), round(before.extra, 3), round(after.extra, 3))
        )
    return spark.createDataFrame(rows, LINEAR_SCHEMA)


def _with_prefix(metrics: DataFrame, prefix: str) -> DataFrame:
    return metrics.select(*[F.col(m).alias(f"{prefix}_{m}") for m in [*METRICS, "error"]])


def evaluate_remediations(
    df: DataFrame, target: str, issues: DataFrame, row_key: str | None = None
) -> DataFrame:
    """Apply each issue's fix, measure the baseline again and judge the change.

    One model fit per issue: the issue list is bounded by the number of columns.
    """
    spark = df.sparkSession
    df = normalize_missing(df)
    base = baseline_metrics(df, target, row_key).first().asDict()
    found = issues.collect()  # bounded by the schema and the rules
    if not found:
        return judge_remediations(spark.createDataFrame([], _paired_schema(issues)))
    fixes = [issue.asDict() for issue in found]
    measured = together(
        *[lambda fix=fix: baseline_metrics(remediate(df, fix), target, row_key).first().asDict() for fix in fixes]
    )
    rows = []
    for row, after in zip(fixes, measured):
        rows.append(
            (*[row[f] for f in ISSUE_FIELDS], base["problem_type"] or after["problem_type"] or "regression",
             *[base[m] for m in [*METRICS, "error"]], *[after[m] for m in [*METRICS, "error"]])
        )
    return judge_remediations(spark.createDataFrame(rows, _paired_schema(issues)))


def _paired_schema(issues: DataFrame) -> str:
    fields = [f"{n} {k}" for n, k in ISSUE_FIELDS.items()] + ["problem_type string"]
    for prefix in ("base", "cand"):
        fields += [f"{prefix}_{m} double" for m in METRICS] + [f"{prefix}_error string"]
    return ", ".join(fields)


def judge_remediations(paired: DataFrame) -> DataFrame:
    """Formatted issues with scores before and after, confidence, verdict and explanation.

    A rejected fix is blocked and its issue lowered, except personal data and rule
    violations, which stay HIGH. Fixes that could not be measured are uncertain.
    """
    judged = with_impact(with_acceptance(with_confidence(metric_deltas(paired))))
    failed = F.col("error").isNotNull()
    judged = judged.withColumn("measured", F.when(failed, F.lit(0.0)).otherwise(F.col("impact"))).withColumn(
        "impact", F.col("measured")
    )
    rejected = ~failed & (F.col("verdict") == "REJECTED")
    small = ~failed & (F.abs("measured") < 0.1) & (F.col("verdict") != "REJECTED")
    security = F.col("type").isin(*SECURITY_IMPACT)
    text = F.when(failed, "Could not compute reliable baseline.").otherwise(
        F.concat("explanation", F.when(small, NEGLIGIBLE).otherwise(""))
    )
    return format_issues(judged).select(
        *ISSUE_FIELDS,
        F.when(rejected & ~security, "LOW").otherwise(F.col("severity")).alias("severity"),
        "impact",
        "impact_display",
        "description",
        F.when(rejected, F.concat(F.lit("REMEDIATION BLOCKED: "), F.col("explanation")))
        .otherwise(F.col("suggestion"))
        .alias("suggestion"),
        F.when(~failed, F.col("baseline_score")).alias("baseline_score"),
        F.when(~failed, F.col("after_score")).alias("after_score"),
        F.when(~failed, F.col("metric")).alias("metric"),
        F.when(~failed, confidence_points(F.col("confidence"))).alias("confidence_score"),
        F.when(failed, "UNCERTAIN").otherwise(F.col("verdict")).alias("governance_verdict"),
        text.alias("governance_explanation"),
    )
