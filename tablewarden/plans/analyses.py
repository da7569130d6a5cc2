"""Whole analyses: issue checks, the full governance run and the combined analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import col, normalize_missing, numeric_columns
from tablewarden.functions.runtime import materialize, together
from tablewarden.operators import eda as explore
from tablewarden.operators.checks import as_issues, detect_issues
from tablewarden.operators.drift import DRIFT_SCHEMA, drift_report
from tablewarden.operators.governance import audit_log, decide
from tablewarden.operators.identifiers import IDENTIFIER, classify_identifiers
from tablewarden.operators.impact import evaluate_remediations
from tablewarden.operators.importance import IMPACT_SCHEMA, TOO_SMALL, feature_impact, impact_insights
from tablewarden.operators.leakage import detect_leakage, worst_category
from tablewarden.operators.models import NoUsableFeatures, baseline_metrics, problem_type
from tablewarden.operators.outliers import flag_outliers, outlier_summary, top_outliers, univariate_outliers
from tablewarden.operators.profile import data_dictionary, drop_columns, drop_empty_columns
from tablewarden.operators.shap import segment_insights, segmented_shap
from tablewarden.operators.suggestions import arbitrate, format_issues, rank_issues
from tablewarden.plans.steps import run_steps
from tablewarden.sources.writer import write_results

AUTO = "Auto Detect"


def _problem(df: DataFrame, target: str, prediction_type: str | None) -> str:
    chosen = (prediction_type or AUTO).lower()
    return chosen if chosen in ("classification", "regression") else problem_type(df, target)


def _prepared(df: DataFrame, target: str, exclude: list[str] | None) -> DataFrame:
    df = drop_columns(normalize_missing(df), exclude or [])
    if target not in df.columns:
        raise ValueError(f"Confirmed target column '{target}' not found in dataset.")
    return df


def _formatted(df: DataFrame, target: str, issues: DataFrame, evaluate: bool, row_key: str | None) -> DataFrame:
    if evaluate:
        return evaluate_remediations(df, target, issues, row_key)
    return format_issues(issues.withColumn("impact", F.lit(0.0)))


def run_checks(
    df: DataFrame,
    target: str,
    rules: list[dict] | None = None,
    exclude: list[str] | None = None,
    evaluate: bool = True,
    row_key: str | None = None,
) -> dict[str, DataFrame]:
    """``issues`` as found and ``remediations`` ranked by impact with the total alongside.

    ``evaluate`` measures every fix with a model; without it impacts are 0.
    """
    df = drop_empty_columns(_prepared(df, target, exclude))
    issues = materialize(detect_issues(df, target, rules))
    ranked = rank_issues(_formatted(df, target, issues, evaluate, row_key))
    return {"issues": issues, "remediations": ranked}


def _impact_tables(df: DataFrame, target: str, problem: str) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    try:
        impact, base = feature_impact(df, target, problem)
    except NoUsableFeatures as e:
        impact, base, note = spark.createDataFrame([], IMPACT_SCHEMA), None, str(e)
    else:
        note = TOO_SMALL
    if base is None:
        return impact, spark.createDataFrame([(None, note)], "feature string, insight string")
    return impact, impact_insights(impact, F.lit(base)).select("feature", "insight")


def _outlier_tables(df: DataFrame, row_key: str | None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, float]:
    flagged = materialize(flag_outliers(df, columns=columns, row_key=row_key))
    summary = outlier_summary(flagged)
    share = summary.first()["percentage_flagged"]
    key = row_key or flagged.columns[0]
    return top_outliers(flagged, key), summary, float(share)


def run_governance(
    df: DataFrame,
    target: str,
    rules: list[dict] | None = None,
    exclude: list[str] | None = None,
    row_key: str | None = None,
    prediction_type: str | None = None,
    evaluate: bool = True,
    output_path: str | None = None,
    run_id: str | None = None,
) -> dict[str, DataFrame]:
    """All result tables of one governance run; ``output_path`` also writes them by run.

    Identifiers stay in the dictionary, the exploratory tables and the baseline, and are left
    out of everything a model sees.
    """
    spark = df.sparkSession
    df = _prepared(df, target, exclude)
    run_id = run_id or uuid.uuid4().hex
    found = classify_identifiers(df, target)
    df_ml = df.drop(*[c for names in found.values() for c in names])
    key = row_key if row_key in df_ml.columns else None
    # The key of the rows is kept for the outliers, also where it is an identifier that no model sees.
    keyed = df_ml if key or row_key not in df.columns else df.select(*[col(c) for c in [*df_ml.columns, row_key]])
    outlier_key = row_key if row_key in keyed.columns else None
    problem = _problem(df, target, prediction_type)

    issues = materialize(detect_issues(drop_empty_columns(df_ml), target, rules))
    formatted = materialize(_formatted(df_ml, target, issues, evaluate, key))
    (outliers, summary, share), (impact, insights), segments = together(
        lambda: _outlier_tables(keyed, outlier_key, numeric_columns(df_ml)),
        lambda: _impact_tables(df_ml, target, problem),
        lambda: materialize(segmented_shap(df_ml, target, problem)),
    )
    leakage = materialize(detect_leakage(df_ml, target, problem, impact))
    worst = worst_category(leakage).first()["worst_category"]
    arbitrated = materialize(arbitrate(formatted, share))

    base = baseline_metrics(df, target, row_key).first()
    rows = df.count()
    counts = arbitrated.groupBy().agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(f"{s}_issues") for s in ("critical", "high", "medium")],
        F.sort_array(F.collect_list(F.struct("type", "severity", "description"))).alias("issues"),
    )  # bounded by the number of columns and rules
    leaks = leakage.groupBy().agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("leakage_score")).alias("order"), "feature", "category", "leakage_score"))),
            lambda x: F.struct(x["feature"].alias("feature"), x["category"].alias("category"), x["leakage_score"].alias("leakage_score")),
        ).alias("leakage")
    )
    metrics = spark.createDataFrame(
        [
            (run_id, base["stability_score"], base["missingness_ratio"] if base["error"] is None else None, rows,
             len(df.columns), share, worst, counts.first().asDict(recursive=True)["issues"],
             leaks.first().asDict(recursive=True)["leakage"],
             [{"column": c, "class": kind} for kind, names in found.items() for c in names],
             *[counts.first()[f"{s}_issues"] for s in ("critical", "high", "medium")])
        ],
        "run_id string, stability double, missingness double, row_count bigint, feature_count int,"
        " outlier_percentage double, worst_category string,"
        " issues array<struct<type:string,severity:string,description:string>>,"
        " leakage array<struct<feature:string,category:string,leakage_score:double>>,"
        " identifiers array<struct<column:string,class:string>>,"
        " critical_issues bigint, high_issues bigint, medium_issues bigint",
    )
    decision = decide(metrics)
    # Confirmed leaks join the issue list; the score already carries their penalty.
    confirmed = as_issues(
        leakage.where("category = 'CONFIRMED_LEAKAGE'").select(F.col("feature").alias("column")), "data_leakage"
    ).withColumn("impact", F.lit(0.0))
    tables = {
        "issues": arbitrated.unionByName(format_issues(confirmed), allowMissingColumns=True),
        "column_profile": data_dictionary(df, found[IDENTIFIER], univariate_outliers(df)),
        **_exploratory_tables(df),
        "segments": segments,
        "segment_insights": segment_insights(segments),
        "outliers": outliers,
        "outlier_summary": summary,
        "feature_impact": impact,
        "impact_insights": insights,
        "leakage": leakage,
        "governance": decision.drop("issues", "leakage", "identifiers"),
        "audit_log": audit_log(decision, ["run_id"]),
    }
    if output_path:
        write_results({n: t.drop("run_id") for n, t in tables.items()}, output_path, run_id)
    return tables


def full_analysis(
    df: DataFrame,
    target: str,
    reference: DataFrame | None = None,
    config: list[dict] | None = None,
    row_key: str | None = None,
    prediction_type: str | None = None,
) -> dict[str, DataFrame]:
    """Outliers, feature impact, drift against a reference if given, and the log of the
    requested cleaning steps (by default a median fill)."""
    df = _prepared(df, target, None)
    outliers, summary, _ = _outlier_tables(df, row_key)
    impact, insights = _impact_tables(df, target, _problem(df, target, prediction_type))
    drift = (
        df.sparkSession.createDataFrame([], DRIFT_SCHEMA) if reference is None else drift_report(reference, df)
    )
    steps = [{"step": "impute_missing", "params": {"strategy": "median"}}] if config is None else config
    return {
        "outliers": outliers,
        "outlier_summary": summary,
        "feature_impact": impact,
        "impact_insights": insights,
        "drift": drift,
        "pipeline_log": run_steps(df, steps)[1],
    }


def eda(df: DataFrame) -> dict[str, DataFrame]:
    """Histograms (also in stored form), value counts, correlations, boxplots and outliers."""
    tables = _exploratory_tables(df)
    return {**tables, "distributions": explore.histogram_arrays(tables["histogram"])}


def _exploratory_tables(df: DataFrame) -> dict[str, DataFrame]:
    makers = {
        "histogram": explore.histogram,
        "value_counts": explore.top_value_counts,
        "correlation": explore.correlation_matrix,
        "boxplot": explore.boxplot,
        "boxplot_outliers": explore.boxplot_outliers,
    }
    return dict(zip(makers, together(*[lambda make=make: make(df) for make in makers.values()])))
