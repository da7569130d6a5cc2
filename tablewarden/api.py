"""Functions a user calls. Inputs are Spark DataFrames and results are Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.cleaning import clean
from tablewarden.operators.drift import drift_report, overall_drift, psi_against_histograms
from tablewarden.operators.governance import gate
from tablewarden.operators.identifiers import IDENTIFIER, classify_identifiers
from tablewarden.operators.models import feature_importance
from tablewarden.operators.outliers import univariate_outliers
from tablewarden.operators.profile import data_dictionary as _dictionary
from tablewarden.operators.profile import drop_junk_columns
from tablewarden.operators.shap import segment_insights, segmented_shap
from tablewarden.operators.targets import target_candidates
from tablewarden.plans.analyses import eda, full_analysis, run_checks, run_governance
from tablewarden.plans.steps import run_steps
from tablewarden.sources.reader import load_dataset
from tablewarden.sources.writer import read_results, write_cleaned, write_results

run_pipeline = run_steps


def profile_dataset(df: DataFrame) -> dict:
    """Ranked target candidates with their proxies, the usable columns and the totals."""
    usable = drop_junk_columns(df)
    return {
        "columns": usable.columns,
        "ranked_candidates": target_candidates(usable, with_proxies=True),
        "total_rows": df.count(),
        "total_columns": len(usable.columns),
    }


def data_dictionary(df: DataFrame, identifiers: list[str] | None = None, outliers: bool = True) -> DataFrame:
    """Column profile. ``identifiers`` get no outlier share and are found when not given."""
    names = classify_identifiers(df)[IDENTIFIER] if identifiers is None else identifiers
    return _dictionary(df, names, univariate_outliers(df) if outliers else None)


def detect_drift(df: DataFrame, histograms: DataFrame) -> DataFrame:
    """Columns of a new batch that moved away from the stored training histograms."""
    return psi_against_histograms(df, histograms)


def drift_detected(drifted: DataFrame) -> bool:
    """Whether a drift table lists anything, for both kinds of drift table."""
    rows = drifted.where("drift_detected") if "drift_detected" in drifted.columns else drifted
    return len(rows.select(F.lit(1)).take(1)) > 0


def assert_ready(df: DataFrame, target: str, **options) -> bool:
    """Run governance and raise if the dataset is rejected."""
    return gate(run_governance(df, target, **options)["governance"])


__all__ = [
    "assert_ready", "clean", "data_dictionary", "detect_drift", "drift_detected", "drift_report", "eda",
    "feature_importance", "full_analysis", "load_dataset", "overall_drift", "profile_dataset", "read_results",
    "run_checks", "run_governance", "run_pipeline", "run_steps", "segment_insights", "segmented_shap",
    "write_cleaned", "write_results",
]
