"""Named cleaning steps run in order, with one log row per step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tablewarden.functions.columns import normalize_missing, numeric_columns, text_columns
from tablewarden.operators import cleaning
from tablewarden.operators.outliers import flag_outliers
from tablewarden.operators.profile import drop_sparse_columns

LOG_SCHEMA = "position int, step_name string, transformation_applied string, rows_affected bigint"
Step = Callable[..., tuple[DataFrame, dict]]


def _log(name: str, text: str, rows: int) -> dict:
    return {"step_name": name, "transformation_applied": text, "rows_affected": rows}


def impute_missing(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None):
    result, cells = cleaning.impute(df, strategy, columns)
    return result, _log("Impute Missing Values", f"Replaced missing with {strategy}", cells)


def remove_outliers(
    df: DataFrame, min_votes: int = 2, columns: list[str] | None = None, row_key: str | None = None, **_
):
    """Drop rows that at least ``min_votes`` detectors flag.

    Configurations also carry a ``threshold``, which voting does not use.
    """
    flagged = flag_outliers(df, columns=columns, min_votes=min_votes, row_key=row_key)
    removed = flagged.where("is_outlier").count()
    kept = flagged.where("not is_outlier").select(*df.columns)
    return kept, _log("Remove Outliers", f"Removed rows with at least {min_votes} detector votes", removed)


def encode_categorical(df: DataFrame, strategy: str = "one_hot", columns: list[str] | None = None):
    names = text_columns(df) if columns is None else columns
    encoders = {"one_hot": cleaning.one_hot, "label": cleaning.label_encode}
    result = encoders[strategy](df, names) if names and strategy in encoders else df
    text = f"Applied {strategy} encoding to {len(names)} columns"
    return result, _log("Encode Categorical", text, df.count() if names else 0)


def drop_missing(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None):
    result = drop_sparse_columns(df, threshold, inclusive=True, columns=columns)
    dropped = len(df.columns) - len(result.columns)
    text = f"Dropped {dropped} columns exceeding {threshold * 100}% missing"
    return result, _log("Drop Missing Columns", text, 0)


def scale_features(df: DataFrame, method: str = "standard", columns: list[str] | None = None):
    names = numeric_columns(df) if columns is None else columns
    if not names:
        return df, _log("Scale Features", "No numeric columns to scale", 0)
    text = f"Scaled {len(names)} features using {method} scaling"
    return cleaning.scale(df, method, names), _log("Scale Features", text, df.count())


STEPS: dict[str, Step] = {
    "impute_missing": impute_missing,
    "remove_outliers": remove_outliers,
    "encode_categorical": encode_categorical,
    "drop_missing": drop_missing,
    "scale_features": scale_features,
}
# The steps of a run without a configuration.
DEFAULT_CONFIG = [
    {"step": "impute_missing", "params": {"strategy": "median"}},
    {"step": "remove_outliers", "params": {"threshold": 0.6}},
]


def run_steps(
    df: DataFrame, config: list[dict] | None = None, extra_steps: dict[str, Step] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cleaned data and the step log.

    An unknown step is an error before anything runs. A step that fails while it is set up or
    gathers its statistics is logged as failed and skipped. ``extra_steps`` adds named
    callables of the same form.
    """
    registry = {**STEPS, **(extra_steps or {})}
    plan = [(c["step"], c.get("params", {})) for c in (DEFAULT_CONFIG if config is None else config) if c.get("step")]
    for name, _ in plan:
        if name not in registry:
            raise ValueError(f"Unknown pipeline step: {name}")
    spark = df.sparkSession
    df = normalize_missing(df)
    logs = []
    for name, params in plan:
        try:
            df, log = registry[name](df, **params)
        except (PySparkException, ValueError, TypeError, KeyError) as e:
            log = _log(name, f"FAILED: {e}", 0)
        logs.append(log)
    rows = [(i, g["step_name"], g["transformation_applied"], g["rows_affected"]) for i, g in enumerate(logs)]
    return df, spark.createDataFrame(rows, LOG_SCHEMA)
