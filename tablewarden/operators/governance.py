"""Rule tables: metric deltas, confidence, acceptance, the governance decision and its audit log.

Every rule is an expression over a metrics table with one row per dataset, batch or segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.stats import clamp

CLASSIFICATION = "classification"
METRICS = ["accuracy", "log_loss", "rmse", "r2", "mae", "stability_score", "missingness_ratio"]


class GovernanceRejected(RuntimeError):
    """Raised by the deployment gate."""


def stability_score(variation: Column, missingness: Column, duplicates: Column) -> Column:
    """100 less penalties for score variation, missing cells and duplicate rows, in 0..100."""
    return clamp(100 - variation * 200 - missingness * 150 - duplicates * 100, 0.0, 100.0)


def metric_deltas(pairs: DataFrame) -> DataFrame:
    """Add candidate minus baseline for each metric of the problem type.

    Expects ``problem_type`` and ``base_<metric>`` / ``cand_<metric>``; optional
    ``base_error`` / ``cand_error`` turn all deltas to NULL and set ``error``.
    """
    have = set(pairs.columns)
    failed = F.lit(False)
    for name in ("base_error", "cand_error"):
        if name in have:
            failed = failed | F.col(name).isNotNull()
    is_class = F.col("problem_type") == CLASSIFICATION
    shown = {
        "accuracy": is_class, "log_loss": is_class, "rmse": ~is_class, "r2": ~is_class, "mae": ~is_class,
        "stability_score": F.lit(True), "missingness_ratio": F.lit(True),
    }
    deltas = []
    for m, when in shown.items():
        def side(prefix: str, m: str = m) -> Column:
            return F.coalesce(F.col(f"{prefix}_{m}"), F.lit(0)) if f"{prefix}_{m}" in have else F.lit(0.0)

        name = {"stability_score": "stability", "missingness_ratio": "missingness"}.get(m, m)
        deltas.append(F.when(when & ~failed, side("cand") - side("base")).alias(f"{name}_delta"))
    error = F.when(failed, "Invalid metrics for delta calculation").alias("error")
    return pairs.select("*", *deltas, error)


def _delta(name: str) -> Column:
    """A delta, decimal if its metrics are: then no rounding decides a rule."""
    return F.coalesce(f"{name}_delta", F.lit(0))


def with_confidence(deltas: DataFrame) -> DataFrame:
    """Add ``confidence`` (HIGH, MODERATE, LOW) from how far the metrics agree."""
    stability = _delta("stability")
    is_class = F.col("problem_type") == CLASSIFICATION
    clear = F.when(
        is_class, (_delta("accuracy") > 0.01) & (_delta("log_loss") < -0.01)
    ).otherwise((_delta("rmse") < -0.01) & (_delta("r2") > 0.01))
    some = F.when(is_class, _delta("accuracy") > 0).otherwise((_delta("rmse") < 0) | (_delta("r2") > 0))
    return deltas.withColumn(
        "confidence",
        F.when(clear & (stability >= 0), "HIGH").when(some & (stability > -5), "MODERATE").otherwise("LOW"),
    )


def confidence_points(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 90).when(confidence == "MODERATE", 60).otherwise(30)


def with_acceptance(judged: DataFrame) -> DataFrame:
    """Add ``verdict`` and ``explanation`` of a fix from its deltas and confidence."""
    stability = _delta("stability")
    is_class = F.col("problem_type") == CLASSIFICATION
    improved = F.when(is_class, _delta("accuracy") > 0).otherwise(_delta("rmse") < 0)
    gained = F.when(_delta("accuracy") > 0, "+").otherwise("")
    change = F.when(
        is_class, F.concat(gained, F.format_string("%.2f", _delta("accuracy").cast("double") * 100), F.lit("%"))
    ).otherwise(F.format_string("%.2f", _delta("rmse").cast("double")))
    metric = F.when(is_class, "accuracy").otherwise("RMSE")
    title = F.when(is_class, "Accuracy").otherwise("Rmse")
    shift = F.format_string("%.1f", stability.cast("double"))
    severe = stability < -10
    agreed = improved & (stability >= -2) & F.col("confidence").isin("HIGH", "MODERATE")
    mixed = (improved & (stability < -2)) | (~improved & (stability > 5))
    # The explanation texts.
    explanation = (
        F.when(
            severe,
            F.concat(
                F.lit("Remediation caused severe stability degradation ("), shift,
                F.lit(" points). Automatic fix rejected."),
            ),
        )
        .when(
            agreed,
            F.concat(
                F.lit("Remediation validated. "), title, F.lit(" improved by "), change,
                F.lit(" and stability score changed by "), shift, F.lit(" points. Fix approved."),
            ),
        )
        .when(
            mixed,
            F.concat(
                F.lit("Inconclusive outcomes: "), title, F.lit(" changed by "), change,
                F.lit(" but stability shifted by "), shift, F.lit(". Manual review recommended."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Remediation did not produce measurable improvement ("), metric, F.lit(" delta: "), change,
                F.lit(", Stability delta: "), shift, F.lit(")."),
            )
        )
    )
    verdict = (
        F.when(severe, "REJECTED").when(agreed, "ACCEPTED").when(mixed, "UNCERTAIN").otherwise("REJECTED")
    )
    return judged.withColumn("verdict", verdict).withColumn("explanation", explanation)


def with_impact(judged: DataFrame) -> DataFrame:
    """Add ``impact`` in percent, the scores before and after, and the metric's name."""
    is_class = F.col("problem_type") == CLASSIFICATION
    base_rmse, gain, change = F.col("base_rmse").cast("double"), _delta("accuracy").cast("double"), _delta("rmse").cast("double")
    loss = F.when(base_rmse != 0, -change / base_rmse * 100).otherwise(-change)
    return (
        judged.withColumn("impact", F.when(is_class, gain * 100).otherwise(loss))
        .withColumn("baseline_score", F.when(is_class, F.col("base_accuracy") * 100).otherwise(base_rmse))
        .withColumn("after_score", F.when(is_class, F.col("cand_accuracy") * 100).otherwise(F.col("cand_rmse")))
        .withColumn("metric", F.when(is_class, "Accuracy").otherwise("RMSE"))
    )


def _penalty(*steps: tuple[Column, Column | float]) -> Column:
    chain = None
    for test, value in steps:
        value = value if isinstance(value, Column) else F.lit(float(value))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(F.lit(0.0))


def decide(metrics: DataFrame) -> DataFrame:
    """Add the governance decision to a metrics table.

    Expects ``stability`` and ``missingness`` (NULL without a baseline), ``row_count``,
    ``feature_count``, ``critical_issues``, ``high_issues``, ``medium_issues``,
    ``outlier_percentage`` and ``worst_category``.
    """
    m = F.coalesce("missingness", F.lit(0.0))
    o = F.coalesce("outlier_percentage", F.lit(0.0))
    critical, high, medium = (F.col(f"{k}_issues").cast("double") for k in ("critical", "high", "medium"))
    worst = F.coalesce("worst_category", F.lit(""))
    confirmed = worst == "CONFIRMED_LEAKAGE"
    proxy, strong = worst == "HIGH_RISK_PROXY", worst == "STRONG_PREDICTOR"
    passed = (critical == 0) & (high == 0) & ~(m > 0.10)
    governance = (
        F.lit(78.0)
        + _penalty((m < 0.01, 6), (m < 0.05, 3))
        + _penalty((F.col("row_count") > 1000, 3), (F.col("row_count") > 300, 2))
        + _penalty((F.col("feature_count") >= 5, 2))
        - _penalty((m > 0.10, m * 40), (m > 0.05, m * 20))
        - (critical * 20 + high * 6 + medium * 1.5)
        + _penalty((passed, 4))
        - _penalty((o > 15, o), (o > 5, o * 0.35))
        - _penalty((strong, 1), (proxy, 12), (confirmed, 35))
    )
    stability = (
        clamp(F.coalesce("stability", F.lit(82.0)), 45.0, 94.0)
        + _penalty((m < 0.01, 4), (m < 0.05, 2))
        - _penalty((m > 0.10, m * 45), (m > 0.05, m * 25))
        - (critical * 16 + high * 4 + medium)
        + _penalty((passed, 2))
        - _penalty((o > 15, o * 1.5), (o > 5, o * 0.7))
        - _penalty((strong, 1), (proxy, 8), (confirmed, 25))
    )
    confidence = (
        F.lit(100.0)
        - _penalty((m > 0.10, m * 60))
        - (critical * 25 + high * 8 + medium * 2)
        - _penalty((o > 15, 14), (o > 5, 4))
    )
    scored = metrics.select(
        "*",
        F.round(clamp(governance, 5.0, 98.0), 1).alias("governance_score"),
        F.round(clamp(stability, 5.0, 95.0), 1).alias("stability_score"),
        F.round(clamp(confidence, 5.0, 99.0), 1).alias("confidence_score"),
        F.when(critical > 0, "VALIDATION_FAILED")
        .when(passed, "VALIDATION_PASSED")
        .otherwise("VALIDATION_WARNING")
        .alias("validation_status"),
    )
    g, s, c = F.col("governance_score"), F.col("stability_score"), F.col("confidence_score")
    blocked = (critical > 0) | confirmed
    leaking = proxy | confirmed
    fit = (g >= 80) & (s >= 72) & ~blocked
    reason = (
        F.when(leaking, "Potential leakage or instability detected.")
        .when(o > 10, F.concat(F.lit("Elevated outlier contamination ("), F.format_string("%.1f", o), F.lit("%).")))
        .otherwise("Minor structural observations detected.")
    )
    return scored.select(
        "*",
        F.when(fit, "APPROVED")
        .when((g < 45) | (s < 40) | confirmed, "REJECTED")
        .otherwise("AWAITING_REVIEW")
        .alias("recommended_status"),
        fit.alias("deployment_ready"),
        ((s < 60) | leaking | (o > 15)).alias("retraining_required"),
        reason.alias("retraining_reason"),
        F.when(c >= 85, "HIGH").when(c >= 60, "MODERATE").otherwise("LOW").alias("confidence_label"),
    )


VALIDATION, ANALYSIS, DECISION = "VALIDATION PHASE", "ANALYSIS PHASE", "GOVERNANCE PHASE"
EVENT = "struct<phase:string,rule:string,severity:string,message:string>"


def _event(phase: str, rule, severity: str, *message) -> Column:
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    pieces = [p if isinstance(p, Column) else F.lit(p) for p in message]
    return F.struct(
        F.lit(phase).alias("phase"), rule.alias("rule"), F.lit(severity).alias("severity"),
        F.concat(*pieces).alias("message"),
    )


def _events(source: str, have: set[str], make, wanted=None, at_most: int | None = None) -> Column:
    """One event per entry of an array column, or none if the table has no such column."""
    if source not in have:
        return F.array().cast(f"array<{EVENT}>")
    entries = F.filter(source, wanted) if wanted is not None else F.col(source)
    if at_most is not None:
        entries = F.slice(entries, 1, at_most)
    return F.coalesce(F.transform(entries, make), F.array().cast(f"array<{EVENT}>"))


def audit_log(decided: DataFrame, keys: list[str], leak_events_each: int | None = None) -> DataFrame:
    """``*keys, position, phase, rule, severity, message``: one row per triggered rule.

    Works on the output of ``decide``. Optional array columns add their events:
    ``identifiers`` (column, class), ``issues`` (type, severity, description) and
    ``leakage`` (feature, category, leakage_score), of which ``leak_events_each`` keeps the first of each category.
    """
    have = set(decided.columns)
    m = F.coalesce("missingness", F.lit(0.0))
    o = F.coalesce("outlier_percentage", F.lit(0.0))
    worst = F.coalesce("worst_category", F.lit(""))
    share = F.format_string("%.1f", o)
    g, s = F.col("governance_score").cast("string"), F.col("stability_score").cast("string")
    status = F.col("recommended_status")

    # Rules, severities and message texts.
    identifier_texts = {
        "IDENTIFIER_COLUMN_DETECTED": "' classified as Sequential Identifier. Excluded from governance evaluation.",
        "POTENTIAL_IDENTIFIER": (
            "' classified as Potential Identifier due to name and high cardinality."
            " Excluded from governance evaluation."
        ),
        "HIGH_CARDINALITY_TEXT": "' contains highly unique text values. Excluded from identifier classification.",
    }
    def of_kind(field: str, kind: str):
        return lambda entry: entry[field] == kind

    def identifier_event(kind: str, text: str):
        return lambda entry: _event(VALIDATION, kind, "INFO", "Column '", entry["column"], text)

    identifier_events = [
        _events("identifiers", have, identifier_event(kind, text), of_kind("class", kind))
        for kind, text in identifier_texts.items()
    ]
    issue_events = [
        _events(
            "issues", have,
            lambda i: F.when(
                i["severity"] == "CRITICAL",
                _event(VALIDATION, "CRITICAL_VULNERABILITY", "CRITICAL",
                       "Critical structural issue detected: ", i["description"]),
            ).otherwise(
                _event(VALIDATION, F.upper(i["type"]), "HIGH", "Elevated risk observation: ", i["description"])
            ),
            lambda i: i["severity"].isin("CRITICAL", "HIGH"),
        )
    ]
    leak_texts = {
        "STRONG_PREDICTOR": ("STRONG_PREDICTOR", "INFO"),
        "HIGH_RISK_PROXY": ("HIGH_RISK_PROXY", "WARNING"),
        "CONFIRMED_LEAKAGE": ("LEAKAGE_CONFIRMED", "CRITICAL"),
    }

    def leak_event(category: str, rule: str, severity: str):
        def make(entry):
            tail = (
                [". High model dependence observed. No direct leakage evidence detected."]
                if category == "STRONG_PREDICTOR"
                else [" (confidence: ", entry["leakage_score"].cast("string"), "%)."]
            )
            head = ["Feature '", entry["feature"], f"' classified as {category}"]
            return _event(ANALYSIS, rule, severity, *head, *tail)

        return make

    leak_events = []
    for category, (rule, severity) in leak_texts.items():
        found = _events(
            "leakage", have, leak_event(category, rule, severity), of_kind("category", category),
            leak_events_each,
        )
        leak_events.append(F.when(worst == category, found).otherwise(F.array().cast(f"array<{EVENT}>")))
    clean_leak = ~worst.isin(*leak_texts)

    def single(test: Column | None, event: Column) -> Column:
        return F.array(event) if test is None else F.when(test, F.array(event)).otherwise(F.array().cast(f"array<{EVENT}>"))

    scores = ["Governance Score: ", g, "/100\n", "Stability Score: ", s, "/100\n\n"]
    parts = [
        *identifier_events,
        single(None, _event(VALIDATION, "DATASET_REGISTERED", "INFO",
                            "Dataset registered with ", F.col("row_count").cast("string"), " rows.")),
        single(None, _event(VALIDATION, "VALIDATION_STARTED", "INFO",
                            "Validation engines scanning ", F.col("feature_count").cast("string"), " features.")),
        single(m > 0.10, _event(VALIDATION, "HIGH_MISSINGNESS", "WARNING",
                                "Dataset contains ", F.format_string("%.1f", m * 100), "% missing values.")),
        *issue_events,
        single(F.col("validation_status") == "VALIDATION_PASSED",
               _event(VALIDATION, "VALIDATION_PASSED", "SUCCESS",
                      "Dataset passed foundational structural validation.")),
        single(None, _event(ANALYSIS, "BENCHMARK_COMPLETED", "INFO",
                            "Baseline benchmarking and anomaly arbitration completed.")),
        single(o > 15, _event(ANALYSIS, "SEVERE_OUTLIER_CONTAMINATION", "CRITICAL",
                              share, "% anomalous rows detected.")),
        single((o > 5) & (o <= 15), _event(ANALYSIS, "MODERATE_OUTLIER_CONTAMINATION", "WARNING",
                                           "Moderate anomaly contamination observed (", share, "%).")),
        *leak_events,
        single(clean_leak, _event(ANALYSIS, "LEAKAGE_VALIDATION_PASSED", "SUCCESS",
                                  "No actionable leakage consensus detected.")),
        single(status == "APPROVED",
               _event(DECISION, "GOVERNANCE_APPROVED", "SUCCESS",
                      "**Governance Approved**\n\n- Structural integrity remained stable.\n"
                      "- No catastrophic leakage detected.\n- Stability exceeded deployment threshold.\n\n"
                      "**Confidence level:** ", F.col("confidence_label"), ".")),
        single(status == "AWAITING_REVIEW",
               _event(DECISION, "GOVERNANCE_REVIEW_STARTED", "WARNING",
                      "**Manual Governance Review Required**\n\n", *scores,
                      "Moderate structural concerns require human review.")),
        single(status == "REJECTED",
               _event(DECISION, "DEPLOYMENT_BLOCKED", "CRITICAL",
                      "**Deployment Blocked**\n\n", *scores, "Critical structural risk detected.")),
        single(F.col("retraining_required"),
               _event(DECISION, "RETRAINING_RECOMMENDED", "HIGH",
                      "**Retraining Recommended**\n\nInstability patterns weaken production reliability.")),
    ]
    return decided.select(*keys, F.posexplode(F.concat(*parts)).alias("position", "event")).select(
        *keys, "position", "event.phase", "event.rule", "event.severity", "event.message"
    )


def gate(decided: DataFrame) -> bool:
    """True, or an error naming the reason if any row of the decision table is rejected."""
    rejected = decided.where(F.col("recommended_status") == "REJECTED").select("retraining_reason").first()
    if rejected is not None:
        raise GovernanceRejected(
            f"Governance Check Failed: {rejected['retraining_reason']} (Status: REJECTED)"
        )
    return True
