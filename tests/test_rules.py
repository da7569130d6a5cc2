import itertools

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import governance, leakage

FIELDS = (
    "stability double, missingness double, row_count bigint, feature_count int, critical_issues bigint,"
    " high_issues bigint, medium_issues bigint, outlier_percentage double, worst_category string"
)
EDGE = 1e-6


def expected(st, m, rows, feats, crit, high, med, o, worst):
    """Plain restatement of the scoring table."""
    worst = worst or ""
    m0 = m or 0.0
    g = 78.0
    s = min(max(82.0 if st is None else st, 45.0), 94.0)
    c = 100.0
    if m0 < 0.01:
        g, s = g + 6, s + 4
    elif m0 < 0.05:
        g, s = g + 3, s + 2
    g += 3 if rows > 1000 else 2 if rows > 300 else 0
    g += 2 if feats >= 5 else 0
    if m0 > 0.10:
        g, s, c = g - 40 * m0, s - 45 * m0, c - 60 * m0
    elif m0 > 0.05:
        g, s = g - 20 * m0, s - 25 * m0
    g, s, c = g - 20 * crit - 6 * high - 1.5 * med, s - 16 * crit - 4 * high - med, c - 25 * crit - 8 * high - 2 * med
    if not crit and not high and not m0 > 0.10:
        g, s = g + 4, s + 2
    if o > 15:
        g, s, c = g - o, s - 1.5 * o, c - 14
    elif o > 5:
        g, s, c = g - 0.35 * o, s - 0.7 * o, c - 4
    for name, (dg, ds) in {"STRONG_PREDICTOR": (1, 1), "HIGH_RISK_PROXY": (12, 8), "CONFIRMED_LEAKAGE": (35, 25)}.items():
        if worst == name:
            g, s = g - dg, s - ds
    g, s, c = min(max(g, 5), 98), min(max(s, 5), 95), min(max(c, 5), 99)
    g1, s1 = round(g, 1), round(s, 1)
    confirmed = worst == "CONFIRMED_LEAKAGE"
    if g1 >= 80 and s1 >= 72 and not crit and not confirmed:
        status = "APPROVED"
    elif g1 < 45 or s1 < 40 or confirmed:
        status = "REJECTED"
    else:
        status = "AWAITING_REVIEW"
    return g, s, c, status


def test_governance_grid(spark):
    grid = list(
        itertools.product(
            [None, 40.0, 70.0, 99.0],
            [0.0, 0.01 - EDGE, 0.01 + EDGE, 0.05 + EDGE, 0.10 + EDGE, 0.4],
            [300, 1001],
            [4, 5],
            [0, 1],
            [0, 2],
            [1],
            [0.0, 5 + EDGE, 15 + EDGE],
            [None, "STRONG_PREDICTOR", "HIGH_RISK_PROXY", "CONFIRMED_LEAKAGE"],
        )
    )
    decided = governance.decide(spark.createDataFrame(grid, FIELDS)).collect()
    assert len(decided) == len(grid)
    for r in decided:
        row = tuple(r[f] for f in FIELDS.replace(",", "").split()[::2])
        g, s, c, status = expected(*row)
        assert r["governance_score"] == pytest.approx(g, abs=0.0501)
        assert r["stability_score"] == pytest.approx(s, abs=0.0501)
        assert r["confidence_score"] == pytest.approx(c, abs=0.0501)
        if min(abs(g - 80), abs(g - 45), abs(s - 72), abs(s - 40)) > 0.1:
            assert r["recommended_status"] == status
        assert r["deployment_ready"] == (r["recommended_status"] == "APPROVED")


def test_audit_log_and_gate(spark):
    rows = [(50.0, 0.2, 10, 3, 1, 1, 0, 20.0, "CONFIRMED_LEAKAGE")]
    metrics = spark.createDataFrame(rows, FIELDS).select(
        F.lit("r1").alias("run"), "*",
        F.array(F.struct(F.lit("id").alias("column"), F.lit("IDENTIFIER_COLUMN_DETECTED").alias("class"))).alias("identifiers"),
        F.array(
            F.struct(F.lit("pii_detected").alias("type"), F.lit("HIGH").alias("severity"), F.lit("found").alias("description")),
            F.struct(F.lit("x").alias("type"), F.lit("LOW").alias("severity"), F.lit("no").alias("description")),
        ).alias("issues"),
        F.array(
            *[F.struct(F.lit(f).alias("feature"), F.lit("CONFIRMED_LEAKAGE").alias("category"), F.lit(85.8).alias("leakage_score")) for f in "abcd"]
        ).alias("leakage"),
    )
    decided = governance.decide(metrics)
    log = governance.audit_log(decided, ["run"], leak_events_each=3).orderBy("position").collect()
    assert governance.audit_log(decided, ["run"]).where("rule = 'LEAKAGE_CONFIRMED'").count() == 4
    rules = [r["rule"] for r in log]
    assert rules == [
        "IDENTIFIER_COLUMN_DETECTED", "DATASET_REGISTERED", "VALIDATION_STARTED", "HIGH_MISSINGNESS", "PII_DETECTED",
        "BENCHMARK_COMPLETED", "SEVERE_OUTLIER_CONTAMINATION", "LEAKAGE_CONFIRMED", "LEAKAGE_CONFIRMED",
        "LEAKAGE_CONFIRMED", "DEPLOYMENT_BLOCKED", "RETRAINING_RECOMMENDED",
    ]
    assert log[7]["message"] == "Feature 'a' classified as CONFIRMED_LEAKAGE (confidence: 85.8%)."
    with pytest.raises(governance.GovernanceRejected, match="Potential leakage"):
        governance.gate(decided)
    fine = spark.createDataFrame([(90.0, 0.0, 2000, 6, 0, 0, 0, 0.0, None)], FIELDS)
    assert governance.gate(governance.decide(fine))


def test_leakage_grid(spark):
    fields = ["correlation", "mutual_information", "predictive_power", "permutation_importance", "ablation_impact"]
    grid = list(
        itertools.product(
            [0.8, 0.8 + EDGE, 0.95 - EDGE, 0.95], [0.0, 1.0, 3.0], [0.75, 0.75 + EDGE, 0.9 + EDGE, 0.99],
            [0.30, 0.30 + EDGE], [0.10, 0.10 + EDGE],
        )
    )
    scored = leakage.score_signals(spark.createDataFrame([tuple(map(float, g)) for g in grid], fields)).collect()
    for r in scored:
        corr, mi, power, perm, abl = (r[f] for f in fields)
        raw = (60 if corr >= 0.95 else 20 if corr > 0.8 else 0) + (40 if power >= 0.99 else 15 if power > 0.9 else 0)
        raw += min(10 * mi, 20)
        strong = (power > 0.75 or perm > 0.30 or abl > 0.10) and corr < 0.95
        want = (
            "CONFIRMED_LEAKAGE" if corr >= 0.95 or raw >= 85
            else "HIGH_RISK_PROXY" if raw >= 60 and not strong
            else "STRONG_PREDICTOR" if strong else "NORMAL_FEATURE"
        )
        assert r["category"] == want and r["raw_score"] == pytest.approx(raw, abs=0.01)


def test_acceptance_texts(spark):
    rows = [("classification", 0.8, 0.7, 90.0, 70.0), ("regression", 5.0, 4.0, 90.0, 85.0), ("regression", 5.0, 6.0, 80.0, 88.0)]
    pairs = spark.createDataFrame(
        [(p, a, b, a, b, s, t) for p, a, b, s, t in rows],
        "problem_type string, base_accuracy double, cand_accuracy double, base_rmse double, cand_rmse double,"
        " base_stability_score double, cand_stability_score double",
    )
    got = governance.with_acceptance(governance.with_confidence(governance.metric_deltas(pairs))).collect()
    assert [r["verdict"] for r in got] == ["REJECTED", "UNCERTAIN", "UNCERTAIN"]
    assert got[0]["explanation"] == (
        "Remediation caused severe stability degradation (-20.0 points). Automatic fix rejected."
    )
    assert got[1]["explanation"] == (
        "Inconclusive outcomes: Rmse changed by -1.00 but stability shifted by -5.0. Manual review recommended."
    )
