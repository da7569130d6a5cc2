"""The user-level functions end to end."""

import pytest

from catalog import fixtures as fx
from tablewarden import api
from tablewarden.operators.governance import GovernanceRejected
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return fx.docs_labeled(spark, SMALL).drop("text")


def test_profile_and_dictionary(spark):
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    found = api.profile_dataset(df)
    assert found["total_rows"] == 1000 and found["total_columns"] == 6
    assert "event_type" in [r["column"] for r in found["ranked_candidates"].collect()]
    rows = {r["column"]: r for r in api.data_dictionary(df).collect()}
    assert rows["event_id"]["outlier_percentage"] is None and rows["value"]["outlier_percentage"] is not None


def test_eda_feeds_drift(spark):
    reference, current = fx.events_shift(spark, SMALL)
    stored = api.eda(reference)["distributions"]
    drifted = api.detect_drift(current, stored)
    assert api.drift_detected(drifted) and not api.drift_detected(api.detect_drift(reference, stored))


def test_checks(docs):
    found = api.run_checks(docs, "quality", [{"column": "n_chars", "type": "min", "value": 100}], exclude=["doc_id"])
    rows = found["remediations"].collect()
    assert len(rows) == found["issues"].count() > 0
    rule = next(r for r in rows if r["type"] == "custom_rule_violation")
    assert rule["severity"] == "HIGH" and rule["impact"] >= 8
    assert rows[0]["total_impact"] == pytest.approx(sum(max(r["impact"], 0) for r in rows), abs=0.01)


def test_governance_run_writes_tables(spark, docs, tmp_path):
    leaky = docs.withColumn("copy", docs["quality"] * 2)
    tables = api.run_governance(leaky, "quality", row_key="doc_id", evaluate=False, output_path=str(tmp_path), run_id="r1")
    assert "doc_id" in tables["outliers"].columns
    row = tables["governance"].first()
    assert row["recommended_status"] == "REJECTED" and row["worst_category"] == "CONFIRMED_LEAKAGE"
    assert api.read_results(spark, str(tmp_path), "governance", "r1").count() == 1
    assert "data_leakage" in [r["type"] for r in tables["issues"].collect()]
    assert "LEAKAGE_CONFIRMED" in [r["rule"] for r in tables["audit_log"].collect()]
    assert tables["column_profile"].count() == len(leaky.columns)
    with pytest.raises(ValueError, match="not found"):
        api.run_governance(docs, "nothing")


def test_gate(docs):
    with pytest.raises(GovernanceRejected):
        api.assert_ready(docs.withColumn("copy", docs["quality"] * 2), "quality", evaluate=False)


def test_full_analysis(spark):
    reference, current = fx.events_shift(spark, SMALL)
    tables = api.full_analysis(current, "value", reference, row_key="event_id")
    assert tables["drift"].where("column = 'value'").first()["drift_detected"]
    assert tables["pipeline_log"].first()["step_name"] == "Impute Missing Values"
    assert tables["outlier_summary"].first()["total_outliers"] >= tables["outliers"].count() > 0
