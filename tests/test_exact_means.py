import pytest

from catalog import governance_queries, leakage_queries

# Sums of doubles give 0.6000000000000001 in this order and 0.6 in the other one.
RISING = [0.1, 0.2, 0.3]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Lines whose means are equal on both sides, for a part of each problem type."""
    folder = str(tmp_path_factory.mktemp("tied"))
    rows = [
        (part, 1, 1, status, d, 0.04, 25.0)
        for part in (2, 3)
        for status, values in (("O", RISING if part == 3 else RISING[::-1]), ("F", RISING[::-1] if part == 3 else RISING))
        for d in values
    ]
    # Mean 0.0371875, which is 0.74375 when taken 20 times.
    rows += [(5, 1, k + 1, "O", 0.02 if k else 0.57, 0.04, 25.0) for k in range(32)]
    schema = "l_partkey long, l_orderkey long, l_linenumber int, l_linestatus string, l_discount double, l_tax double, l_quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_equal_means_are_no_improvement(spark, tied):
    found = {r["l_partkey"]: r["confidence"] for r in governance_queries.confidence(spark, tied).collect()}
    assert found[2] == "LOW" and found[3] == "LOW"


def test_equal_means_are_not_accepted(spark, tied):
    found = {r["l_partkey"]: r["verdict"] for r in governance_queries.acceptance(spark, tied).collect()}
    assert found[2] == "REJECTED" and found[3] == "REJECTED"


def test_equal_means_have_no_impact(spark, tied):
    found = {r["l_partkey"]: tuple(r)[1:] for r in governance_queries.remediation_impact(spark, tied).collect()}
    assert found[2] == found[3] == (0.0, 30)


def test_scores_round_the_exact_mean(spark, tied):
    found = {r["l_partkey"]: r["raw_score"] for r in leakage_queries.leak_score(spark, tied).collect()}
    assert found[5] == 14.88
