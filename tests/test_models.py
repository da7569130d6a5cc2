import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import importance, impact, leakage, models, shap


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 1200
    pdf = pd.DataFrame({"driver": rng.normal(size=n), "side": rng.normal(size=n), "noise": rng.normal(size=n)})
    pdf["y"] = 3 * pdf["driver"] + pdf["side"] + rng.normal(size=n) * 0.1
    pdf["c"] = np.where(pdf["driver"] > 0, "high", "low")
    return spark.createDataFrame(pdf)


def test_shap_adds_up(spark, planted):
    df = planted.drop("c")
    explained, names, base = shap.shap_values(df, "y")
    worst = explained.select(
        F.max(F.abs(F.aggregate("shap", F.lit(base), lambda a, v: a + v) - F.col("prediction")))
    ).first()[0]
    assert worst < 1e-6
    means = [explained.select(F.avg(F.abs(F.get("shap", F.lit(i))))).first()[0] for i in range(3)]
    assert names[int(np.argmax(means))] == "driver"


def test_shap_adds_up_for_classes(planted):
    explained, _, base = shap.shap_values(planted.select("driver", "side", "noise", "c"), "c")
    total = F.aggregate("shap", F.lit(base), lambda a, v: a + v)
    assert explained.select(F.max(F.abs(total - F.get("probability", F.lit(1))))).first()[0] < 1e-6


def subset_values(tree, row, features):
    """SHAP values by their definition: every set of known features, a walk over both sides where one is unknown."""

    def worth(known, node=0):
        if tree.left[node] == node:
            return tree.value[node, 0]
        f, sides = tree.feature[node], (tree.left[node], tree.right[node])
        if f in known:
            return worth(known, sides[0 if row[f] <= tree.threshold[node] else 1])
        return sum(tree.cover[s] / tree.cover[node] * worth(known, s) for s in sides)

    found = []
    for i in range(features):
        rest = [k for k in range(features) if k != i]
        found.append(sum(
            math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features)
            * (worth({*s, i}) - worth(set(s)))
            for r in range(features) for s in itertools.combinations(rest, r)
        ))
    return found


def grown_tree(rng, features, splits):
    """A random tree whose features repeat along its paths."""
    feature, threshold, left, right, value, cover = ([0], [0.0], [0], [0], [rng.normal()], [1000.0])
    for _ in range(splits):
        node = rng.choice([i for i in range(len(left)) if left[i] == i])
        share = rng.uniform(0.05, 0.95)
        feature[node], threshold[node] = int(rng.integers(features)), rng.normal()
        left[node], right[node] = len(left), len(left) + 1
        for part in (share, 1 - share):
            feature.append(0)
            threshold.append(0.0)
            left.append(len(left))
            right.append(len(right))
            value.append(rng.normal())
            cover.append(cover[node] * part)
    depth = [0] * len(left)
    for i in range(len(left)):
        if left[i] != i:
            depth[left[i]] = depth[right[i]] = depth[i] + 1
    return models.Tree(
        np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)[:, None],
        np.array(cover), max(depth),
    )


@pytest.mark.parametrize("splits", [0, 1, 2, 5, 12, 40])
def test_tree_values_equal_subset_enumeration(splits):
    rng = np.random.default_rng(splits)
    tree = grown_tree(rng, 4, splits)
    rows = rng.normal(size=(25, 4))
    found = shap.tree_shap(shap.tree_paths(tree), rows.T, 0).T
    assert np.allclose(found, [subset_values(tree, row, 4) for row in rows], atol=1e-10)


def test_deep_tree_values_add_up():
    rng = np.random.default_rng(3)
    tree = grown_tree(rng, 30, 400)
    rows = rng.normal(size=(50, 30))
    found = shap.tree_shap(shap.tree_paths(tree), rows.T, 0).T
    assert tree.levels > 12
    assert np.allclose(found.sum(axis=1) + shap.expected_value([tree], 0), models.predict_rows([tree], rows)[:, 0], atol=1e-9)


def test_depth_is_a_parameter(planted):
    explained, _, base = shap.shap_values(planted.drop("c"), "y", depth=11, trees=4)
    total = F.aggregate("shap", F.lit(base), lambda a, v: a + v)
    assert explained.select(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-6


def test_tree_arrays_predict_like_the_model(spark, planted):
    for target, features in (("y", ["driver", "side"]), ("c", ["driver", "side"])):
        ready = models.assemble(planted, target, features)
        model = models.forest(ready.problem, 5).fit(ready.data)
        trees = models.tree_arrays(model, spark, ready.problem == "classification")
        got = model.transform(ready.data).toPandas()
        mine = models.predict_rows(trees, np.stack([v.toArray() for v in got["features"]]))
        mine = mine.argmax(axis=1) if ready.problem == "classification" else mine[:, 0]
        assert np.allclose(mine, got["prediction"])


def test_partial_dependence_matches_brute_force(spark, planted):
    ready = models.assemble(planted, "y", ["driver", "side", "noise"])
    model = models.forest(ready.problem, 5).fit(ready.data)
    rows = np.stack([r[0].toArray() for r in ready.data.select("features").collect()])
    trees = models.tree_arrays(model, spark, False)
    grid = [-1.5, 0.0, 0.7]
    _, curve = importance.partial_dependence(ready, model, {c: grid for c in ready.features})["driver"]
    for g, v in zip(grid, curve):
        fixed = rows.copy()
        fixed[:, 0] = g
        assert v == pytest.approx(models.predict_rows(trees, fixed)[:, 0].mean(), abs=1e-9)


def test_planted_feature_ranks_first(spark, planted):
    impact_table, base = importance.feature_impact(planted.drop("c"), "y")
    rows = impact_table.collect()
    assert rows[0]["feature"] == "driver" and base > 0.5
    assert rows[0]["performance_impact"] > 0.1 and len(rows[0]["pdp_x"]) == 100
    text = importance.impact_insights(impact_table, F.lit(base)).first()["insight"]
    assert text.startswith("**What happened:** 'driver' is structurally critical")
    assert models.feature_importance(planted.drop("c"), "y").first()["feature"] == "driver"
    report = {r["feature"]: r for r in leakage.detect_leakage(planted.drop("c"), "y", "regression", impact_table).collect()}
    assert report["driver"]["permutation_importance"] > 0.3
    assert report["driver"]["category"] in ("STRONG_PREDICTOR", "CONFIRMED_LEAKAGE")


def test_text_codes_are_exact_at_any_number_of_levels(spark):
    """12,500 levels and a missing one: codes follow the sorted values, none shared, hot level and all."""
    df = spark.range(25_000).selectExpr(
        "case when id % 5 = 0 then 'hot' when id % 1000 = 1 then null else concat('v', lpad(hex(id * 7919 % 12511), 5, '0')) end as t",
        "cast(id as double) as x",
    )
    ready = models.assemble(df, "x", ["t"], problem="regression")
    levels = sorted({r["t"] or "nan" for r in df.collect()})
    assert len(levels) > models.MAX_CODED_LEVELS * 1.2
    code = {v: float(i) for i, v in enumerate(levels)}
    expected = {r["x"]: code[r["t"] or "nan"] for r in df.collect()}
    found = {r["label"]: r["features"][0] for r in ready.data.select("features", "label").collect()}
    assert found == expected


def test_text_codes_do_not_depend_on_how_they_are_made(planted, monkeypatch):
    text = planted.select(F.concat(F.lit("k"), F.floor(F.col("driver")).cast("string")).alias("t"), "y")
    first = models.assemble(text, "y", ["t"], problem="regression").data
    monkeypatch.setattr(models, "MAX_CODED_LEVELS", 0)
    second = models.assemble(text, "y", ["t"], problem="regression").data
    rows = [sorted((r["label"], r["features"][0]) for r in part.select("features", "label").collect()) for part in (first, second)]
    assert rows[0] == rows[1]


def test_segments(planted):
    rows = shap.segmented_shap(planted.drop("c"), "y").collect()
    for cluster in {r["cluster"] for r in rows}:
        part = sorted((r for r in rows if r["cluster"] == cluster), key=lambda r: r["rank"])
        assert sum(r["importance"] for r in part) == pytest.approx(1)
        assert part[0]["importance"] >= part[1]["importance"]


def test_small_or_useless_input(spark):
    tiny = spark.createDataFrame([(1, 2.0)] * 5, "a int, b double")
    assert models.baseline_metrics(tiny, "b").first()["error"] == models.BASELINE_ERROR
    assert models.baseline_metrics(tiny, "zzz").first()["error"] == "Target column missing"
    assert importance.feature_impact(tiny, "b")[1] is None
    assert shap.segmented_shap(tiny, "b").count() == 0
    ids = spark.range(50).selectExpr("id", "id as user_id", "id % 2 as y")
    with pytest.raises(models.NoUsableFeatures):
        models.train_baseline(ids, "y")


def test_information_bounds(spark):
    df = spark.range(400).selectExpr("id % 4 as x", "cast(id % 4 as string) as y", "1 as one")
    found = {r[0]: r[1] for r in leakage.class_information(df, "y").collect()}
    assert found["x"] == pytest.approx(math.log(4)) and found["one"] == pytest.approx(0)


def test_remediation_verdicts(spark):
    fields = "type string, column string, percentage double, count bigint, pii_type string, ratio string, min_class double, correlated_with array<string>, rule_type string, expected string"
    rows = [("outliers", "a", 5.0, 3), ("pii_detected", "b", 50.0, 3), ("missing_values", "price", 5.0, 3)]
    issues = spark.createDataFrame([(*r, "Email Addresses", None, None, None, None, None) for r in rows], fields)
    pairs = issues.withColumn("problem_type", F.lit("classification"))
    for side, gain in (("base", 0.0), ("cand", 0.05)):
        improved = F.when(F.col("column") == "price", F.lit(gain)).otherwise(F.lit(0.0))
        pairs = (
            pairs.withColumn(f"{side}_accuracy", 0.8 + improved).withColumn(f"{side}_log_loss", 0.5 - improved)
            .withColumn(f"{side}_rmse", F.lit(None).cast("double")).withColumn(f"{side}_r2", F.lit(None).cast("double"))
            .withColumn(f"{side}_mae", F.lit(None).cast("double")).withColumn(f"{side}_stability_score", F.lit(90.0))
            .withColumn(f"{side}_missingness_ratio", F.lit(0.0)).withColumn(f"{side}_error", F.lit(None).cast("string"))
        )
    got = {r["column"]: r for r in impact.judge_remediations(pairs).collect()}
    assert got["a"]["governance_verdict"] == "REJECTED" and got["a"]["severity"] == "LOW"
    assert got["a"]["suggestion"].startswith("REMEDIATION BLOCKED: ")
    assert got["b"]["severity"] == "HIGH" and got["b"]["impact"] == 10.0
    assert got["price"]["governance_verdict"] == "ACCEPTED" and got["price"]["confidence_score"] == 90
    assert got["price"]["impact"] == pytest.approx(5.0)
    assert got["price"]["governance_explanation"] == (
        "Remediation validated. Accuracy improved by +5.00% and stability score changed by 0.0 points. Fix approved."
    )


def test_rows_that_no_split_tells_apart_are_looked_at_once(spark, planted, monkeypatch):
    ready = models.assemble(planted, "y", ["driver", "side", "noise"])
    trees = models.tree_arrays(models.forest(ready.problem, 5).fit(ready.data), spark, False)
    cuts = models.cut_points(trees, 3)
    rows = np.random.default_rng(3).normal(size=(500, 3)).repeat(3, axis=0)
    rows[::7, 1] = cuts[1][0]
    first, kind = models.alike(cuts, rows)
    assert len(first) <= 500 * 2
    assert np.array_equal(models.predict_rows(trees, rows), models.predict_rows(trees, rows[first])[kind])
    batches = [pd.DataFrame({"features": list(part)}) for part in np.array_split(rows, 4)] + [pd.DataFrame({"features": []})]
    for held in (10, 10_000):
        monkeypatch.setattr(importance, "HELD_ROWS", held)
        found = list(importance._kinds(iter(batches), cuts))
        assert sum(times.sum() for _, times in found) == len(rows)
        mean = sum(times @ models.predict_rows(trees, kept)[:, 0] for kept, times in found) / len(rows)
        assert mean == pytest.approx(models.predict_rows(trees, rows)[:, 0].mean())
    assert len(found) == 1 and len(found[0][0]) == len(first)


def test_many_cuts_do_not_overflow_the_code_of_a_kind():
    rows = np.random.default_rng(4).normal(size=(300, 20))
    cuts = [np.linspace(-2, 2, 31)] * 20
    first, kind = models.alike(cuts, np.concatenate([rows, rows]))
    sides = np.stack([np.searchsorted(cuts[0], rows[:, j]) for j in range(20)], axis=1)
    assert len(first) == len(np.unique(sides, axis=0)) and np.array_equal(kind[:300], kind[300:])
