"""Model-based measures: baselines, importances, SHAP segments and remediation impact."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.profile_queries import r6
from catalog.sqltext import ORDER, named, numeric_of, union_all, with_input
from tablewarden.functions.rows import with_partners
from tablewarden.operators import importance, impact, models, shap
from tablewarden.operators.checks import detect_issues


def _kind_sql(k: int) -> str:
    return union_all(
        lambda c: f"select {named(c)}, case when count(distinct {c}) < {k} or {c not in numeric_of('lineitem')}"
        " then 'classification' else 'regression' end as problem_type from lineitem",
        ORDER["lineitem"],
    )


@query("problem_type", _kind_sql(20))
def problem_type(spark, sf_dir):
    return models.problem_types(table(spark, sf_dir, "lineitem"), 20)


@query("problem_type_few", _kind_sql(10))
def problem_type_few(spark, sf_dir):
    return models.problem_types(table(spark, sf_dir, "lineitem"), 10)


def docs(spark, sf_dir):
    return fx.docs_labeled(spark, sf_dir).drop("text")


def planted(spark, sf_dir):
    """Orders with a total price that follows a planted driver column."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_totalprice", "o_totalprice * 0.5 + o_custkey as driver", "o_custkey % 13 as noise",
        "cast(o_orderkey % 7 as double) as weekday", "o_orderpriority",
    )


@query(
    "permutation_partners",
    """select rep as "repeat", count(*) as row_count, count(*) as partners, sum(l_partkey)::bigint as own_sum,
      sum(l_partkey)::bigint as partner_sum, true as mixed
    from lineitem, (select unnest(range(3)) as rep) r group by rep""",
)
def permutation_partners(spark, sf_dir):
    """Partners of the shuffle behind permutation importance: each row once, far from its own place."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    paired = with_partners(rows, 3, models.SEED)
    return paired.groupBy("repeat").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("row").alias("partners"),
        F.sum("own.l_partkey").alias("own_sum"),
        F.sum("partner.l_partkey").alias("partner_sum"),
        (F.abs(F.corr("own.l_partkey", "partner.l_partkey")) < 0.1).alias("mixed"),
    )


@query("baseline_cv")
def baseline_cv(spark, sf_dir):
    return models.baseline_metrics(table(spark, sf_dir, "events").drop("props"), "event_type", row_key="event_id")


@query("baseline_cv_regression")
def baseline_cv_regression(spark, sf_dir):
    return models.baseline_metrics(planted(spark, sf_dir), "o_totalprice")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return models.feature_importance(planted(spark, sf_dir), "o_totalprice")


@query("train_baseline_forest")
def train_baseline_forest(spark, sf_dir):
    _, ready, score = models.train_baseline(planted(spark, sf_dir), "o_totalprice")
    return spark.createDataFrame([(c, float(score)) for c in ready.features], "feature string, score double")


@query("feature_impact")
def feature_impact(spark, sf_dir):
    return importance.feature_impact(planted(spark, sf_dir), "o_totalprice")[0]


@query("feature_impact_class")
def feature_impact_class(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("half", F.col("n_chars") * 0.5 + F.col("toxic"))
    return importance.feature_impact(df, "quality")[0]


@query("ablation")
def ablation(spark, sf_dir):
    ready = models.assemble(planted(spark, sf_dir), "o_totalprice", ["driver", "noise", "weekday"])
    lost, base, _ = importance.ablation(ready, *importance.split_rows(ready))
    return spark.createDataFrame([(c, float(v), base) for c, v in lost.items()], "feature string, drop double, base double")


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    ready = models.assemble(planted(spark, sf_dir), "o_totalprice", ["driver", "noise", "weekday"])
    train, test = importance.split_rows(ready)
    model = models.forest(ready.problem, 50).fit(train)
    found = importance.permutation(ready, model, test)
    return spark.createDataFrame([(c, float(v)) for c, v in found.items()], "feature string, importance double")


@query("partial_dependence")
def partial_dependence(spark, sf_dir):
    df = planted(spark, sf_dir)
    ready = models.assemble(df, "o_totalprice", ["driver", "noise", "weekday"])
    model = models.forest(ready.problem, 50).fit(ready.data)
    curves = importance.partial_dependence(ready, model, importance._grids(df, ready.features))
    rows = [(c, float(a), float(b)) for c, (x, y) in curves.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "feature string, x double, y double")


# Impact rows per part with measures between 0 and about 0.15.
IMPACT_AGGS = ["l_partkey", "avg(l_discount) as d", "avg(l_tax) as x", "count(*) as n"]
IMPACT_LIST = [
    "l_partkey",
    "cast(l_partkey as varchar(20)) as feature",
    "case when n % 3 = 0 then 0.005e0 else round(d, 9) end as importance_score",
    "case when n % 2 = 0 then 0.004e0 else round(x, 9) end as performance_impact",
    "case when n % 4 < 2 then 0.2e0 else 0.01e0 end as marginal_effect_strength",
    "round(x, 9) * 8 as base_score",
]
IMPACT_SQL = fx.sql_from(IMPACT_LIST, f"(select {', '.join(IMPACT_AGGS)} from lineitem group by l_partkey) a")


@query(
    "impact_insight",
    with_input(
        IMPACT_SQL,
        """select l_partkey, round(tanh(performance_impact / greatest(abs(base_score), 0.15)) * 100, 6) as drop_pct,
        case when importance_score > 0.05 and performance_impact < 0.01 then 'redundant'
          when importance_score > 0.05 then 'critical'
          when importance_score < 0.01 and performance_impact < 0.01 and marginal_effect_strength > 0.1 then 'sensitive'
          when importance_score < 0.01 and performance_impact < 0.01 then 'weak' else 'moderate' end as kind from t""",
    ),
)
def impact_insight(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.expr(e) for e in IMPACT_AGGS[1:]])
    found = importance.impact_insights(rows.selectExpr(*IMPACT_LIST), F.col("base_score"), top=None)
    return found.select("l_partkey", r6("drop_pct"), "kind")


@query(
    "curve_strength",
    "select l_returnflag, round(var_pop(y), 6) as strength from (select l_returnflag, l_linenumber,"
    " avg(l_quantity) as y from lineitem group by l_returnflag, l_linenumber) c group by l_returnflag",
)
def curve_strength(spark, sf_dir):
    curve = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("y"))
    return curve.groupBy("l_returnflag").agg(F.round(F.var_pop("y"), 6).alias("strength"))


@query("shap_values")
def shap_values(spark, sf_dir):
    df = planted(spark, sf_dir).drop("o_orderpriority")
    explained, names, base = shap.shap_values(df, "o_totalprice")
    return explained.select(
        *[F.get("shap", F.lit(i)).alias(c) for i, c in enumerate(names)], "prediction", F.lit(base).alias("expected")
    )


@query("shap_adds_up", "select count(*) as row_count, true as adds_up from orders where o_totalprice is not null")
def shap_adds_up(spark, sf_dir):
    """SHAP values and the expected value add up to the prediction, for trees of 12 levels too."""
    df = planted(spark, sf_dir).drop("o_orderpriority")
    explained, _, base = shap.shap_values(df, "o_totalprice", "regression", depth=12, trees=5)
    total = F.aggregate("shap", F.lit(base), lambda a, v: a + v)
    near = F.abs(total - F.col("prediction")) <= 1e-6 * (1 + F.abs("prediction"))
    return explained.agg(F.count("*").alias("row_count"), F.every(near).alias("adds_up"))


# Nodes of a tree with one feature twice on a path: (feature, cut, left, right) or a leaf's value.
TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
TREE = [(0, 24.0, 1, 2), (1, 0.05, 3, 4), (0, 40.0, 5, 6), 10.0, 30.0, 50.0, (2, 0.04, 7, 8), 90.0, 60.0]


def _reached(node: int = 0, conditions: tuple = ()) -> dict[int, str]:
    """Condition under which a row reaches each node."""
    found = {node: " and ".join(conditions) or "true"}
    if isinstance(TREE[node], tuple):
        f, cut, left, right = TREE[node]
        found |= _reached(left, (*conditions, f"{TREE_FEATURES[f]} <= {cut}"))
        found |= _reached(right, (*conditions, f"{TREE_FEATURES[f]} > {cut}"))
    return found


def _worth(known: frozenset, node: int = 0) -> str:
    """The tree's mean as SQL when only the ``known`` features of the row are given."""
    if not isinstance(TREE[node], tuple):
        return f"{TREE[node]}e0"
    f, cut, left, right = TREE[node]
    a, b = _worth(known, left), _worth(known, right)
    if f in known:
        return f"(case when {TREE_FEATURES[f]} <= {cut} then {a} else {b} end)"
    return f"((c{left} * {a} + c{right} * {b}) / c{node}::double)"


def _subset_sql(i: int) -> str:
    n = len(TREE_FEATURES)
    rest = [k for k in range(n) if k != i]
    parts = [
        f"{math.factorial(r) * math.factorial(n - r - 1)} / {math.factorial(n)}e0 * ({_worth(frozenset({*s, i}))} - {_worth(frozenset(s))})"
        for r in range(n) for s in itertools.combinations(rest, r)
    ]
    return f"round({' + '.join(parts)}, 6) + 0e0 as {TREE_FEATURES[i]}_shap"


@query(
    "shap_tree",
    f"""with covers as (select {', '.join(f"count(*) filter (where {w}) as c{k}" for k, w in sorted(_reached().items()))} from lineitem)
    select l_orderkey, l_linenumber, {', '.join(_subset_sql(i) for i in range(len(TREE_FEATURES)))} from lineitem, covers""",
)
def shap_tree(spark, sf_dir):
    """SHAP values of a given tree over all rows; the SQL goes through all sets of known features."""
    rows = table(spark, sf_dir, "lineitem")
    counted = rows.agg(*[F.count_if(F.expr(w)).alias(f"c{k}") for k, w in _reached().items()]).first()
    nodes = [n if isinstance(n, tuple) else (0, 0.0, k, k) for k, n in enumerate(TREE)]
    tree = models.Tree(
        *[np.array(part) for part in zip(*nodes)], np.array([[0.0 if isinstance(n, tuple) else n] for n in TREE]),
        np.array([float(counted[f"c{k}"]) for k in range(len(TREE))]), 3,
    )
    found = shap.explain(F.array(*[F.col(c).cast("double") for c in TREE_FEATURES]), [tree])
    return rows.select("l_orderkey", "l_linenumber", found.alias("shap")).select(
        "l_orderkey", "l_linenumber",
        *[(F.round(F.get("shap", F.lit(i)), 6) + 0.0).alias(f"{c}_shap") for i, c in enumerate(TREE_FEATURES)],
    )


@query("segmented_shap")
def segmented_shap(spark, sf_dir):
    return shap.segmented_shap(planted(spark, sf_dir), "o_totalprice")


@query("segmented_shap_class")
def segmented_shap_class(spark, sf_dir):
    return shap.segmented_shap(docs(spark, sf_dir), "quality")


SHARE_COLUMNS = [
    "l_suppkey",
    "concat('cluster_', cast(l_suppkey as varchar(20))) as name",
    "case when l_suppkey % 2 = 0 then 'l_tax' else 'l_discount' end as feature",
    "round(q * 1.37e0 - 0.2e0, 9) as share",
]
SHARES_SQL = fx.sql_from(
    SHARE_COLUMNS, "(select l_suppkey, max(l_quantity) / sum(l_quantity) * 10 as q from lineitem group by l_suppkey) s"
)


@query(
    "segment_insight",
    with_input(
        SHARES_SQL,
        """select l_suppkey, case when share > 0.80 then 'WARNING' when share > 0.50 then 'strong' else 'even' end as reading,
        case when share > 0.80 then concat('WARNING: Suspected causal leakage detected in ', name, '. Feature ''', feature,
            ''' has overwhelming predictive power (', printf('%.1f', share * 100), '%), indicating it may be a proxy for the target.')
          when share > 0.50 then concat('In ', name, ', ''', feature, ''' strongly influences the model (', printf('%.1f', share * 100), '% importance).')
          else concat('In ', name, ', predictive power is distributed evenly, with ''', feature, ''' leading slightly.') end as insight
        from t""",
    ),
)
def segment_insight(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
        .agg((F.max("l_quantity") / F.sum("l_quantity") * 10).alias("q")).selectExpr(*SHARE_COLUMNS)
    )
    share = F.col("share")
    return rows.select(
        "l_suppkey",
        F.when(share > 0.80, "WARNING").when(share > 0.50, "strong").otherwise("even").alias("reading"),
        shap.segment_insight(F.col("name"), F.col("feature"), share).alias("insight"),
    )


@query("linear_impact")
def linear_impact(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", [*fx.GAPS[3:8], *fx.GAPS[8:10]])
    return impact.linear_impact(df, "l_quantity", [{"type": "missing_values", "column": "l_tax"}])


@query("linear_impact_class")
def linear_impact_class(spark, sf_dir):
    df = docs(spark, sf_dir).drop("doc_id")
    return impact.linear_impact(df, "quality", [{"type": "outliers", "column": "n_chars"}])


@query("remediation_evaluation")
def remediation_evaluation(spark, sf_dir):
    df = docs(spark, sf_dir).selectExpr("lang", "source", "n_chars", "quality", "case when doc_id % 5 = 0 then null else toxic end as toxic")
    return impact.evaluate_remediations(df, "quality", detect_issues(df, "quality"))
