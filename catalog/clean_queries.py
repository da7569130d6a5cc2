"""Cleaning steps and single-issue fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.profile_queries import r6
from catalog.sqltext import LINEITEM_NUMERIC, fences, mode_of, with_input
from tablewarden.operators import cleaning, profile
from tablewarden.plans import steps


def rounded(df, names):
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])


def _clean_sql() -> str:
    filled = [
        f"coalesce({c}, (select median({c}) from d))::double as {c}"
        if c in LINEITEM_NUMERIC
        else f"coalesce({c}, {mode_of(c, 'd')}) as {c}"
        for c in fx.LINEITEM
    ]
    clipped = [
        f"round(greatest(least({c}, (select quantile_cont({c}, 0.99) from f)),"
        f" (select quantile_cont({c}, 0.01) from f)), 6) as {c}"
        if c in LINEITEM_NUMERIC
        else c
        for c in fx.LINEITEM
    ]
    return (
        f"with t as ({fx.DUPS_SQL}), d as (select distinct * from t), f as (select {', '.join(filled)} from d)"
        f" select {', '.join(clipped)} from f"
    )


@query("clean", _clean_sql())
def clean(spark, sf_dir):
    return rounded(cleaning.clean(fx.lineitem_dups(spark, sf_dir)), LINEITEM_NUMERIC)


STRICT = [
    "l_orderkey",
    "case when l_orderkey % 10 < 6 then null else l_tax end as l_tax",
    "case when l_orderkey % 3 = 0 then null else l_discount end as l_discount",
    "cast(null as double) as nothing",
]


@query("drop_sparse_strict", with_input(fx.sql_from(STRICT, "lineitem"), "select l_orderkey, l_discount from t"))
def drop_sparse_strict(spark, sf_dir):
    return profile.drop_sparse_columns(fx.derived(spark, sf_dir, "lineitem", STRICT))


@query(
    "step_drop_missing",
    with_input(fx.SPARSE_SQL, "select l_orderkey, l_quantity, l_discount from t"),
)
def step_drop_missing(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", fx.SPARSE)
    return steps.drop_missing(df, threshold=0.55)[0]


@query(
    "step_impute",
    with_input(
        fx.GAPS_SQL,
        "select l_orderkey, l_linenumber, round(coalesce(l_tax, (select median(l_tax) from t)), 6) as l_tax,"
        f" coalesce(l_returnflag, {mode_of('l_returnflag')}) as l_returnflag from t",
    ),
)
def step_impute(spark, sf_dir):
    df, _ = steps.impute_missing(fx.lineitem_gaps(spark, sf_dir), strategy="median")
    return df.select("l_orderkey", "l_linenumber", r6("l_tax"), "l_returnflag")


@query(
    "step_impute_mean",
    with_input(
        fx.GAPS_SQL,
        "select l_orderkey, l_linenumber, round(coalesce(l_tax, (select avg(l_tax) from t)), 6) as l_tax from t",
    ),
)
def step_impute_mean(spark, sf_dir):
    df, _ = steps.impute_missing(fx.lineitem_gaps(spark, sf_dir), strategy="mean", columns=["l_tax"])
    return df.select("l_orderkey", "l_linenumber", r6("l_tax"))


@query(
    "step_impute_mode",
    with_input(
        fx.GAPS_SQL,
        f"select l_orderkey, l_linenumber, coalesce(l_tax, {mode_of('l_tax')}) as l_tax,"
        f" coalesce(l_returnflag, {mode_of('l_returnflag')}) as l_returnflag from t",
    ),
)
def step_impute_mode(spark, sf_dir):
    df, _ = steps.impute_missing(fx.lineitem_gaps(spark, sf_dir), strategy="mode")
    return df.select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")


@query(
    "step_one_hot",
    with_input(
        fx.GAPS_SQL,
        "select l_orderkey, l_linenumber, coalesce(l_returnflag = 'N', false) as \"l_returnflag_N\","
        " coalesce(l_returnflag = 'R', false) as \"l_returnflag_R\", coalesce(l_linestatus = 'O', false)"
        " as \"l_linestatus_O\" from t",
    ),
)
def step_one_hot(spark, sf_dir):
    df = fx.lineitem_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return steps.encode_categorical(df, strategy="one_hot")[0]


LABEL_COLUMNS = ["c_custkey", "c_name", "case when c_custkey % 5 = 0 then null else c_mktsegment end as c_mktsegment"]


@query(
    "step_label",
    with_input(
        fx.sql_from(LABEL_COLUMNS, "customer"),
        "select c_custkey, (dense_rank() over (order by c_name) - 1)::int as c_name,"
        " case when c_mktsegment is null then -1 else (select count(distinct u.c_mktsegment) from t u"
        " where u.c_mktsegment < t.c_mktsegment) end::int as c_mktsegment from t",
    ),
)
def step_label(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "customer", LABEL_COLUMNS)
    return steps.encode_categorical(df, strategy="label")[0]


@query(
    "step_scale",
    with_input(
        fx.GAPS_SQL,
        "select l_orderkey, l_linenumber, round((l_quantity - (select avg(l_quantity) from t))"
        " / (select stddev_pop(l_quantity) from t), 6) as l_quantity,"
        " round((l_tax - (select avg(l_tax) from t)) / (select stddev_pop(l_tax) from t), 6) as l_tax from t",
    ),
)
def step_scale(spark, sf_dir):
    df = fx.lineitem_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(steps.scale_features(df, columns=["l_quantity", "l_tax"])[0], ["l_quantity", "l_tax"])


@query(
    "step_scale_minmax",
    "select event_id, round((value - (select min(value) from events)) / ((select max(value) from events)"
    " - (select min(value) from events)), 6) as value, 0.0::double as one from events",
)
def step_scale_minmax(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "events", fx.CONSTANT)
    return rounded(steps.scale_features(df, method="minmax", columns=["value", "one"])[0], ["value"])


STEP_CONFIG = [
    {"step": "drop_missing", "params": {"threshold": 0.5}},
    {"step": "impute_missing", "params": {"strategy": "median"}},
    {"step": "scale_features", "params": {"columns": ["l_quantity", "unknown"]}},
    {"step": "encode_categorical", "params": {"strategy": "label"}},
    {"step": "scale_features", "params": {"method": "minmax", "columns": ["l_quantity"]}},
]


@query(
    "step_log",
    with_input(
        fx.GAPS_SQL,
        """
        select position, step_name, transformation_applied, rows_affected from (
          (select 0 as position, 'Drop Missing Columns' as step_name,
             'Dropped 0 columns exceeding 50.0% missing' as transformation_applied, 0 as rows_affected) union all
          (select 1, 'Impute Missing Values', 'Replaced missing with median',
             2 * count(*) - count(l_tax) - count(l_returnflag) from t) union all
          (select 2, 'scale_features', 'FAILED: unknown columns: unknown', 0) union all
          (select 3, 'Encode Categorical', 'Applied label encoding to 2 columns', count(*) from t) union all
          (select 4, 'Scale Features', 'Scaled 1 features using minmax scaling', count(*) from t)
        ) s
        """,
    ),
)
def step_log(spark, sf_dir):
    return steps.run_steps(fx.lineitem_gaps(spark, sf_dir), STEP_CONFIG)[1]


@query(
    "fix_missing",
    with_input(
        fx.GAPS_SQL,
        "select l_orderkey, l_linenumber, round(coalesce(l_tax, (select median(l_tax) from t)), 6) as l_tax,"
        f" coalesce(l_returnflag, {mode_of('l_returnflag')}) as l_returnflag from t",
    ),
)
def fix_missing(spark, sf_dir):
    df = fx.lineitem_gaps(spark, sf_dir)
    for c in ("l_tax", "l_returnflag"):
        df = cleaning.remediate(df, {"type": "missing_values", "column": c})
    return df.select("l_orderkey", "l_linenumber", r6("l_tax"), "l_returnflag")


@query(
    "fix_outliers",
    f"select event_id, round(greatest(least(value, upper), lower), 6) as value from events,"
    f" ({fences('value', 'events')}) f",
)
def fix_outliers(spark, sf_dir):
    df = cleaning.remediate(table(spark, sf_dir, "events"), {"type": "OUTLIERS", "column": "value"})
    return df.select("event_id", r6("value"))


@query(
    "fix_cardinality",
    """
    with k as (select p_type from part group by p_type order by count(*) desc, p_type limit 10)
    select p_partkey, case when p_type in (select p_type from k) then p_type else 'Other' end as p_type from part
    """,
)
def fix_cardinality(spark, sf_dir):
    df = cleaning.remediate(table(spark, sf_dir, "part"), {"type": "high_cardinality", "column": "p_type"})
    return df.select("p_partkey", "p_type")


@query(
    "fix_imbalance",
    with_input(
        fx.RARE_SQL,
        "select rare, (select max(n) from (select count(*) as n from t group by rare)) as row_count from t group by rare",
    ),
)
def fix_imbalance(spark, sf_dir):
    df = cleaning.remediate(
        fx.derived(spark, sf_dir, "events", fx.RARE), {"type": "class_imbalance", "column": "rare"}
    )
    return df.groupBy("rare").agg(F.count(F.lit(1)).alias("row_count"))


@query("fix_correlation", with_input(fx.LEAK_SQL, "select l_orderkey, l_extendedprice, l_quantity from t"))
def fix_correlation(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", fx.LEAK)
    fixed = cleaning.remediate(df, {"type": "high_correlation", "column": "leak"})
    return fixed.drop("l_discount", "l_tax", "l_returnflag")


def _p_clip(c: str, source: str) -> str:
    return (
        f"round(greatest(least({c}, (select quantile_cont({c}, 0.99) from {source})),"
        f" (select quantile_cont({c}, 0.01) from {source})), 6) as {c}"
    )


@query(
    "fix_consensus",
    f"select {_p_clip('event_id', 'events')}, {_p_clip('user_id', 'events')}, event_type,"
    f" {_p_clip('value', 'events')} from events",
)
def fix_consensus(spark, sf_dir):
    df = table(spark, sf_dir, "events").drop("ts", "props")
    fixed = cleaning.remediate(df, {"type": "outliers_consensus"})
    return rounded(fixed, ["event_id", "user_id", "value"])
