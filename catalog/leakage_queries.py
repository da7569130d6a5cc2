"""Leakage signals, scores and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query
from catalog.profile_queries import corr_sql, r6
from catalog.sqltext import union_all, with_input
from tablewarden.operators import leakage

LEAK_NUMERIC = ["l_quantity", "l_discount", "l_tax", "leak"]
LEAK_COLUMNS = [c for c in fx.LEAK if c != "l_orderkey"]
LEAK_SQL = fx.sql_from(LEAK_COLUMNS, "lineitem")
CLASS_COLUMNS = [
    "l_linestatus",
    "case when l_orderkey % 11 = 0 then null else l_returnflag end as l_returnflag",
    "l_linenumber",
    "l_suppkey",
    "l_quantity",
    "l_orderkey % 10 >= 7 as held",
]
CLASS_SQL = fx.sql_from(CLASS_COLUMNS, "lineitem")


def feature(c: str) -> str:
    return f"'{c}' as feature"


@query(
    "leak_corr",
    with_input(
        LEAK_SQL,
        union_all(
            lambda c: f"select {feature(c)}, round(abs({corr_sql(c, 'l_extendedprice')}), 6) as correlation from t",
            LEAK_NUMERIC,
        )
        + " union all (select 'l_returnflag' as feature, 0.0 as correlation)",
    ),
)
def leak_corr(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", LEAK_COLUMNS)
    return leakage.target_correlation(df, "l_extendedprice").select("feature", r6("correlation"))


def mi_sql(c: str, x: str, y: str) -> str:
    return f"""
    select {feature(c)}, round(sum(n * 1.0e0 / total * ln(n * 1.0e0 * total / (nx * ny))), 6) as mutual_information
    from (select n, sum(n) over () as total, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny
          from (select {x} as x, {y} as y, count(*) as n from t where {c} is not null group by {x}, {y}) c) m
    """


@query(
    "leak_mi",
    with_input(
        CLASS_SQL,
        union_all(lambda c: mi_sql(c, c, "l_linestatus"), ["l_returnflag", "l_linenumber", "l_suppkey", "l_quantity"]),
    ),
)
def leak_mi(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", CLASS_COLUMNS).drop("held")
    return leakage.class_information(df, "l_linestatus").select("feature", r6("mutual_information"))


def decile_sql(c: str) -> str:
    return "(" + " + ".join(f"cast({c} >= (select quantile_cont({c}, {i / 10}) from t) as int)" for i in range(1, 10)) + ")"


def value_or_decile_sql(c: str) -> str:
    values = f"cast({c} as varchar)"
    return f"case when (select count(distinct {c}) from t) <= 100 then {values} else cast({decile_sql(c)} as varchar) end"


MI_COLUMNS = ["l_extendedprice", "l_extendedprice * 2 as leak", "l_quantity", "l_returnflag", "l_suppkey * 1.5e0 as wide"]


@query(
    "leak_mi_reg",
    with_input(
        fx.sql_from(MI_COLUMNS, "lineitem"),
        " union all ".join(
            f"({mi_sql(c, x, decile_sql('l_extendedprice'))})"
            for c, x in (
                ("leak", decile_sql("leak")),
                ("l_quantity", "cast(l_quantity as varchar)"),
                ("l_returnflag", "l_returnflag"),
                ("wide", value_or_decile_sql("wide")),
            )
        ),
    ),
)
def leak_mi_reg(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", MI_COLUMNS)
    return leakage.numeric_information(df, "l_extendedprice").select("feature", r6("mutual_information"))


def class_form_sql(c: str, x: str) -> str:
    return f"""
    select {feature(c)}, round(avg(cast(y = coalesce(best, (select y from t2 where not held and x is not null
        group by y order by count(*) desc, y limit 1)) as double)), 6) as predictive_power
    from (select y, x from t2 where held and x is not null) q left join
      (select x, y as best from (select x, y, row_number() over (partition by x order by count(*) desc, y) as r
        from t2 where not held and x is not null group by x, y) g where r = 1) b using (x)
    """.replace("t2", f"(select l_linestatus as y, {x} as x, held from t)")


def better_sql(form, c: str, *forms: str) -> str:
    """The better form of a feature."""
    each = " union all ".join(f"({form(c, x)})" for x in forms)
    return f"select feature, max(predictive_power) as predictive_power from ({each}) f group by feature"


def class_power_sql(c: str) -> str:
    return better_sql(class_form_sql, c, *([c] if c == "l_returnflag" else [c, decile_sql(c)]))


@query(
    "leak_power",
    with_input(CLASS_SQL, union_all(class_power_sql, ["l_returnflag", "l_linenumber", "l_quantity", "l_suppkey"])),
)
def leak_power(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", CLASS_COLUMNS)
    found = leakage.class_power(df, "l_linestatus", F.col("held"))
    return found.where("feature <> 'held'").select("feature", r6("predictive_power"))


def numeric_power_sql(c: str, x: str) -> str:
    source = f"(select l_extendedprice as y, {x} as x, held from t)"
    return f"""
    select {feature(c)}, round(greatest(0, 1 - sqrt(avg(power(y - guess, 2))) / stddev_pop(y)), 6) as predictive_power
    from (select y, coalesce(m, (select avg(y) from {source} where not held)) as guess from
           (select y, x from {source} where held and x is not null) q left join
           (select x, avg(y) as m from {source} where not held group by x) b using (x)) p
    """


POWER_COLUMNS = [
    "l_extendedprice", "l_extendedprice * 2 as leak", "l_quantity", "l_returnflag", "l_orderkey % 10 >= 7 as held",
]


@query(
    "leak_power_reg",
    with_input(
        fx.sql_from(POWER_COLUMNS, "lineitem"),
        " union all ".join(
            f"({better_sql(numeric_power_sql, c, *forms)})"
            for c, forms in (
                ("leak", ("leak", decile_sql("leak"))),
                ("l_quantity", ("l_quantity", decile_sql("l_quantity"))),
                ("l_returnflag", ("l_returnflag",)),
            )
        ),
    ),
)
def leak_power_reg(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", POWER_COLUMNS)
    found = leakage.numeric_power(df, "l_extendedprice", F.col("held"))
    return found.where("feature <> 'held'").select("feature", r6("predictive_power"))


# Signals between 0 and 1 of each part, so that rows fall on all sides of the rule thresholds.
SIGNALS = [
    "l_partkey",
    "round(avg(l_discount) * 20, 4) as share",
    "count(*) as n",
    "max(l_linenumber) as top",
]
PER_PART_SQL = f"select {', '.join(SIGNALS)} from lineitem group by l_partkey"
SIGNAL_LIST = [
    "l_partkey",
    "least(1.0e0, share * 0.99e0) as correlation",
    "share * 2 as mutual_information",
    "case when n % 3 = 0 then 0.995e0 when n % 3 = 1 then 0.93e0 else share / 2 end as predictive_power",
    "case when top = 7 then 0.35e0 else 0.05e0 end as permutation_importance",
    "case when n % 5 = 0 then 0.2e0 else 0.0e0 end as ablation_impact",
]
SIGNALS_SQL = fx.sql_from(SIGNAL_LIST, f"({PER_PART_SQL}) s")
SCORE_SQL = f"""
with t as ({SIGNALS_SQL}), r as (select *,
  (case when correlation >= 0.95 then 60 when correlation > 0.8 then 20 else 0 end)
  + (case when predictive_power >= 0.99 then 40 when predictive_power > 0.90 then 15 else 0 end)
  + least(mutual_information * 10, 20) as raw,
  (predictive_power > 0.75 or permutation_importance > 0.30 or ablation_impact > 0.10) and correlation < 0.95 as strong
  from t),
s as (select l_partkey, round(raw, 2) as raw_score, round(100 / (1 + exp(-0.06e0 * (raw - 30))), 1) as leakage_score,
  case when correlation >= 0.95 or raw >= 85 then 'CONFIRMED_LEAKAGE'
       when raw >= 60 and not strong then 'HIGH_RISK_PROXY' when strong then 'STRONG_PREDICTOR'
       else 'NORMAL_FEATURE' end as category from r)
"""


def _scored(spark, sf_dir):
    share = F.round(fx.exact_mean("l_discount") * 20, 4).cast("double").alias("share")
    per_part = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(share, *[F.expr(e) for e in SIGNALS[2:]])
    return leakage.score_signals(per_part.selectExpr(*SIGNAL_LIST))


@query("leak_score", SCORE_SQL + "select l_partkey, raw_score, leakage_score, category from s")
def leak_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("l_partkey", "raw_score", "leakage_score", "category")


@query(
    "leak_worst",
    SCORE_SQL
    + """
    , p as (select l_partkey % 50 as grp, category, case category when 'NORMAL_FEATURE' then 0
      when 'STRONG_PREDICTOR' then 1 when 'HIGH_RISK_PROXY' then 2 else 3 end as priority from s)
    select grp, max_by(category, priority) as worst_category from p group by grp
    """,
)
def leak_worst(spark, sf_dir):
    grouped = _scored(spark, sf_dir).withColumn("grp", F.col("l_partkey") % 50)
    return leakage.worst_category(grouped, ["grp"])


@query(
    "leak_pairs",
    with_input(
        fx.GAPS_SQL,
        union_all(
            lambda c: f"select {feature(c)}, count(*) filter (where {c} is not null and l_tax is not null) as pairs from t",
            [c for c in fx.LINEITEM if c != "l_tax"],
        ),
    ),
)
def leak_pairs(spark, sf_dir):
    return leakage.valid_pairs(fx.lineitem_gaps(spark, sf_dir), "l_tax")


@query("leakage_report")
def leakage_report(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", fx.LEAK)
    return leakage.detect_leakage(df.drop("l_orderkey"), "l_extendedprice", "regression")


@query("leakage_report_class")
def leakage_report_class(spark, sf_dir):
    df = fx.docs_labeled(spark, sf_dir).drop("doc_id", "text")
    return leakage.detect_leakage(df, "quality", "classification")
