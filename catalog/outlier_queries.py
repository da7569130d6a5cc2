"""Outlier detectors and their agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.profile_queries import r6
from catalog.sqltext import with_input
from tablewarden.operators import outliers
from tablewarden.plans import steps

# Missing values in one column, so that scores of partly missing rows are covered.
PAIR = ["event_id", "case when event_id % 17 = 0 then null else user_id end as user_id", "value"]
PAIR_SQL = fx.sql_from(PAIR, "events")
FEATURES = ["user_id", "value"]


def pair(spark, sf_dir):
    return fx.derived(spark, sf_dir, "events", PAIR)


def _z(c: str) -> str:
    return f"coalesce(abs({c} - (select avg({c}) from t)) / (select stddev_samp({c}) from t), 0)"


def _mad(c: str) -> str:
    return (
        f"coalesce(0.6745 * abs({c} - (select median({c}) from t)) / (select median(abs({c} - m)) from t,"
        f" (select median({c}) as m from t)), 0)"
    )


Z_SQL = f"greatest({_z('user_id')}, {_z('value')})"
MAD_SQL = f"greatest({_mad('user_id')}, {_mad('value')})"


@query(
    "z_outliers",
    with_input(PAIR_SQL, f"select event_id, round({Z_SQL}, 6) as z_score, {Z_SQL} > 3 as z_vote from t"),
)
def z_outliers(spark, sf_dir):
    found = outliers.z_outliers(pair(spark, sf_dir), FEATURES)
    return found.select("event_id", r6("z_score"), "z_vote")


@query(
    "mad_outliers",
    with_input(PAIR_SQL, f"select event_id, round({MAD_SQL}, 6) as mad_score, {MAD_SQL} > 3.5 as mad_vote from t"),
)
def mad_outliers(spark, sf_dir):
    found = outliers.mad_outliers(pair(spark, sf_dir), FEATURES)
    return found.select("event_id", r6("mad_score"), "mad_vote")


@query("iforest")
def iforest(spark, sf_dir):
    found = outliers.forest_scores(pair(spark, sf_dir), FEATURES, row_key="event_id")
    return found.select("event_id", "isolation_forest")


@query(
    "minmax_norm",
    "select event_id, round((value - (select min(value) from events)) / ((select max(value) from events)"
    " - (select min(value) from events)), 6) as scaled from events",
)
def minmax_norm(spark, sf_dir):
    found = outliers.min_max(table(spark, sf_dir, "events"), "value", "scaled")
    return found.select("event_id", r6("scaled"))


def noise_sql(eps: str, needed: str) -> str:
    """Noise flag per event of its standardised value."""
    return f"""
    z as (select event_id, round((value - (select avg(value) from events))
            / (select stddev_pop(value) from events), 9) as z from events),
    near as (select event_id, z, count(*) over (order by z range between {eps} preceding and {eps} following) as n from z),
    core as (select event_id, z, n, n >= {needed} as is_core from near),
    noise as (select event_id, not is_core and
        sum(case when is_core then 1 else 0 end) over (order by z range between {eps} preceding and {eps} following) = 0
        as is_noise from core)
    """


NEEDED = "greatest(5, cast(floor((select count(*) from events) * 0.01) as bigint))"


@query(
    "dbscan_1d",
    f"with {noise_sql('3.0::double', NEEDED)} select event_id, cast(is_noise as int) as dbscan from noise",
)
def dbscan_1d(spark, sf_dir):
    found = outliers.density_noise(table(spark, sf_dir, "events"), ["value"])
    return found.select("event_id", "dbscan")


@query(
    "dbscan_1d_narrow",
    f"with {noise_sql('0.05::double', NEEDED)} select event_id, cast(is_noise as int) as dbscan from noise",
)
def dbscan_1d_narrow(spark, sf_dir):
    found = outliers.density_noise(table(spark, sf_dir, "events"), ["value"], eps=0.05)
    return found.select("event_id", "dbscan")


THREE = ["event_id", "user_id", "value"]


def noise_nd_sql(eps: str, needed: str) -> str:
    """Noise flag per event over its three standardised columns, by comparing all pairs."""
    scaled = ", ".join(f"round(({c} - (select avg({c}) from events)) / (select stddev_pop({c}) from events), 9) as z{i}" for i, c in enumerate(THREE))
    near = " + ".join(f"(x.z{i} - y.z{i}) * (x.z{i} - y.z{i})" for i in range(3)) + f" <= {eps} * {eps}"
    return f"""
    z as (select event_id, {scaled} from events),
    core as materialized (select x.event_id, any_value(x.z0) as z0, any_value(x.z1) as z1, any_value(x.z2) as z2, count(*) >= {needed} as is_core
             from z x join z y on {near} group by x.event_id),
    reached as (select distinct x.event_id from core x join core y on not x.is_core and y.is_core and {near}),
    noise as (select event_id, not is_core and event_id not in (select event_id from reached) as is_noise from core)
    """


@query("dbscan_nd", f"with {noise_nd_sql('0.5::double', NEEDED)} select event_id, cast(is_noise as int) as dbscan from noise")
def dbscan_nd(spark, sf_dir):
    found = outliers.density_noise(table(spark, sf_dir, "events"), THREE, eps=0.5)
    return found.select("event_id", "dbscan")


@query(
    "consensus_three_columns",
    f"with t as (select event_id, user_id, value from events), {noise_nd_sql('3.0::double', NEEDED)},"
    f" s as (select t.event_id, greatest({', '.join(_z(c) for c in THREE)}) as z_score,"
    f" greatest({', '.join(_mad(c) for c in THREE)}) as mad_score, is_noise from t join noise using (event_id)),"
    " v as (select *, cast(z_score > 3 as int) + cast(mad_score > 3.5 as int) + cast(is_noise as int) as vote_count from s)"
    " select event_id, round(z_score, 8) as z_score, round(mad_score, 8) as mad_score, cast(is_noise as int) as dbscan,"
    " vote_count, vote_count >= 2 as is_outlier from v",
)
def consensus_three_columns(spark, sf_dir):
    flagged = outliers.flag_outliers(table(spark, sf_dir, "events"), columns=THREE, use_forest=False)
    # Scores of consecutive ids have seven decimals, so six would round halves.
    return flagged.select("event_id", F.round("z_score", 8).alias("z_score"), F.round("mad_score", 8).alias("mad_score"), "dbscan", "vote_count", "is_outlier")


@query("consensus")
def consensus(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    flagged = outliers.flag_outliers(df, columns=FEATURES, row_key="event_id")
    return flagged.select(
        "event_id", "z_score", "mad_score", "isolation_forest", "dbscan", "z_vote", "mad_vote", "iso_vote",
        "dbscan_vote", "vote_count", "is_outlier", "primary_anomaly_column", "anomaly_value",
        "anomaly_reason", "detectors_triggered",
    )


@query("consensus_summary")
def consensus_summary(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return outliers.outlier_summary(outliers.flag_outliers(df, columns=FEATURES, row_key="event_id"))


VALUE_MAD = "0.6745 * abs(value - (select median(value) from events)) / (select median(abs(value - m)) from events, (select median(value) as m from events))"
VALUE_Z = "abs(value - (select avg(value) from events)) / (select stddev_samp(value) from events)"
VOTES_SQL = f"""
with {noise_sql('3.0::double', NEEDED)},
 s as (select e.event_id, e.value, {VALUE_Z} as z_score, {VALUE_MAD} as mad_score, is_noise
       from events e join noise n on n.event_id = e.event_id),
 v as (select *, cast(z_score > 3 as int) + cast(mad_score > 3.5 as int) + cast(is_noise as int) as vote_count from s)
"""


def _three_votes(spark, sf_dir):
    return outliers.flag_outliers(table(spark, sf_dir, "events"), columns=["value"], use_forest=False)


@query(
    "consensus_zmd",
    VOTES_SQL
    + "select event_id, round(z_score, 6) as z_score, round(mad_score, 6) as mad_score,"
    " cast(is_noise as int) as dbscan, vote_count, vote_count >= 2 as is_outlier from v",
)
def consensus_zmd(spark, sf_dir):
    return _three_votes(spark, sf_dir).select(
        "event_id", r6("z_score"), r6("mad_score"), "dbscan", "vote_count", "is_outlier"
    )


@query(
    "consensus_zmd_summary",
    VOTES_SQL
    + "select count(*) filter (where vote_count >= 2) as total_outliers,"
    " round(avg(cast(vote_count >= 2 as double)) * 100, 6) as percentage_flagged,"
    " round(avg(cast(z_score > 3 as double)) * 100, 6) as z_score,"
    " round(avg(cast(mad_score > 3.5 as double)) * 100, 6) as mad_score,"
    " round(avg(cast(is_noise as double)) * 100, 6) as dbscan from v",
)
def consensus_zmd_summary(spark, sf_dir):
    found = outliers.outlier_summary(_three_votes(spark, sf_dir))
    return found.select(
        "total_outliers", r6("percentage_flagged"), r6("z_score"), r6("mad_score"), r6("dbscan")
    )


@query(
    "anomaly_driver",
    VOTES_SQL
    + """
    select event_id, 'value' as primary_anomaly_column, round(value, 6) as anomaly_value,
      concat('value contains an unusually ', case when value > (select median(value) from events) then 'high' else 'low' end,
        ' value compared to the dataset distribution.') as anomaly_reason,
      concat_ws(', ', case when z_score > 3 then 'Z-SCORE' end, case when mad_score > 3.5 then 'MAD' end,
        case when is_noise then 'DBSCAN' end) as detectors_triggered
    from v where vote_count >= 2
    """,
)
def anomaly_driver(spark, sf_dir):
    return _three_votes(spark, sf_dir).where("is_outlier").select(
        "event_id", "primary_anomaly_column", r6("anomaly_value"), "anomaly_reason", "detectors_triggered"
    )


@query(
    "top_outliers",
    VOTES_SQL + "select event_id, vote_count from v where vote_count >= 2 order by event_id limit 100",
)
def top_outliers(spark, sf_dir):
    return outliers.top_outliers(_three_votes(spark, sf_dir), "event_id", k=100).select("event_id", "vote_count")


@query("univariate_outliers")
def univariate_outliers(spark, sf_dir):
    return outliers.univariate_outliers(table(spark, sf_dir, "events"))


@query(
    "univariate_outliers_zmd",
    VOTES_SQL
    + "select 'value' as \"column\", round(count(*) filter (where vote_count >= 2) * 100.0e0 / count(*), 2)"
    " as outlier_percentage from v",
)
def univariate_outliers_zmd(spark, sf_dir):
    return outliers.univariate_outliers(table(spark, sf_dir, "events"), ["value"], use_forest=False)


@query("step_remove_outliers")
def step_remove_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return steps.remove_outliers(df, columns=FEATURES, row_key="event_id")[0].select("event_id", "value")
