"""Drift queries: stored histograms, two tables, and per time window."""

from __future__ import annotations

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.profile_queries import r6
from catalog.sqltext import EVENTS_NUMERIC, named, union_all
from tablewarden.operators import drift, eda

SHIFT_INPUT = f"r as ({fx.SPLIT_REFERENCE_SQL}), c as ({fx.SHIFT_CURRENT_SQL})"
SPLIT_INPUT = f"r as ({fx.SPLIT_REFERENCE_SQL}), c as ({fx.SPLIT_CURRENT_SQL})"


def _edges10(c: str) -> str:
    """Bins 0..9 of the reference histogram with their edges and counts."""
    return (
        f"select s.bin, case when s.bin = 9 then hi else lo + (s.bin + 1) * ((hi - lo) / 10) end as e1,"
        f" lo + s.bin * ((hi - lo) / 10) as e0 from"
        f" (select min({c})::double as lo, max({c})::double as hi from r) x, (select unnest(range(10)) as bin) s"
    )


def _in_bin(c: str, last: str) -> str:
    return f"{c} >= e0 and ({c} < e1 or ({last} and {c} <= e1))"


def _psi_hist_sql(c: str) -> str:
    return f"""
    select {named(c)}, sum((test - train) * ln(test / train)) as psi from (
      select case when n_r = 0 then 1e-4 else n_r * 1.0e0 / sum(n_r) over () end as train,
             case when n_c = 0 then 1e-4 else n_c * 1.0e0 / sum(n_c) over () end as test
      from (select bin, (select count(*) from r where {_in_bin(c, 'bin = 9')}) as n_r,
                   (select count(*) from c where {_in_bin(c, 'bin = 9')}) as n_c
            from ({_edges10(c)}) b) n) s
    having (select count(*) from c
      where {c} between (select min({c}) from r) and (select max({c}) from r)) > 0
    """


def _reported(inner: str) -> str:
    return (
        'select "column", round(psi, 6) as psi, case when psi > 0.2 then \'HIGH\' else \'MEDIUM\' end as severity'
        f" from ({inner}) p where psi > 0.1"
    )


@query(
    "drift_psi_hist",
    f"with {SHIFT_INPUT} " + _reported(union_all(_psi_hist_sql, EVENTS_NUMERIC)),
)
def drift_psi_hist(spark, sf_dir):
    reference, current = fx.events_shift(spark, sf_dir)
    stored = eda.histogram_arrays(eda.histogram(reference))
    return drift.psi_against_histograms(current, stored).select("column", r6("psi"), "severity")


def _window_psi_sql(c: str) -> str:
    return f"""
    select w as window_start, w + interval 6 hour as window_end, {named(c)},
      sum((test - train) * ln(test / train)) as psi
    from (
      select w, case when n_r = 0 then 1e-4 else n_r * 1.0e0 / sum(n_r) over (partition by w) end as train,
        case when n_c = 0 then 1e-4 else n_c * 1.0e0 / sum(n_c) over (partition by w) end as test
      from (
        select x.w, b.bin, n_r, coalesce(n_c, 0) as n_c
        from (select b.bin, count(r.{c}) as n_r from ({_edges10(c)}) b left join r
                on {_in_bin("r." + c, 'bin = 9')} group by b.bin) b
        cross join (select distinct w from c where {c} between (select min({c}) from r) and (select max({c}) from r)) x
        left join (select w, bin, count(*) as n_c from c join ({_edges10(c)}) b
                on {_in_bin("c." + c, 'bin = 9')} group by w, bin) t on t.w = x.w and t.bin = b.bin) n) s
    group by w
    """


@query(
    "drift_psi_windowed",
    f"""with r as ({fx.SPLIT_REFERENCE_SQL}),
    c as (select event_id, user_id, value, time_bucket(interval 6 hour, ts) as w from events
          where not (ts < {fx.SPLIT_AT}))
    select window_start, window_end, "column", round(psi, 6) as psi,
      case when psi > 0.2 then 'HIGH' else 'MEDIUM' end as severity
    from ({union_all(_window_psi_sql, EVENTS_NUMERIC)}) p where psi > 0.1""",
)
def drift_psi_windowed(spark, sf_dir):
    reference, _ = fx.events_split(spark, sf_dir)
    stored = eda.histogram_arrays(eda.histogram(reference))
    current = table(spark, sf_dir, "events").where(f"not (ts < {fx.SPLIT_AT})")
    found = drift.psi_per_window(current.select("ts", *EVENTS_NUMERIC), stored, "ts", "6 hours")
    return found.select("window_start", "window_end", "column", r6("psi"), "severity")


def psi_quantile_sql(c: str) -> str:
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""
    select {named(c)}, coalesce(sum((cur - ref) * ln(cur / ref)), 0) as psi from (
      select greatest((select count(*) from r where {_in_bin(c, 'is_last')}) * 1.0e0
               / (select count({c}) from r), 1e-4) as ref,
             greatest((select count(*) from c where {_in_bin(c, 'is_last')}) * 1.0e0
               / (select count({c}) from c), 1e-4) as cur
      from (select e as e0, lead(e) over (order by e) as e1,
              row_number() over (order by e desc) = 2 as is_last
            from (select distinct unnest(quantile_cont({c}, [{probs}])) as e from r)) b
      where e1 is not null) s
    """


@query(
    "drift_psi",
    f"with {SHIFT_INPUT} select \"column\", round(psi, 6) as psi from ({union_all(psi_quantile_sql, EVENTS_NUMERIC)}) p",
)
def drift_psi(spark, sf_dir):
    return drift.psi_quantile_bins(*fx.events_shift(spark, sf_dir)).select("column", r6("psi"))


def kl_sql(c: str) -> str:
    return f"""
    select {named(c)}, sum(p / sp * ln((p / sp) / (q / sq))) as kl_divergence from (
      select p, q, sum(p) over () as sp, sum(q) over () as sq from (
        select (select count(*) from r where {_in_bin(c, 'bin = 19')}) * 1.0e0
                 / (select count({c}) from r) / (e1 - e0) + 1e-10 as p,
               (select count(*) from c where {_in_bin(c, 'bin = 19')}) * 1.0e0
                 / (select count({c}) from c) / (e1 - e0) + 1e-10 as q
        from (select s.bin, lo + s.bin * ((hi - lo) / 20) as e0,
                case when s.bin = 19 then hi else lo + (s.bin + 1) * ((hi - lo) / 20) end as e1
              from (select min(v)::double as lo, max(v)::double as hi from
                     (select {c} as v from r union all select {c} from c)) x,
                   (select unnest(range(20)) as bin) s) b) d) e
    """


@query(
    "drift_kl",
    f"with {SHIFT_INPUT} select \"column\", round(kl_divergence, 6) as kl_divergence"
    f" from ({union_all(kl_sql, EVENTS_NUMERIC)}) k",
)
def drift_kl(spark, sf_dir):
    found = drift.kl_divergence(*fx.events_shift(spark, sf_dir))
    return found.select("column", r6("kl_divergence"))


def distance_sql(c: str) -> str:
    return f"""
    select {named(c)}, sum((nxt - v) * abs(f - g)) as wasserstein, max(abs(f - g)) as ks_statistic,
      (select count({c}) from r) as n, (select count({c}) from c) as m from (
      select v, lead(v) over (order by v) as nxt,
        sum(a) over (order by v) * 1.0e0 / (select count({c}) from r) as f,
        sum(b) over (order by v) * 1.0e0 / (select count({c}) from c) as g
      from (select v, sum(a) as a, sum(b) as b from
             (select {c} as v, 1 as a, 0 as b from r union all select {c}, 0, 1 from c)
            where v is not null group by v) u) s
    """


@query(
    "drift_wasserstein",
    f"with {SHIFT_INPUT} select \"column\", round(wasserstein, 6) as wasserstein"
    f" from ({union_all(distance_sql, EVENTS_NUMERIC)}) d",
)
def drift_wasserstein(spark, sf_dir):
    found = drift.distribution_distances(*fx.events_shift(spark, sf_dir))
    return found.select("column", r6("wasserstein"))


@query(
    "drift_ks",
    f"with {SHIFT_INPUT} select \"column\", round(ks_statistic, 6) as ks_statistic"
    f" from ({union_all(distance_sql, EVENTS_NUMERIC)}) d",
)
def drift_ks(spark, sf_dir):
    found = drift.distribution_distances(*fx.events_shift(spark, sf_dir))
    return found.select("column", r6("ks_statistic"))


LAMBDA = "(sqrt(n * 1.0e0 * m / (n + m)) + 0.12 + 0.11 / sqrt(n * 1.0e0 * m / (n + m))) * ks_statistic"


def report_sql(inputs: str) -> str:
    psi = union_all(psi_quantile_sql, EVENTS_NUMERIC)
    kl = union_all(kl_sql, EVENTS_NUMERIC)
    far = union_all(distance_sql, EVENTS_NUMERIC)
    return f"""
    with recursive {inputs}, far as materialized ({far}),
    -- One row per column and step: the chance of each i inside the limit after t values. Chances
    -- that round to 0 by the exponential bound are not walked.
    lattice as (
      select "column", n, m, n + m as k, round(ks_statistic * n * m)::bigint as h, 0::bigint as t,
        0::bigint as lo, [1.0e0] as a
      from far where greatest(n, m) <= 10000 and ks_statistic > 0
        and 2.2 * exp(-2.0e0 * n * m / (n + m) * ks_statistic * ks_statistic) > 1e-9
      union all
      select "column", n, m, k, h, t + 1, lo1, list_transform(range(lo1, hi1 + 1),
        lambda i: coalesce(a[i - lo + 1], 0) * (m - t + i) / (k - t) + coalesce(a[i - lo], 0) * (n - i + 1) / (k - t))
      from (select *,
              greatest(floor(((t + 1) * n - h) * 1.0e0 / k)::bigint + 1, 0, lo) as lo1,
              least(floor(((t + 1) * n + h - 1) * 1.0e0 / k)::bigint, n, t + 1) as hi1
            from lattice where t < k) s),
    p as (
      select *, case
        when ks_statistic = 0 then 1.0
        when greatest(n, m) <= 10000 then coalesce(
          (select 1.0e0 - coalesce(list_sum(a), 0) from lattice x where x."column" = l."column" and x.t = x.k), 0)
        when lam < 0.2 then 1.0
        else least(1.0, greatest(0.0,
          list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2.0e0 else -2.0e0 end)
            * exp(-2.0e0 * k * k * lam * lam))))) end as ks_pvalue
      from (select *, {LAMBDA} as lam from far) l),
    v as (select p."column", psi, kl_divergence, wasserstein, ks_statistic, ks_pvalue,
            psi >= 0.1 or ks_pvalue < 0.05 as drift_detected
          from p join ({psi}) a on a."column" = p."column" join ({kl}) b on b."column" = p."column")
    select "column", round(psi, 6) as psi, round(kl_divergence, 6) as kl_divergence,
      round(wasserstein, 6) as wasserstein, round(ks_statistic, 6) as ks_statistic,
      round(ks_pvalue, 6) as ks_pvalue, drift_detected,
      case when not drift_detected then 'low' when psi > 0.2 or ks_pvalue < 0.01 then 'high'
           when psi > 0.1 or ks_pvalue < 0.05 then 'moderate' else 'low' end as severity
    from v
    """


def _report(reference, current):
    names = ["psi", "kl_divergence", "wasserstein", "ks_statistic", "ks_pvalue"]
    return drift.drift_report(reference, current).select(
        "column", *[r6(n) for n in names], "drift_detected", "severity"
    )


@query("drift_report", report_sql(SHIFT_INPUT))
def drift_report(spark, sf_dir):
    return _report(*fx.events_shift(spark, sf_dir))


@query("drift_report_unshifted", report_sql(SPLIT_INPUT))
def drift_report_unshifted(spark, sf_dir):
    return _report(*fx.events_split(spark, sf_dir))


@query(
    "drift_overall",
    f"with s as ({report_sql(SHIFT_INPUT)}) select bool_or(drift_detected) as overall_drift_detected from s",
)
def drift_overall(spark, sf_dir):
    return drift.overall_drift(drift.drift_report(*fx.events_shift(spark, sf_dir)))
