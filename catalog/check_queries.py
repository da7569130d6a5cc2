"""Issue checks, rules, identifiers and target profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.profile_queries import corr_sql, r6
from catalog.sqltext import (
    EVENTS_NUMERIC,
    fences,
    named,
    union_all,
    with_input,
)
from tablewarden.functions.patterns import PII_PATTERNS
from tablewarden.functions.runtime import together
from tablewarden.operators import checks, identifiers, suggestions, targets


def _repeat_sql(c: str) -> str:
    return (
        f"select {named(c)}, count(*) - count(distinct {c}) - max(case when {c} is null then 1 else 0 end)"
        " as count, count(*) as n from t"
    )


DOCS_IDS = [
    "case when doc_id % 9 = 0 then null else doc_id end as doc_id",
    "doc_id as record_id",
    "n_chars as chars_id",
    "lang",
]


@query(
    "uniqueness",
    with_input(
        fx.sql_from(DOCS_IDS, "documents"),
        'select "column", count, round(count * 100.0e0 / n, 6) as percentage from ('
        + union_all(_repeat_sql, ["doc_id", "record_id", "chars_id"])
        + ") s where count > 0",
    ),
)
def uniqueness(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "documents", DOCS_IDS)
    return checks.uniqueness(df).select("column", "count", r6("percentage"))


@query(
    "high_cardinality",
    "select \"column\", count from ("
    + union_all(
        lambda c: f"select {named(c)}, count(distinct {c}) as count, count(*) as n from customer",
        ["c_name", "c_mktsegment"],
    )
    + ") s where count > n * 0.9 and count > 50",
)
def high_cardinality(spark, sf_dir):
    return checks.high_cardinality(table(spark, sf_dir, "customer"))


def _pii_sql(columns: list[str], threshold: float) -> str:
    kinds = list(PII_PATTERNS.items())
    counted = union_all(
        lambda c: f"select {named(c)}, count({c}) as v, "
        + ", ".join(
            f"count(*) filter (where regexp_matches({c}, '{pattern}')) as m{k}"
            for k, (_, pattern) in enumerate(kinds)
        )
        + " from t",
        columns,
    )
    first = " ".join(f"when m{k} * 100.0e0 / v > {threshold} then '{kind}'" for k, (kind, _) in enumerate(kinds))
    share = " ".join(f"when m{k} * 100.0e0 / v > {threshold} then m{k} * 100.0e0 / v" for k in range(len(kinds)))
    return (
        f'select "column", pii_type, round(percentage, 6) as percentage from (select "column",'
        f" case {first} end as pii_type, case {share} end as percentage from ({counted}) c where v > 0) p"
        " where pii_type is not null"
    )


@query("pii_issues", with_input(fx.DOCS_PII_SQL, _pii_sql(["text", "lang", "source", "contact"], 5.0)))
def pii_issues(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "documents", fx.DOCS_PII)
    return checks.pii(df).select("column", "pii_type", r6("percentage"))


@query("pii_low_threshold", with_input("select * from documents", _pii_sql(["text", "lang", "source"], 0.5)))
def pii_low_threshold(spark, sf_dir):
    found = checks.pii(table(spark, sf_dir, "documents"), threshold=0.5)
    return found.select("column", "pii_type", r6("percentage"))


@query("pii_pages", with_input("select * from pages", _pii_sql(["url", "html"], 0.5)))
def pii_pages(spark, sf_dir):
    found = checks.pii(table(spark, sf_dir, "pages"), threshold=0.5)
    return found.select("column", "pii_type", r6("percentage"))


@query(
    "class_imbalance",
    with_input(
        fx.RARE_SQL,
        "select 'rare' as \"column\", concat('1:', cast(cast(floor((high * 1.0e0 / total) / (low * 1.0e0 / total))"
        " as bigint) as varchar)) as ratio, round(low * 1.0e0 / total * 100, 6) as min_class from"
        " (select min(n) as low, max(n) as high, sum(n) as total, count(*) as d from"
        " (select rare, count(*) as n from t group by rare)) where d < 20 and low * 1.0e0 / total < 0.1",
    ),
)
def class_imbalance(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "events", fx.RARE)
    return checks.class_imbalance(df, "rare").select("column", "ratio", r6("min_class"))


LEAK_NUMERIC = ["l_orderkey", "l_extendedprice", "leak", "l_quantity", "l_discount", "l_tax"]


def _pairs_sql(names: list[str]) -> str:
    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    return " union all ".join(
        f"(select {i} as i, '{names[i]}' as left_name, '{names[j]}' as right_name,"
        f" abs({corr_sql(names[i], names[j])}) as r from t)"
        for i, j in pairs
    )


@query(
    "high_correlation",
    with_input(
        fx.LEAK_SQL,
        "select right_name as \"column\", string_agg(left_name, '|' order by i) as correlated_with from ("
        + _pairs_sql(LEAK_NUMERIC)
        + ") p where r > 0.85 group by right_name",
    ),
)
def high_correlation(spark, sf_dir):
    found = checks.high_correlation(fx.derived(spark, sf_dir, "lineitem", fx.LEAK))
    return found.select("column", F.concat_ws("|", "correlated_with").alias("correlated_with"))


def iqr_sql(names: list[str]) -> str:
    counted = union_all(
        lambda c: f"select {named(c)}, count({c}) as v, count(*) filter (where {c} < lower or {c} > upper)"
        f" as count from t, ({fences(c)}) f",
        names,
    )
    return (
        f'select "column", count, round(count * 100.0e0 / v, 6) as percentage from ({counted}) s'
        " where v >= 10 and count * 100.0e0 / v > 1"
    )


@query("iqr_outliers", with_input("select * from events", iqr_sql(EVENTS_NUMERIC)))
def iqr_outliers(spark, sf_dir):
    return checks.iqr_outliers(table(spark, sf_dir, "events")).select("column", "count", r6("percentage"))


@query("iqr_outliers_documents", with_input("select * from documents", iqr_sql(["doc_id", "n_chars"])))
def iqr_outliers_documents(spark, sf_dir):
    return checks.iqr_outliers(table(spark, sf_dir, "documents")).select("column", "count", r6("percentage"))


RULES = [
    {"column": "l_quantity", "type": "min", "value": 5},
    {"column": "l_discount", "type": "max", "value": 0.08},
    {"column": "l_returnflag", "type": "in", "value": ["A", "N"]},
    {"column": "l_tax", "type": "not_null", "value": None},
    {"column": "l_linestatus", "type": "min", "value": 1},
    {"column": "l_tax", "type": "min", "value": 0},
    {"column": "unknown", "type": "min", "value": 1},
    {"column": "l_tax", "type": "unknown", "value": 1},
]


@query(
    "rules",
    with_input(
        fx.GAPS_SQL,
        """
        select "column", rule_type, expected, count, round(count * 100.0e0 / n, 6) as percentage from (
          (select 'l_quantity' as "column", 'min' as rule_type, '5' as expected,
             count(*) filter (where l_quantity < 5) as count, count(*) as n from t) union all
          (select 'l_discount', 'max', '0.08', count(*) filter (where l_discount > 0.08e0), count(*) from t) union all
          (select 'l_returnflag', 'in', '["A", "N"]',
             count(*) filter (where l_returnflag is null or l_returnflag not in ('A', 'N')), count(*) from t) union all
          (select 'l_tax', 'not_null', cast(null as varchar), count(*) filter (where l_tax is null), count(*) from t)
        ) s where count > 0
        """,
    ),
)
def rules(spark, sf_dir):
    found = checks.rule_violations(fx.lineitem_gaps(spark, sf_dir), RULES)
    return found.select("column", "rule_type", "expected", "count", r6("percentage"))


KEYS = {
    "part": "p_partkey",
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "labels": "doc_id",
    "lineitem": "l_orderkey",
}


def _sequential_sql(source: str, key: str) -> str:
    return f"""
    (select '{source}' as source, '{key}' as "column" from
      (select count(distinct {key}) * 1.0e0 / count({key}) as ratio from {source}) u,
      (select median(gap) as middle from (select {key} - lag({key}) over (order by {key}) as gap from {source})) m
     where ratio > 0.995 and middle <> 0 and (select avg(case when gap = middle then 1.0e0 else 0 end) from
       (select {key} - lag({key}) over (order by {key}) as gap from {source}) where gap is not null) > 0.95)
    """


@query("sequential_id", " union all ".join(_sequential_sql(t, c) for t, c in KEYS.items()))
def sequential_id(spark, sf_dir):
    per_table = together(
        *[lambda t=t, key=key: identifiers.sequential_columns(table(spark, sf_dir, t), [key]) for t, key in KEYS.items()]
    )
    found = [(t, c) for t, names in zip(KEYS, per_table) for c in names]
    return spark.createDataFrame(found, 'source string, column string')


@query(
    "identifiers",
    """
    select "column", class from (
      (select 'c_custkey' as "column", 'IDENTIFIER_COLUMN_DETECTED' as class,
         (select count(distinct c_custkey) > 0.995 * count(*) and
            (max(c_custkey) - min(c_custkey)) = count(*) - 1 from customer) as hit) union all
      (select 'c_name', 'HIGH_CARDINALITY_TEXT',
         (select count(distinct c_name) > 0.995 * count(c_name) from customer)) union all
      (select 'c_mktsegment', 'HIGH_CARDINALITY_TEXT',
         (select count(distinct c_mktsegment) > 0.995 * count(c_mktsegment) from customer))
    ) s where hit
    """,
)
def identifier_classes(spark, sf_dir):
    return identifiers.identifier_classes(table(spark, sf_dir, "customer"))


EVENT_IDS = ["event_id", "user_id", "concat('a', cast(event_id * 7 as varchar(20))) as account", "value"]


@query(
    "identifiers_potential",
    with_input(
        fx.sql_from(EVENT_IDS, "events"),
        """
        select "column", class from (
          (select 'event_id' as "column", 'IDENTIFIER_COLUMN_DETECTED' as class, count(event_id) > 0 as hit from t)
          union all (select 'user_id', 'IDENTIFIER_COLUMN_DETECTED', count(user_id) > 0 from t)
          union all (select 'account', 'POTENTIAL_IDENTIFIER',
            count(distinct account) > 0.995 * count(account) from t)
        ) s where hit
        """,
    ),
)
def identifiers_potential(spark, sf_dir):
    return identifiers.identifier_classes(fx.derived(spark, sf_dir, "events", EVENT_IDS))


ISSUES_SQL = f"""
 (select 'missing_values' as type, 'l_tax' as "column", count(*) - count(l_tax) as count,
    (count(*) - count(l_tax)) * 100.0e0 / count(*) as percentage from t) union all
 (select 'missing_values', 'l_returnflag', count(*) - count(l_returnflag),
    (count(*) - count(l_returnflag)) * 100.0e0 / count(*) from t) union all
 (select 'outliers', 'l_price', count(*) filter (where l_price < lower or l_price > upper),
    count(*) filter (where l_price < lower or l_price > upper) * 100.0e0 / count(l_price)
    from t, ({fences('l_price')}) f)
"""
ISSUE_COLUMNS = [
    *(c for c in fx.GAPS if c not in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_linenumber")),
    "l_quantity * l_quantity * l_quantity * l_quantity as l_price",
]
ISSUE_INPUT_SQL = fx.sql_from(ISSUE_COLUMNS, "lineitem")


def _found_issues(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", ISSUE_COLUMNS)
    return checks.detect_issues(df, "l_linestatus").where("type <> 'high_correlation'")


@query(
    "detect_issues",
    with_input(
        ISSUE_INPUT_SQL,
        f'select type, "column", count, round(percentage, 6) as percentage from ({ISSUES_SQL}) i',
    ),
)
def detect_issues(spark, sf_dir):
    return _found_issues(spark, sf_dir).select("type", "column", "count", r6("percentage"))


@query(
    "arbitrate",
    with_input(
        fx.LEAK_SQL,
        "select 'custom_rule_violation' as type, 'l_quantity' as \"column\","
        " count(*) filter (where l_quantity > 40) as count from t",
    ),
)
def arbitrate(spark, sf_dir):
    df = fx.derived(spark, sf_dir, "lineitem", fx.LEAK).drop("l_orderkey")
    rule = [{"column": "l_quantity", "type": "max", "value": 40}]
    found = checks.detect_issues(df, "l_returnflag", rule)
    return suggestions.arbitrate(found, outlier_percentage=1.0).select("type", "column", "count")


FORMATTED_SQL = with_input(
    ISSUE_INPUT_SQL,
    f"""
    , i as ({ISSUES_SQL}), s as (
      select i.*, count % 9 * 1.0e0 as impact from i
    )
    select type, "column", impact,
      case when impact > 5 then 'HIGH' when impact > 2 then 'MEDIUM' else 'LOW' end as severity,
      concat('+', cast(round(impact, 2) as varchar), '%') as impact_display,
      case when type = 'outliers'
        then concat('Outliers detected in ''', "column", ''' (', printf('%.1f', percentage), '% of data) impacting model stability')
        else concat('Missing values in ''', "column", ''' (', printf('%.1f', percentage), '%) affecting model reliability')
      end as description,
      case when type = 'outliers' then 'Remove or cap extreme values using IQR or Z-score'
        when "column" like '%price%' or "column" like '%age%' or "column" like '%amount%' then 'Use median imputation for robustness'
        else 'Impute missing values (mean/median/mode)' end as suggestion
    from s
    """.strip(),
).replace("t as (" + ISSUE_INPUT_SQL + ") ,", "t as (" + ISSUE_INPUT_SQL + "),")


def _with_impact(spark, sf_dir):
    return _found_issues(spark, sf_dir).withColumn("impact", (F.col("count") % 9).cast("double"))


@query("format_issues", FORMATTED_SQL)
def format_issues(spark, sf_dir):
    return suggestions.format_issues(_with_impact(spark, sf_dir)).select(
        "type", "column", "impact", "severity", "impact_display", "description", "suggestion"
    )


@query(
    "rank_issues",
    with_input(
        ISSUE_INPUT_SQL,
        f"""
        , i as (select type, "column", count % 9 * 1.0e0 as impact from ({ISSUES_SQL}) x)
        select type, "column", impact, round((select sum(impact) from i where impact > 0), 2) as total_impact
        from i
        """.strip(),
    ).replace(") ,", "),"),
)
def rank_issues(spark, sf_dir):
    formatted = suggestions.format_issues(_with_impact(spark, sf_dir))
    return suggestions.rank_issues(formatted).select("type", "column", "impact", "total_impact")


def _candidate_sql(c: str, numeric: bool, exact: bool, partial: bool) -> str:
    name_score = 0.4 if exact else 0.2 if partial else 0.0
    name_text = (
        "'Exact match with common ML label naming conventions.'"
        if exact
        else "'Partial match with common ML label naming conventions.'"
        if partial
        else "null"
    )
    wide = "case when d > 10 then 0.3 else 0 end" if numeric else "case when d > 2 and d < 20 then 0.2 else 0 end"
    wide_text = (
        "case when d > 10 then 'Continuous numeric variable with sufficient variance (regression-compatible).' end"
        if numeric
        else "case when d > 2 and d < 20 then 'Low cardinality categorical variable (multi-class classification).' end"
    )
    return f"""
    select {named(c)}, d as nunique, round(miss * 100, 1) as missing_pct,
      round(least(0.99, greatest(0.01, {name_score} + (case when d = 2 then 0.5 else 0 end)
        + (case when d = 2 and low > 0.1 then 0.1 else 0 end) + ({wide})
        - (case when miss > 0.2 then 0.2 else 0 end)))::double, 2) as score,
      coalesce(nullif(concat_ws(' ', {name_text},
        case when d = 2 then 'Binary distribution detected (standard classification target).' end,
        case when d = 2 and low > 0.1 then 'Classes are relatively balanced.'
             when d = 2 then 'Warning: Highly imbalanced binary classes.' end,
        {wide_text},
        case when miss > 0.2 then 'Warning: Contains >20% missing values. Requires imputation if selected.' end), ''),
        'Valid column but no specific ML target heuristics triggered.') as reason
    from (select count(*) as d, sum(n) as v, min(n) * 1.0e0 / sum(n) as low from
           (select {c}, count(*) as n from t where {c} is not null group by {c})) s,
         (select count(*) as n, (count(*) - count({c})) * 1.0e0 / count(*) as miss from t) r
    where miss <= 0.8 and not (d = n and n > 10)
    """


TARGET_COLUMNS = [
    "doc_id",
    "lang",
    "n_chars as price",
    "quality as label",
    "toxic as toxic_class",
    "case when doc_id % 3 = 0 then null else source end as source",
    "case when doc_id % 10 = 0 then n_chars end as mostly_missing",
]
TARGET_SQL = fx.sql_from(TARGET_COLUMNS, f"({fx.DOCS_LABELED_SQL}) d")
TARGET_FLAGS = {
    "doc_id": (True, False, False),
    "lang": (False, False, False),
    "price": (True, True, False),
    "label": (True, True, False),
    "toxic_class": (True, False, True),
    "source": (False, False, False),
    "mostly_missing": (True, False, False),
}


@query(
    "target_candidates",
    with_input(TARGET_SQL, union_all(lambda c: _candidate_sql(c, *TARGET_FLAGS[c]), list(TARGET_FLAGS))),
)
def target_candidates(spark, sf_dir):
    df = fx.docs_labeled(spark, sf_dir).selectExpr(*TARGET_COLUMNS)
    return targets.target_candidates(df).select(
        "column", "nunique", "missing_pct", "score", F.concat_ws(" ", "reason").alias("reason")
    )


PROXY_COLUMNS = ["l_extendedprice as price", "l_extendedprice * 3 as copy", "l_extendedprice as price_usd", "l_tax"]


def _proxy_sql(target: str, c: str) -> str:
    if target.replace("_", "") in c.replace("_", "") or c.replace("_", "") in target.replace("_", ""):
        return (
            f"(select '{target}' as target, '{c}' as proxy,"
            f" concat('Semantic overlap with target name (''{c}'' ~ ''{target}'').') as reason)"
        )
    return (
        f"(select '{target}' as target, '{c}' as proxy, concat('Extremely high mathematical correlation (',"
        f" printf('%.2f', abs(corr({target}, {c}))), ') with target. Likely a duplicate or data leakage.') as reason"
        f" from t having abs(corr({target}, {c})) > 0.95)"
    )


PROXY_NAMES = ["price", "copy", "price_usd", "l_tax"]


@query(
    "target_proxies",
    with_input(
        fx.sql_from(PROXY_COLUMNS, "lineitem"),
        " union all ".join(_proxy_sql(a, b) for a in PROXY_NAMES for b in PROXY_NAMES if a != b),
    ),
)
def target_proxies(spark, sf_dir):
    return targets.target_proxies(fx.derived(spark, sf_dir, "lineitem", PROXY_COLUMNS))
