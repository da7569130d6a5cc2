"""Sources, projections, profile and exploratory queries."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, table
from catalog.sqltext import (
    EVENTS_NUMERIC,
    LINEITEM_NUMERIC,
    ORDER,
    fences,
    mode_of,
    named,
    numeric_of,
    type_of,
    union_all,
    with_input,
)
from tablewarden.functions.runtime import ensure_checkpoint_dir
from tablewarden.operators import eda, identifiers, profile
from tablewarden.operators.values import distinct_summary, sample_values
from tablewarden.sources.reader import load_dataset


# Text of a JSON array that a task writes.
ARRAY_BYTES = 64 << 20


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(
    "scan_parquet",
    """
    select l_returnflag, l_linestatus, count(*) as row_count, round(sum(l_quantity), 2) as sum_qty
    from lineitem group by l_returnflag, l_linestatus
    """,
)
def scan_parquet(spark, sf_dir):
    df = load_dataset(spark, f"{sf_dir}/lineitem.parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("l_quantity"), 2).alias("sum_qty")
    )


@query(
    "scan_json",
    "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents",
)
def scan_json(spark, sf_dir):
    """All documents, written as JSON arrays over many lines, more of them the larger the table, and read back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).repartition(max(4, size // ARRAY_BYTES))
    path = f"{ensure_checkpoint_dir(spark)}/array-{uuid.uuid4().hex}.json"

    def array(batches):
        before = "["
        for texts in (b["value"] for b in batches if len(b)):
            yield pd.DataFrame({"value": [before + texts.iloc[0], *("," + t for t in texts.iloc[1:])]})
            before = ","
        yield pd.DataFrame({"value": [before.strip(",") + "]"]})

    dealt.mapInPandas(array, "value string").write.text(path)
    back = load_dataset(spark, path, schema="doc_id long, lang string, source string, n_chars long, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "drop_columns",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def drop_columns(spark, sf_dir):
    return profile.drop_columns(table(spark, sf_dir, "orders"), ["o_orderdate", "unknown"])


@query(
    "drop_empty_cols",
    with_input(fx.SPARSE_SQL, "select l_orderkey, l_quantity, l_tax, l_discount from t"),
)
def drop_empty_cols(spark, sf_dir):
    return profile.drop_empty_columns(fx.derived(spark, sf_dir, "lineitem", fx.SPARSE))


@query("drop_null_target", with_input(fx.GAPS_SQL, "select * from t where l_tax is not null"))
def drop_null_target(spark, sf_dir):
    return profile.drop_null_target(fx.lineitem_gaps(spark, sf_dir), "l_tax")


@query(
    "complete_cases",
    with_input(fx.GAPS_SQL, "select l_orderkey, l_tax, l_returnflag from t where l_tax is not null"),
)
def complete_cases(spark, sf_dir):
    df = fx.lineitem_gaps(spark, sf_dir)
    return profile.complete_cases(df).select("l_orderkey", "l_tax", "l_returnflag")


@query("drop_identifiers", "select c_nationkey, c_acctbal, c_mktsegment from customer")
def drop_identifiers(spark, sf_dir):
    return identifiers.drop_identifiers(table(spark, sf_dir, "customer"))


@query(
    "missing_values",
    with_input(
        fx.GAPS_SQL,
        "select * from ("
        + union_all(
            lambda c: f"select {named(c)}, count(*) - count({c}) as count,"
            f" round((count(*) - count({c})) * 100.0e0 / count(*), 6) as percentage from t",
            fx.LINEITEM,
        )
        + ") m where count > 0",
    ),
)
def missing_values(spark, sf_dir):
    return profile.missing_values(fx.lineitem_gaps(spark, sf_dir)).select("column", "count", r6("percentage"))


@query(
    "missingness",
    with_input(
        fx.GAPS_SQL,
        "select round(("
        + " + ".join(f"(count(*) - count({c}))" for c in fx.LINEITEM)
        + ") * 1.0e0 / (count(*) * 11), 6) as missingness_ratio from t",
    ),
)
def missingness(spark, sf_dir):
    return profile.missingness(fx.lineitem_gaps(spark, sf_dir)).select(r6("missingness_ratio"))


@query(
    "duplicate_ratio",
    with_input(
        fx.DUPS_SQL,
        "select round(((select count(*) from t) - (select count(*) from (select distinct * from t)))"
        " * 1.0e0 / (select count(*) from t), 6) as duplicate_ratio",
    ),
)
def duplicate_ratio(spark, sf_dir):
    return profile.duplicate_ratio(fx.lineitem_dups(spark, sf_dir)).select(r6("duplicate_ratio"))


@query("distinct_rows", with_input(fx.DUPS_SQL, "select distinct * from t"))
def distinct_rows(spark, sf_dir):
    return profile.distinct_rows(fx.lineitem_dups(spark, sf_dir))


@query(
    "unique_counts",
    with_input(
        fx.GAPS_SQL,
        union_all(lambda c: f"select {named(c)}, count(distinct {c}) as unique_count from t", fx.LINEITEM),
    ),
)
def unique_counts(spark, sf_dir):
    return profile.unique_counts(fx.lineitem_gaps(spark, sf_dir))


SAMPLE_SQL = union_all(
    lambda c: f"select {named(c)}, string_agg(cast({c} as varchar), '|' order by {c}) as sample_values from"
    f" (select distinct {c} from t where {c} is not null order by {c} limit 3)",
    ORDER["events"],
)


@query("sample_values", with_input("select * from events", SAMPLE_SQL))
def samples(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    rows = [(c, "|".join(v)) for c, v in sample_values(df).items()]
    return spark.createDataFrame(rows, "column string, sample_values string")


@query(
    "top_value",
    with_input(
        fx.GAPS_SQL,
        union_all(
            lambda c: f"select {named(c)}, cast({mode_of(c)} as varchar) as top_value",
            ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_tax"],
        ),
    ),
)
def top_value(spark, sf_dir):
    df = fx.lineitem_gaps(spark, sf_dir)
    names = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_tax"]
    return distinct_summary(df, names).select("column", "top_value")


PII_WHOLE_SQL = (
    "regexp_matches({c}, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')"
    " or regexp_matches({c}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$')"
    " or regexp_matches({c}, '^\\+?1?\\s*\\(?-*\\.*([0-9]{{3}})\\)?\\.*-*\\s*([0-9]{{3}})\\.*-*\\s*([0-9]{{4}})$')"
)
NUMBER_LIKE_SQL = "regexp_matches({c}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"


@query(
    "pii_warning",
    with_input(
        fx.DOCS_PII_SQL,
        union_all(
            lambda c: f"select {named(c)}, coalesce(bool_or({PII_WHOLE_SQL.format(c=c)}), false)"
            " as pii_warning from t",
            ["text", "lang", "source", "contact"],
        ),
    ),
)
def pii_warning(spark, sf_dir):
    return profile.pii_warning(fx.derived(spark, sf_dir, "documents", fx.DOCS_PII))


@query(
    "format_warning",
    with_input(
        fx.MIXED_TEXT_SQL,
        "select \"column\", v >= 10 and n > v * 0.8 and n < v as format_warning from ("
        + union_all(
            lambda c: f"select {named(c)}, count({c}) as v,"
            f" count(*) filter (where {NUMBER_LIKE_SQL.format(c=c)}) as n from t",
            ["mixed", "l_returnflag", "digits"],
        )
        + ") s",
    ),
)
def format_warning(spark, sf_dir):
    return profile.format_warning(fx.derived(spark, sf_dir, "lineitem", fx.MIXED_TEXT))


FLAGS = [
    "l_returnflag",
    "l_linestatus",
    "case when l_orderkey % 40 = 0 then 'rare' else 'usual' end as lopsided",
]


@query(
    "imbalance_warning",
    with_input(
        fx.sql_from(FLAGS, "lineitem"),
        "select \"column\", d between 2 and 20 and top * 1.0e0 / v > 0.95 as imbalance_warning from ("
        + union_all(
            lambda c: f"select {named(c)}, count(*) as d, max(n) as top, sum(n) as v from"
            f" (select {c}, count(*) as n from t where {c} is not null group by {c})",
            ["l_returnflag", "l_linestatus", "lopsided"],
        )
        + ") s",
    ),
)
def imbalance_warning(spark, sf_dir):
    return profile.imbalance_warning(fx.derived(spark, sf_dir, "lineitem", FLAGS))


def _dictionary_row(c: str) -> str:
    numeric = c in numeric_of("lineitem")
    counted = f"(select {c}, count(*) as n from t where {c} is not null group by {c})"
    text = f"cast({c} as varchar)"
    number = f"round(min({c}), 6), round(max({c}), 6), round(avg({c}), 4), cast(null as varchar), false, false"
    words = (
        f"cast(null as double), cast(null as double), cast(null as double), cast({mode_of(c)} as varchar),"
        f" coalesce(bool_or({PII_WHOLE_SQL.format(c=text)}), false),"
        f" count({c}) >= 10 and count(*) filter (where {NUMBER_LIKE_SQL.format(c=text)}) > count({c}) * 0.8"
        f" and count(*) filter (where {NUMBER_LIKE_SQL.format(c=text)}) < count({c})"
    )
    imbalance = (
        "false"
        if numeric
        else f"(select count(*) between 2 and 20 and max(n) * 1.0e0 / sum(n) > 0.95 from {counted})"
    )
    return (
        f"select {named(c)}, '{type_of('lineitem', c)}' as data_type, count(*) as rows,"
        f" count(*) - count({c}) as missing_count,"
        f" round((count(*) - count({c})) * 100.0e0 / count(*), 2) as missing_percentage,"
        f" count(distinct {c}) as unique_count,"
        f" (select string_agg(cast({c} as varchar), '|' order by {c}) from"
        f" (select distinct {c} from t where {c} is not null order by {c} limit 3)) as sample_values,"
        f" {number if numeric else words}, {imbalance} as imbalance_warning from t"
    )


@query(
    "data_dictionary",
    with_input(
        fx.GAPS_SQL,
        "select * from ("
        + union_all(_dictionary_row, fx.LINEITEM)
        + ') d("column", data_type, rows, missing_count, missing_percentage, unique_count, sample_values,'
        ' min, max, mean, top_value, pii_warning, format_warning, imbalance_warning)',
    ),
)
def data_dictionary(spark, sf_dir):
    found = profile.data_dictionary(fx.lineitem_gaps(spark, sf_dir))
    return found.drop("outlier_percentage").select(
        "column", "data_type", "rows", "missing_count", "missing_percentage", "unique_count",
        F.concat_ws("|", "sample_values").alias("sample_values"), r6("min"), r6("max"),
        F.round("mean", 4).alias("mean"), "top_value", "pii_warning", "format_warning", "imbalance_warning",
    )


def _histogram_sql(c: str) -> str:
    return (
        f"select {named(c)}, s.bin, round(lo + s.bin * ((hi - lo) / 10), 6) as lo,"
        " round(case when s.bin = 9 then hi else lo + (s.bin + 1) * ((hi - lo) / 10) end, 6) as hi,"
        f" (select count(*) from t where {c} is not null and"
        f" (s.bin = 0 or {c} >= lo + s.bin * ((hi - lo) / 10)) and"
        f" (s.bin = 9 or {c} < lo + (s.bin + 1) * ((hi - lo) / 10))) as count"
        f" from (select min({c})::double as lo, max({c})::double as hi from t) r,"
        " (select unnest(range(10)) as bin) s where hi > lo"
    )


@query("eda_histogram", with_input("select * from lineitem", union_all(_histogram_sql, LINEITEM_NUMERIC)))
def eda_histogram(spark, sf_dir):
    found = eda.histogram(table(spark, sf_dir, "lineitem"))
    return found.select("column", "bin", r6("lo"), r6("hi"), "count")


@query(
    "eda_value_counts",
    with_input(
        fx.GAPS_SQL,
        "select \"column\", position, value, count from ("
        + union_all(
            lambda c: f"select {named(c)}, row_number() over (order by count(*) desc, {c}) as position,"
            f" {c} as value, count(*) as count, count(*) over () as d from t where {c} is not null group by {c}",
            ["l_returnflag", "l_linestatus"],
        )
        + ") s where position <= 10 and d <= 50",
    ),
)
def eda_value_counts(spark, sf_dir):
    return eda.top_value_counts(fx.lineitem_gaps(spark, sf_dir))


def corr_sql(a: str, b: str) -> str:
    """Pairwise-complete Pearson correlation, NULL when undefined."""
    return f"case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end"


NAMES = LINEITEM_NUMERIC
CELLS = [(a, b) for a in NAMES for b in NAMES]


@query(
    "eda_correlation",
    with_input(
        fx.GAPS_SQL,
        " union all ".join(
            f"(select '{a}' as \"left\", '{b}' as \"right\","
            f" round({1.0 if a == b else f'coalesce({corr_sql(a, b)}, 0)'}, 6) as corr from t)"
            if a != b
            else f"(select '{a}' as \"left\", '{b}' as \"right\", 1.0::double as corr)"
            for a, b in CELLS
        ),
    ),
)
def eda_correlation(spark, sf_dir):
    return eda.correlation_matrix(fx.lineitem_gaps(spark, sf_dir)).select("left", "right", r6("corr"))


def _box_sql(c: str) -> str:
    return (
        f"select {named(c)}, round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as q1,"
        f" round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as q3,"
        f" round(max({c}), 6) as max, round(2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75), 6)"
        f" as lower_bound, round(2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25), 6)"
        " as upper_bound from t"
    )


@query("eda_boxplot", with_input(fx.GAPS_SQL, union_all(_box_sql, LINEITEM_NUMERIC)))
def eda_boxplot(spark, sf_dir):
    names = ["min", "q1", "median", "q3", "max", "lower_bound", "upper_bound"]
    found = eda.boxplot(fx.lineitem_gaps(spark, sf_dir))
    return found.select("column", *[r6(n) for n in names])


def _far_sql(c: str) -> str:
    return (
        f"select {named(c)}, position, round({c}, 6) as value from (select {c},"
        f" row_number() over (order by abs({c} - (select quantile_cont({c}, 0.5) from t)) desc, {c}) as position"
        f" from t, ({fences(c)}) f where {c} < lower or {c} > upper) s where position <= 100"
    )


@query("eda_outliers", with_input("select * from events", union_all(_far_sql, EVENTS_NUMERIC)))
def eda_outliers(spark, sf_dir):
    return eda.boxplot_outliers(table(spark, sf_dir, "events"), k=100).select("column", "position", r6("value"))


@query(
    "class_balance",
    """
    with c as (select event_type as class, count(*) as count from events group by event_type)
    select class, count, round(count * 1.0e0 / (select sum(count) from c), 6) as share,
      round((select min(count) from c) * 1.0e0 / (select sum(count) from c), 6) as min_share,
      round((select max(count) from c) * 1.0e0 / (select sum(count) from c), 6) as max_share
    from c
    """,
)
def class_balance(spark, sf_dir):
    found = eda.class_balance(table(spark, sf_dir, "events"), "event_type")
    return found.select("class", "count", r6("share"), r6("min_share"), r6("max_share"))
