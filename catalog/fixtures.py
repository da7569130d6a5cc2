"""Derived inputs, written once as select lists that both engines read.

The test tables have no missing values, so missing cells, copies and target copies are
planted here over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table

LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()

GAPS = [
    "case when l_orderkey % 7 = 0 then null else l_tax end as l_tax"
    if c == "l_tax"
    else "case when l_orderkey % 11 = 0 then null else l_returnflag end as l_returnflag"
    if c == "l_returnflag"
    else c
    for c in LINEITEM
]
SPARSE = [
    "l_orderkey",
    "l_quantity",
    "case when l_orderkey % 10 < 6 then null else l_tax end as l_tax",
    "case when l_orderkey % 2 = 0 then null else l_discount end as l_discount",
    "cast(null as double) as nothing",
]
LEAK = [
    "l_orderkey",
    "l_extendedprice",
    "l_extendedprice * 2 as leak",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
]
MIXED_TEXT = [
    "case when l_orderkey % 10 = 0 then 'n/a' else cast(l_partkey as varchar(20)) end as mixed",
    "l_returnflag",
    "cast(l_suppkey as varchar(20)) as digits",
]
CONSTANT = ["event_id", "value", "1.0e0 as one"]
RARE = ["event_id", "event_type", "value", "case when event_id % 50 = 0 then 1 else 0 end as rare"]
DOCS_PII = [
    "doc_id",
    "text",
    "lang",
    "source",
    "case when doc_id % 4 = 0 then concat('u', cast(doc_id as varchar(20)), '@example.com') end as contact",
]
SHIFTED = ["event_id", "user_id", "value * 1.5e0 + 10 as value"]
SPLIT_AT = "timestamp '2024-01-16 00:00:00'"


def sql_from(select_list: list[str], source: str) -> str:
    return f"select {', '.join(select_list)} from {source}"


def derived(spark: SparkSession, sf_dir: str, source: str, select_list: list[str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*select_list)


GAPS_SQL = sql_from(GAPS, "lineitem")
SPARSE_SQL = sql_from(SPARSE, "lineitem")
LEAK_SQL = sql_from(LEAK, "lineitem")
MIXED_TEXT_SQL = sql_from(MIXED_TEXT, "lineitem")
CONSTANT_SQL = sql_from(CONSTANT, "events")
RARE_SQL = sql_from(RARE, "events")
DOCS_PII_SQL = sql_from(DOCS_PII, "documents")
# Copies of a slice of rows are added; no row is left out.
DUPS_SQL = (
    f"select {', '.join(GAPS)} from lineitem union all "
    f"select {', '.join(GAPS)} from lineitem where l_orderkey % 13 = 0"
)
DOCS_LABELED_SQL = (
    "select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "from documents d join labels l on d.doc_id = l.doc_id"
)


def exact_mean(column: str, when: str = "true") -> Column:
    """Mean of the decimal values of a column. Sums of doubles depend on the order of rows, which decides ties of rules."""
    value = F.when(F.expr(when), F.col(column).cast("decimal(24,10)"))
    return F.sum(value).cast("decimal(24,10)") / F.count(value).cast("decimal(11,0)")


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lineitem", GAPS)


def lineitem_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_gaps(spark, sf_dir)
    return rows.unionByName(rows.where("l_orderkey % 13 = 0"))


def docs_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    edge = f"ts < {SPLIT_AT.replace('timestamp', 'timestamp_ntz')}"
    return events.where(edge).drop("ts"), events.where(f"not ({edge})").drop("ts")


def events_shift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reference, current = events_split(spark, sf_dir)
    return reference, current.selectExpr(*SHIFTED)


SPLIT_REFERENCE_SQL = f"select event_id, user_id, value from events where ts < {SPLIT_AT}"
SPLIT_CURRENT_SQL = f"select event_id, user_id, value from events where not (ts < {SPLIT_AT})"
SHIFT_CURRENT_SQL = sql_from(SHIFTED, f"({SPLIT_CURRENT_SQL}) s")
