"""Pieces of SQL text shared by the oracle queries."""

from __future__ import annotations

from collections.abc import Callable

SCHEMAS = {
    "lineitem": {
        "bigint": ["l_orderkey", "l_partkey", "l_suppkey"],
        "int": ["l_linenumber"],
        "double": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        "string": ["l_returnflag", "l_linestatus"],
        "timestamp_ntz": ["l_shipdate"],
    },
    "events": {
        "bigint": ["event_id", "user_id"],
        "double": ["value"],
        "string": ["event_type", "props"],
        "timestamp_ntz": ["ts"],
    },
    "customer": {
        "bigint": ["c_custkey"],
        "int": ["c_nationkey"],
        "double": ["c_acctbal"],
        "string": ["c_name", "c_mktsegment"],
    },
    "part": {
        "bigint": ["p_partkey"],
        "int": ["p_size"],
        "double": ["p_retailprice"],
        "string": ["p_name", "p_brand", "p_type"],
    },
    "documents": {"bigint": ["doc_id", "n_chars"], "string": ["text", "lang", "source"]},
}
ORDER = {
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split(),
    "events": "event_id ts user_id event_type value props".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
    "documents": "doc_id text lang source n_chars".split(),
}
LINEITEM_NUMERIC = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
)
EVENTS_NUMERIC = ["event_id", "user_id", "value"]


def numeric_of(table: str) -> list[str]:
    numeric = {c for t in ("int", "bigint", "double") for c in SCHEMAS[table].get(t, [])}
    return [c for c in ORDER[table] if c in numeric]


def text_of(table: str) -> list[str]:
    return [c for c in ORDER[table] if c in SCHEMAS[table]["string"]]


def type_of(table: str, column: str) -> str:
    return next(t for t, names in SCHEMAS[table].items() if column in names)


def union_all(make: Callable[[str], str], columns: list[str]) -> str:
    return " union all ".join(f"({make(c)})" for c in columns)


def named(column: str) -> str:
    return f"'{column}' as \"column\""


def with_input(source: str, body: str) -> str:
    """Run ``body`` over a named input ``t``."""
    return f"with t as ({source}) {body}"


def mode_of(column: str, source: str = "t") -> str:
    return (
        f"(select {column} from {source} where {column} is not null "
        f"group by {column} order by count(*) desc, {column} asc limit 1)"
    )


def fences(column: str, source: str = "t") -> str:
    """``lower`` and ``upper`` of one column."""
    return (
        f"select q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from "
        f"(select quantile_cont({column}, 0.25) as q1, quantile_cont({column}, 0.75) as q3 from {source})"
    )
