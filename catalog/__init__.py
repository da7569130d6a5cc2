"""Registered queries by topic."""

from __future__ import annotations

from importlib import import_module

from catalog.base import ORACLES, QUERIES

TOPICS = [
    "profile_queries",
    "check_queries",
    "drift_queries",
    "clean_queries",
    "outlier_queries",
    "leakage_queries",
    "governance_queries",
    "model_queries",
]


def _load() -> None:
    for topic in TOPICS:
        import_module(f"catalog.{topic}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
