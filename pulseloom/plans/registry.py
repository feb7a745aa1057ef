"""Registered queries with the plain SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseloom.plans.adapters import Tables, expand

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
FRAGMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def load() -> None:
    from pulseloom.plans import (q_aggregates, q_expansion, q_filters, q_flow, q_joins, q_ranking, q_sessions, q_sets,  # noqa: F401
                                 q_signals, q_sources, q_text, q_vectors)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, folder, build=build: build(Tables(spark, folder))) for name, build in QUERIES.items()}


def oracle() -> dict[str, str]:
    load()
    return {name: expand(sql, FRAGMENTS) for name, sql in SQL.items()}
