"""Query registry: one entry per operator key of the survey inventory.

A plan module registers ``fn(spark, sf_dir) -> DataFrame`` under its key with
the equivalent DuckDB SQL (omitted for the rows-only operators).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

PLAN_MODULES = (
    "ferryman.plans.flagship",
    "ferryman.plans.corpus_q",
    "ferryman.plans.segment_q",
    "ferryman.plans.graph_q",
    "ferryman.plans.quality_q",
    "ferryman.plans.jobs_q",
    "ferryman.plans.etl_q",
    "ferryman.plans.sas_q",
    "ferryman.plans.cobol_q",
)


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn
    return deco


def _load() -> None:
    for m in PLAN_MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
