"""All queries of the record-linkage engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from linkwright.queries import decisions, diagnostics, plans, suites, texts
from linkwright.session import workers_can_import

MODULES = (decisions, texts, diagnostics, plans, suites)


def _ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(workers_can_import(spark), sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(plans.linkage_documents)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _ready(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
