"""All queries over the test tables, with the SQL another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def _load() -> None:
    from . import q_composed, q_filters, q_governance, q_graph, q_metrics, q_more, q_oplog, q_retrieval, q_storage, q_sync, q_vectors  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_final_score"](spark, sf_dir)
