"""Query registry: name -> builder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under its own name, with its oracle."""
    def add(f: Builder) -> Builder:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import alignment, etl, evaluation, signals, tokenisation  # noqa: F401


def queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["q01_symbolise"](spark, sf_dir)
