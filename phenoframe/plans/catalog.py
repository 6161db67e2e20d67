"""The queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenoframe.plans import coded, evaluated, eventqueries, phenotyped, shapes, texts

_BOOKS = (coded.query, texts.query, shapes.query, evaluated.query, phenotyped.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for b in _BOOKS for name, q in b.queries.items()} | eventqueries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: s for b in _BOOKS for name, s in b.sql.items()} | eventqueries.SQL
