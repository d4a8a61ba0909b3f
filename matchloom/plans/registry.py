"""All registered queries of the telemetry library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ingestion, lifecycle, operations, reporting, retention_graphs, statistics, streams  # noqa: F401
from .base import ORACLE_SQL, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
