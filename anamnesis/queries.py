"""All queries of the core and their SQL, collected from the modules of anamnesis.catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anamnesis.catalog import analytics, delivery, graph, lifecycle, retrieval, work, writes

_PARTS = (retrieval, analytics, lifecycle, graph, delivery, work, writes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _PARTS for k, q in m.SQL.items()}
