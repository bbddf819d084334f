"""All registered queries on the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.plans import ALL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in ALL for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in ALL for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "similarity_gate_verdicts"
