"""Queries over the driver's tables and their SQL twins, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendlake.plans import analysis, digests, flows, live, payments, routes, texts

MODULES = (payments, texts, flows, analysis, digests, routes, live)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
