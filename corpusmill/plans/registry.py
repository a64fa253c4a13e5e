"""Named queries of the core and, where SQL can express them, their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import snapshots
from corpusmill.plans import block_sql, checks, content, hierarchies, operations, records, retrieval, stores
from corpusmill.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.compare_snapshots(read_table(spark, base, "contract"), read_table(spark, base, "runs")).select(
        "run_id", "canonical_uri", "change_type"
    )


def p1_change_counts(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.change_counts(read_table(spark, base, "contract"), read_table(spark, base, "runs"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_change_counts": p1_change_counts} | content.QUERIES | retrieval.QUERIES | stores.QUERIES | hierarchies.QUERIES | records.QUERIES | checks.QUERIES | operations.QUERIES
SQL: dict[str, str] = {"p1_found": block_sql.P1_FOUND, "p1_change_counts": block_sql.P1_CHANGE_COUNTS} | content.SQL | retrieval.SQL | stores.SQL | hierarchies.SQL | records.SQL | checks.SQL | operations.SQL
