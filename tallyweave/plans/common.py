"""Registering queries with their SQL, and tables that several of them read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reconciliations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key."""
    return table(spark, sf, "reconciliations").dropDuplicates(["reconciliation_id"])


CURRENT = "WITH r AS (SELECT DISTINCT * FROM reconciliations), cur AS (SELECT * FROM r WHERE reconciliation_id NOT IN (SELECT supersedes_reconciliation_id FROM r WHERE supersedes_reconciliation_id IS NOT NULL))"
