"""All queries outside the llm part, and their SQL."""

from __future__ import annotations

from tallyweave.plans import common, data_quality, pipeline, reconciliation, service  # noqa: F401  (the plans register their queries)


def queries() -> dict:
    return data_quality.queries() | common.QUERIES


def oracle_sql() -> dict[str, str]:
    return data_quality.oracle_sql() | common.SQL
