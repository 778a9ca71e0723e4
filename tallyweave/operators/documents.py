"""JSON documents: nested redaction, decoding, depth, and export lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that mark a key as sensitive, in exports and in telemetry.
EXPORT_TERMS = ("payload", "description", "secret", "token", "credential")
TELEMETRY_TERMS = ("password", "secret", "token", "credential", "authorization", "payload", "description")
HIDDEN = "[REDACTED]"


def _clean(value, terms: tuple[str, ...]):
    if isinstance(value, dict):
        return {k: HIDDEN if any(t in k.casefold() for t in terms) else _clean(v, terms) for k, v in value.items()}
    return [_clean(v, terms) for v in value] if isinstance(value, list) else value


def redact_json(text: Column, terms: tuple[str, ...] = EXPORT_TERMS) -> Column:
    """JSON text with every value hidden, at any depth, whose key contains one of the terms in any case.

    Written without spaces; text that is no JSON stays as it is, null stays null. Spark has no recursive
    expression, so this is Python in Arrow batches.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return None if t is None else json.dumps(_clean(json.loads(t), terms), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return t

        for b in batches:
            yield b.map(one, na_action="ignore")

    return run(text)


def decoded(text: Column, path: str) -> Column:
    """The text at a JSON path of a stored document; a document that is no JSON is passed through unchanged."""
    return F.when(F.try_parse_json(text).isNull(), text).otherwise(F.get_json_object(text, path))


def json_depth(text: Column) -> Column:
    """Greatest nesting of objects and arrays: 0 for a plain value, null for null. Brackets inside strings don't count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, c):
        now = s["now"] + F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda s: s["most"])


def export_lines(report: DataFrame, reconciliations: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """kind, id, document: the report, each decision and each discrepancy as a redacted JSON line.

    Each frame has a column ``id``; the other columns make the document. Columns whose name ends with
    ``_json`` are decoded and lose that ending.
    """
    out = None
    for kind, df in (("report", report), ("reconciliation", reconciliations), ("discrepancy", discrepancies)):
        name = lambda c: c.removesuffix("_json")
        parts = [F.try_parse_json(c).alias(name(c)) if c.endswith("_json") else F.col(c) for c in df.columns if c != "id"]
        one = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), redact_json(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).alias("document"))
        out = one if out is None else out.unionByName(one)
    return out
