"""Counters, histograms and gauges as text lines, labels, and alert rules over one row of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper limits of the latency histogram in seconds, path words that are no ids, length of a label.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
ROUTE_WORDS = ["v1", "health", "ready", "metrics", "batches", "records", "sources", "reports", "reconciliations", "discrepancies", "audit", "export", "resolve"]
MAX_LABEL = 96
# The alert rules, over the columns of the inputs.
ALERTS = {
    "ServiceDown": "not service_up",
    "ReadinessFailing": "not ready",
    "DatabaseFailures": "db_failures > 0",
    "AuditFailures": "audit_failures > 0",
    "ProcessingFailures": "processing_failures > 0",
    "RetryStorm": "retries > 10",
    "ServerErrorRatio": "server_error_ratio > 0.02",
    "LatencyHigh": "latency_p95_seconds > 1.0",
    "Saturation": "in_flight > 0.8 * greatest(in_flight_limit, 1)",
    "BackupStale": "backup_stale_seconds > 3600",
}


def route_template(path: Column) -> Column:
    """The path without its query, with every segment that isn't a known word as {id}."""
    segments = F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.isin(*ROUTE_WORDS), s).otherwise("{id}")), "/"))


def label_value(text: Column) -> Column:
    """At most 96 characters, with quotes, backslashes and line breaks as underscores."""
    return F.regexp_replace(F.substring(text, 1, MAX_LABEL), r'[\\"\n\r\t]', "_")


def number(value: Column) -> Column:
    """A decimal as text: without a point if it is whole, else without trailing zeros."""
    t = value.cast("string")
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def labels(*names: str, le: str | None = None) -> Column:
    parts = [F.concat(F.lit(f'{n}="'), label_value(F.coalesce(F.col(n).cast("string"), F.lit("None"))), F.lit('"')) for n in sorted(names)]
    parts += [F.lit(f'le="{le}"')] if le else []
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")


def counter_lines(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """line: the rows of each label set, counted map-side."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(F.concat(F.lit(name), labels(*by), F.lit(" "), F.col("_n").cast("string")).alias("line"))


def histogram_lines(df: DataFrame, name: str, by: list[str], seconds: Column) -> DataFrame:
    """line: cumulative buckets, sum (to microseconds) and count of each label set, in one pass."""
    v = F.col("_v")
    per = df.select(*by, seconds.alias("_v")).filter(v.isNotNull()).groupBy(*by).agg(*[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BUCKETS)], F.count(v).alias("_n"), F.sum(F.round(v * 1_000_000).cast("decimal(38,0)")).alias("_sum"))
    text = lambda b: str(int(b)) if float(b).is_integer() else repr(float(b))
    buckets = [F.concat(F.lit(f"{name}_bucket"), labels(*by, le=text(b)), F.lit(" "), F.col(f"_b{i}").cast("string")) for i, b in enumerate(LATENCY_BUCKETS)]
    rest = [F.concat(F.lit(f"{name}_bucket"), labels(*by, le="+Inf"), F.lit(" "), F.col("_n").cast("string")), F.concat(F.lit(f"{name}_sum"), labels(*by), F.lit(" "), number((F.col("_sum") / F.lit(1_000_000).cast("decimal(38,0)")).cast("decimal(38,6)"))), F.concat(F.lit(f"{name}_count"), labels(*by), F.lit(" "), F.col("_n").cast("string"))]
    return per.select(F.explode(F.array(*buckets, *rest)).alias("line"))


def fired(inputs: DataFrame) -> DataFrame:
    """alert: the rules that hold for a row of inputs, of each of its rows; null inputs fire nothing."""
    return inputs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("alert"), F.expr(v).alias("_fired")) for k, v in ALERTS.items()]))).filter("_fired").select("alert")
