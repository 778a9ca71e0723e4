"""Copies of tables with digests that prove them, and the signature of a whole database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, TimestampType

from tallyweave.operators.reporting import table_digest

# Columns that say when a row was written, which equal states may differ in.
WALL_CLOCK = ("created_at", "accepted_at", "received_at", "started_at", "completed_at", "copied_at")


def _plain(f: StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, ArrayType):
        return F.array_join(c, ",", "?")
    return F.unix_micros(c).cast("string") if isinstance(f.dataType, TimestampType) else c.cast("string")


def digest(name: str, df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """table_name, n_rows, digest over all columns but those left out, whatever the order of the rows."""
    fields = [f for f in df.schema.fields if f.name not in without]
    d = table_digest(df.select(*[_plain(f).alias(f.name) for f in fields]), [f.name for f in fields])
    return d.select(F.lit(name).alias("table_name"), "n_rows", F.concat_ws("-", "digest_1", "digest_2").alias("digest"))


def signature(tables: dict[str, DataFrame]) -> DataFrame:
    """The digest of each table without its wall-clock columns: equal for equal states, whenever made."""
    out = None
    for name, df in sorted(tables.items()):
        one = digest(name, df, WALL_CLOCK)
        out = one if out is None else out.unionByName(one)
    return out


def checksum(digests: DataFrame) -> DataFrame:
    """checksum: SHA-256 over the digests of all tables (one short line each) in the order of their names."""
    line = F.concat_ws(" ", "table_name", F.col("n_rows").cast("string"), "digest")
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("checksum"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a copy of each table and, last, the digests of what was copied."""
    done = None
    for name, df in sorted(tables.items()):
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        one = digest(name, df)
        done = one if done is None else done.unionByName(one)
    done.coalesce(1).write.parquet(f"{folder}/_digests")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, n_rows, ok: whether each table of a snapshot still has the digest it was written with."""
    stored = spark.read.parquet(f"{folder}/_digests")
    now = None
    for name in sorted(r.table_name for r in stored.select("table_name").collect()):  # one row per table
        one = digest(name, spark.read.parquet(f"{folder}/{name}"))
        now = one if now is None else now.unionByName(one)
    both = stored.withColumnRenamed("digest", "written").join(now.select("table_name", F.col("n_rows").alias("n"), "digest"), "table_name", "left")
    return both.select("table_name", "n_rows", (F.col("n").eqNullSafe(F.col("n_rows")) & F.col("digest").eqNullSafe(F.col("written"))).alias("ok"))


def missing_tables(spark: SparkSession, present: list[str], required: list[str]) -> DataFrame:
    """table_name of the required tables that aren't there."""
    return spark.createDataFrame([(n,) for n in sorted(set(required) - set(present))], "table_name string")
