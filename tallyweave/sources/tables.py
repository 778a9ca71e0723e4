"""Reading the project's tables, and scratch tables that outlive executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory; only the columns used later are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables of a ledger that may be read by name.
ALLOWED = frozenset({"batches", "raw_records", "canonical_transactions", "match_candidates", "reconciliations", "sources", "discrepancies", "resolutions", "audit_events", "validation_results"})


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that is on the list; any other name is refused before anything is read."""
    if name not in ALLOWED:
        raise ValueError(f"unknown table {name!r}")
    return table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master (its tasks run in this process) gets a folder of its
    own; any other raises an error, as its executors couldn't read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ctx = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", ctx.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(ctx, "_tallyweave_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        ctx._tallyweave_dir = own
        ctx.setCheckpointDir(own)
        atexit.register(_remove_local, own)
    return own


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


#: Rows up to which a table is handled in one go, and the number of divisions of a larger one. The number is fixed, so that
#: scans grow with the table and not with its square.
WHOLE, DIVISIONS = 1_000_000, 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(df: DataFrame) -> Iterator[None]:
    """Shuffle files of what ``df`` runs within are deleted when it has run, instead of when the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


class Scratch:
    """Intermediate tables written to the shared folder.

    Writing cuts the lineage for good: a lost executor costs only the tasks in flight, because the
    finished table is files that every other executor can read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallyweave/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def put(self, df: DataFrame, name: str = "t", folder: str | None = None) -> DataFrame:
        """Write ``df`` and return the table read back. folder: a name for it that doesn't change."""
        self._n += 1
        path = f"{self.root}/{folder or f'{self._n:03d}-{name}'}"
        with shuffles_removed(df):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tallyweave_path = path
        return out

    def put_counted(self, df: DataFrame, name: str = "t", **counts) -> tuple[DataFrame, dict[str, int]]:
        """As :meth:`put`, with the number of rows (``n``) and other aggregates found while writing."""
        seen = Observation()
        rest = [c.alias(k) for k, c in counts.items()]
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n"), *rest), name)
        return out, seen.get

    def put_divisions(self, parts: Iterable[DataFrame], name: str = "t", **counts) -> tuple[DataFrame, dict[str, int]]:
        """As :meth:`put_counted` of tables of one schema, written one after the other as one table, so that only
        one's shuffle files lie on disk at a time. counts: sums and counts."""
        self._n += 1
        path, schema, rest = f"{self.root}/{self._n:03d}-{name}", None, [c.alias(k) for k, c in counts.items()]
        total = dict.fromkeys(["n", *counts], 0)
        for df in parts:
            seen, schema = Observation(), df.schema
            with shuffles_removed(df):
                df.observe(seen, F.count(F.lit(1)).alias("n"), *rest).write.mode("append").option("compression", "zstd").parquet(path)
            total = {k: v + (seen.get[k] or 0) for k, v in total.items()}
        out = self.spark.read.schema(schema).parquet(path)
        out._tallyweave_path = path
        return out, total

    def clear(self) -> None:
        """Delete all its tables, when no later step reads any."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete scratch tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_tallyweave_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], row_key, total: int, how: str = "inner", per_task: int = 1_000_000) -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique on ``keys``) although one key may hold a third of the rows.

    A key of more than ``per_task`` of the ``total`` rows is spread over as many salts as it has such
    portions. There are at most ``total / per_task`` <= 20,000 such keys, so the list of them is small
    enough to broadcast at every size; of a table of no more than ``per_task`` rows there are none, and
    it is joined as it is. Null keys match nothing. ``rows`` is read twice and should be a stored table.
    """
    per_task = max(per_task, total // 20_000)
    if total <= per_task:
        return rows.join(lookup, keys, how)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_task).select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias("_salts"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(row_key), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_keys(scratch: Scratch, rows: DataFrame, keys: list[str], per_task: int = 1_000_000) -> tuple[DataFrame | None, int]:
    """The keys of more than ``per_task`` rows (None if there are none), and the number of rows.

    Rows are counted by 65,536 hashes of their keys first; only those of a hash with so many rows are
    counted by key, so no shuffle has a row per key. There are at most 20,000 such keys.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(65_536)).alias("_h")
    sizes, seen = scratch.put_counted(rows.select(bucket).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "sizes", rows=F.sum("_n"), most=F.max("_n"))
    total = seen["rows"] or 0
    per_task = max(per_task, total // 20_000)
    if (seen["most"] or 0) <= per_task:
        return None, total
    full = rows.select(*keys, bucket).join(F.broadcast(sizes.filter(F.col("_n") > per_task).select("_h")), "_h")
    hot, found = scratch.put_counted(full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_task).select(*keys), "hot")
    return (hot if found["n"] else None), total


def divided(df: DataFrame, keys: list[str], parts: int) -> list[DataFrame]:
    """The rows of ``df`` by a hash of their keys."""
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == i) for i in range(parts)]
