"""Structured Streaming versions of the incremental operators.

Late data is never dropped by a watermark here: deduplication goes through an anti join against the
stored table in each micro-batch, and aggregates are kept as mergeable partials.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.operators.late_events import Cutoffs, combine, merge_partials, partials
from tallyweave.operators.matching import next_versions
from tallyweave.operators.records import first_submissions
from tallyweave.sources.tables import DIVISIONS, WHOLE, Scratch, divided, shuffles_removed


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over the parquet files of a folder, with the folder's schema. files_per_batch: None for all that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, parts: int = 16) -> None:
    """Append each key's first submission to the table at ``target``; replays add nothing.

    The table is divided by a hash of the key, and a micro-batch is compared with the divisions that its
    own keys fall into, of which only the key columns are read. The batch id names the files of a
    micro-batch, so a batch that is repeated after a failure overwrites its own files: exactly once
    at the sink, whatever is lost. A table of more than ``parts`` times what a task reads wants more parts.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        fresh = first_submissions(batch, keys, order).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        new = fresh
        if _exists(spark, target):
            touched = [r[0] for r in fresh.select("part").distinct().collect()]  # at most ``parts`` numbers
            known = spark.read.parquet(target).filter(F.col("part").isin(touched) & (F.col("batch_n") < n)).select("part", *keys)
            new = fresh.join(known, ["part", *keys], "left_anti")
        new.repartition("part").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{target}/batch_n={n}")
        fresh.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulate_partials(stream: DataFrame, store: str, checkpoint: str, group: list[str], sums: dict, cut: Cutoffs = Cutoffs()) -> None:
    """Write the partials of each micro-batch of events (with day, slot and fate) as files of their own.

    Those of periods closed when they arrived are refused and go to ``<store>-refused``.
    """

    def write(batch: DataFrame, n: int) -> None:
        parts = partials(batch, group, sums).persist()
        taken, refused = merge_partials(parts.limit(0), parts, group, list(sums), cut)
        taken.write.mode("overwrite").parquet(f"{store}/batch_n={n}")
        refused.write.mode("overwrite").parquet(f"{store}-refused/batch_n={n}")
        parts.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_periods(spark: SparkSession, store: str, group: list[str], measures: list[str]) -> DataFrame:
    """Combine all partials on read; the refused ones count as dropped only."""
    return combine(spark.read.parquet(store).unionByName(spark.read.parquet(f"{store}-refused")), group, measures)


def fan_out(stream: DataFrame, checkpoint: str, sinks: dict) -> None:
    """Write every micro-batch as JSON lines to each folder whose condition holds for the row.

    A batch has its own folder in each sink, so that a repeated one replaces itself.
    """

    def write(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        for folder, condition in sinks.items():
            kept.filter(condition).write.mode("overwrite").json(f"{folder}/batch_n={n}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def limit_rate(stream: DataFrame, key: str, micros: str, id_: str, seconds: int, limit: int) -> DataFrame:
    """id, key, allowed of a stream in order of time: at most ``limit`` rows per key in windows that begin
    with the first row after the last. The state of a key is the start of its window and a count."""
    kind, idk = stream.schema[key].dataType.simpleString(), stream.schema[id_].dataType.simpleString()

    def walk(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["_us", id_])  # of one key in one micro-batch
        out = []
        for t in rows["_us"].tolist():
            if start is None or t - start >= seconds * 1_000_000:
                start, n = t, 0
            n += 1
            out.append(n <= limit)
        state.update((start, n))
        yield pd.DataFrame({id_: rows[id_], key: name[0], "allowed": out})

    kept = stream.filter(F.col(key).isNotNull() & F.col(micros).isNotNull()).select(key, id_, F.col(micros).alias("_us"))
    return kept.groupBy(key).applyInPandasWithState(walk, f"{id_} {idk}, {key} {kind}, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def version_decisions(stream: DataFrame, folder: str, checkpoint: str, decide, key: str = "rid", order: str = "k") -> None:
    """Records arrive; after each micro-batch all of them are decided anew and what changed is appended as versions.

    Nothing is ever dropped as too late, and no decision is rewritten: a late record supersedes. The
    records are at ``folder``/records, the versions (a, b, outcome, version, old_a, old_b, supersedes)
    at ``folder``/versions, each divided by micro-batch, so that a repeated one replaces itself.
    decide: Scratch, DataFrame of records -> a, b, outcome. What it puts there is deleted when the outcome is stored.
    """
    spark = stream.sparkSession
    records, versions = f"{folder}/records", f"{folder}/versions"

    def write(batch: DataFrame, n: int) -> None:
        known = spark.read.parquet(records).filter(F.col("batch_n") < n).select(key) if _exists(spark, records) else None
        parts = DIVISIONS if batch.count() > WHOLE else 1
        before = [None] * parts if known is None else divided(known, [key], parts)
        for i, (part, there) in enumerate(zip(divided(batch, [key], parts), before)):
            fresh = first_submissions(part, [key], order)
            fresh = fresh if there is None else fresh.join(there, key, "left_anti")
            with shuffles_removed(fresh):
                fresh.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(f"{records}/batch_n={n}")
        scratch, own = Scratch(spark, "versions"), Scratch(spark, "decide")
        now = decide(own, spark.read.parquet(records).filter(F.col("batch_n") <= n).drop("batch_n")).select("a", "b", "outcome")
        if _exists(spark, versions):
            old = current_flags(scratch, spark.read.parquet(versions).filter(F.col("batch_n") < n))
        else:
            old = spark.createDataFrame([], "a string, b string, outcome string, version int, current boolean")
        added = next_versions(scratch, old, now, made_in=own)
        with shuffles_removed(added):
            added.write.mode("overwrite").option("compression", "zstd").parquet(f"{versions}/batch_n={n}")
        scratch.clear()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_flags(scratch: Scratch, versions: DataFrame) -> DataFrame:
    """a, b, outcome, version, current of stored versions: those that none supersedes by its scope and number are current."""
    scope = lambda a, b: F.concat_ws("|", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    gone, seen = scratch.put_counted(versions.filter("version > 1").select(scope("old_a", "old_b").alias("k"), (F.col("version") - 1).alias("version"), F.lit(True).alias("gone")).distinct(), "gone")
    cols = ["a", "b", "outcome", F.col("version").cast("int").alias("version")]
    if not seen["n"]:
        return versions.select(*cols, F.lit(True).alias("current"))
    rows = versions.withColumn("k", scope("a", "b")).join(gone, ["k", "version"], "left")
    return scratch.put(rows.select(*cols, F.col("gone").isNull().alias("current")), "old")
