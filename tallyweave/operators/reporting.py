"""Current versions, audit trails, counters, reports, metrics and integrity checks."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.sources.tables import Scratch


def current_versions(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no row supersedes; a null is no reference, so this is an anti join and never NOT IN."""
    gone = rows.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def lineage(spark: SparkSession, rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """key, root, depth of every row by pointer doubling over supersession, in log2(depth) joins.

    A reference to a row that doesn't exist ends the chain there; rows in a ring are left out.
    """
    scratch = Scratch(spark, "lineage")
    known = rows.select(F.col(key).alias("up")).distinct().withColumn("ok", F.lit(True))
    at = scratch.put(rows.select(key, F.col(supersedes).alias("up")).distinct().join(known, "up", "left").select(key, F.when(F.col("ok"), F.col("up")).alias("up"), F.when(F.col("ok"), 1).otherwise(0).alias("depth"), F.when(F.col("ok"), F.col("up")).otherwise(F.col(key)).alias("root")), "chain")
    left = -1
    while (now := at.filter("up is not null").count()) not in (0, left):  # unchanged: only rings are left
        left = now
        to = at.select(F.col(key).alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        nxt = at.join(to, "up", "left").select(key, F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root"))
        at = scratch.put(nxt, "chain")
    return at.filter("up is null").select(key, "root", "depth")


def gapless_sequence(rows: DataFrame, entity: list[str], order: list[str], block: Column) -> DataFrame:
    """rows with ``sequence``: 1, 2, ... per entity by ``order``.

    ``block`` is an expression that never falls as the order rises (the hour of a time, a seq divided
    by a constant). Rows are numbered within blocks, and blocks are offset by the counts before them,
    so an entity with a third of all rows is sorted by many tasks. Null entities are one entity.
    """
    placed = rows.withColumn("_block", block)
    run = Window.partitionBy(*entity).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*entity, "_block").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_block").alias("_b"), *[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)], F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, e in enumerate(entity):
        same &= F.col(e).eqNullSafe(F.col(f"_e{i}"))
    number = F.row_number().over(Window.partitionBy(*entity, "_block").orderBy(*order)) + F.col("_before")
    return placed.join(before, same).withColumn("sequence", number.cast("bigint")).select(*rows.columns, "sequence")


def append_events(trail: DataFrame, events: DataFrame, entity: list[str], id_: str, order: list[str], block: Column) -> DataFrame:
    """events that the trail doesn't have by their id, with the sequence going on where it ended per entity."""
    new = events.dropDuplicates([id_]).join(trail.select(id_), id_, "left_anti")
    last = trail.groupBy(*entity).agg(F.max("sequence").alias("_last"))
    numbered = gapless_sequence(new, entity, order, block)
    same = functools.reduce(lambda x, y: x & y, [F.col(f"n.{e}").eqNullSafe(F.col(f"l.{e}")) for e in entity])
    return numbered.alias("n").join(last.alias("l"), same, "left").select(*[f"n.{c}" for c in events.columns], (F.col("n.sequence") + F.coalesce("_last", F.lit(0))).alias("sequence"))


def order_blocks(rows: DataFrame, order: str) -> Column:
    """A block number that never falls as ``order`` (a non-negative whole number) rises: as many blocks
    as a block has rows on the average, so neither blocks nor their list is too long for one task."""
    n, top = rows.agg(F.count(F.lit(1)), F.max(order)).first()
    blocks = math.isqrt(n or 0) + 1
    return F.floor(F.col(order).cast("double") * (blocks / ((top or 0) + 1)))


def ranked_values(scratch: Scratch, rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n and the values at the given ranks (1, 2, ... of n, as expressions over ``n``), exactly.

    Values are counted map-side and dealt out by range, so that neither a frequent value nor a group
    with most rows lies in one task; of each group only the range that holds a rank is walked. Null
    values are left out, null groups are a group, and a rank beyond the rows gives null.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    placed = scratch.put(counts.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(*group, "_p").agg(F.sum("_k").alias("_sum"))
    each = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_sum").over(each.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_sum").over(each)})
    for name, rank in ranks.items():
        parts = parts.withColumn(f"_r_{name}", rank)
    holds = lambda r: (F.col(f"_r_{r}") > F.col("_before")) & (F.col(f"_r_{r}") <= F.col("_before") + F.col("_sum"))
    held = parts.filter(functools.reduce(lambda x, y: x | y, map(holds, ranks)))
    same = functools.reduce(lambda x, y: x & y, [F.col(f"v.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group], F.col("v._p") == F.col("h._p"))
    walked = placed.alias("v").join(held.alias("h"), same).select("h.*", "v._k", F.col(f"v.{value}").alias("_v"))
    until = F.col("_before") + F.sum("_k").over(Window.partitionBy(*group, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    pick = lambda r: F.min(F.when(holds(r) & (F.col("_until") >= F.col(f"_r_{r}")), F.col("_v"))).alias(r)
    return walked.withColumn("_until", until).groupBy(*group).agg(F.max("n").alias("n"), *map(pick, ranks))


def nearest_ranks(q: float) -> dict[str, Column]:
    """The three ways in which a nearest rank is found: rounded half to even, rounded up, and cut off."""
    n, at = F.col("n"), F.lit(q) * F.col("n")
    inside = lambda r: F.greatest(F.lit(1), F.least(n, r.cast("bigint")))
    return {"rounded": inside(F.bround(at)), "up": inside(F.ceil(at)), "cut": inside(F.floor(at))}


def table_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows and two order-independent sums of 64-bit row hashes: equal tables have equal digests.

    Map-side aggregation sends one row per task; nothing is sorted or gathered.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    g = F.conv(F.substring(F.sha2(text, 256), 13, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest_1"), F.coalesce(F.sum(g), F.lit(0)).cast("string").alias("digest_2"))


def foreign_key_violations(name: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    missing = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_k")).distinct().join(parent.select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("reference"), "violations")


def redact(m: Column, terms: tuple[str, ...]) -> Column:
    """A map with the values hidden whose key contains one of the terms, in any case."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("|".join(terms)), "[REDACTED]").otherwise(v))


def cumulative_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """le, n: rows with value <= le, for each edge and infinity, from one pass and one row per task."""
    sums = df.agg(*[F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)], F.count(value).alias("binf"))
    pairs = [F.struct(F.lit(str(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("le"), F.col("binf").alias("n"))]
    return sums.select(F.inline(F.array(*pairs)))


def fixed_window_limiter(rows: DataFrame, key: str, micros: str, id_: str, seconds: int, limit: int) -> DataFrame:
    """id, allowed: at most ``limit`` rows per key in windows that begin with the first row after the last.

    Window starts depend on the data, so each key is walked in order. Partitions are sorted by Spark
    (spilling to disk) and walked batch by batch with one row of state: no key is ever held whole.
    """
    kind, idk = rows.schema[key].dataType.simpleString(), rows.schema[id_].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, n = None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b[key].tolist(), b["_us"].tolist()):
                if k != who or t - start >= seconds * 1_000_000:
                    who, start, n = k, t, 0
                n += 1
                out.append(n <= limit)
            yield pd.DataFrame({id_: b[id_], key: b[key], "allowed": out})

    ordered = rows.filter(F.col(key).isNotNull() & F.col(micros).isNotNull()).select(key, id_, F.col(micros).alias("_us")).repartition(key).sortWithinPartitions(key, "_us", id_)
    return ordered.mapInPandas(walk, f"{id_} {idk}, {key} {kind}, allowed boolean")
