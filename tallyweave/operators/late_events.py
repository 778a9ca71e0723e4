"""Per-period aggregates by event time, corrected by late records until a cut-off.

A period is the UTC day of the event. It is first published ``publish_after`` hours after its end
and closed ``close_after`` hours after its end. Both cut-offs fall on whole hours, so records are
pre-aggregated per group, day and arrival hour; such partials say exactly what was known at each
cut-off, and merge by addition. Reading combines the partials that had arrived in time; merging adds
new partials and refuses those of closed periods. Every aggregate is decided per partial, so no step
gathers the records of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cutoffs:
    publish_after: int = 6
    close_after: int = 168

    def fate(self, day: Column, arrived: Column) -> Column:
        """``on_time``, ``late`` or ``dropped``; null if the day or the arrival isn't known."""
        end = F.unix_seconds(day.cast("timestamp")) + 86_400
        at = F.unix_seconds(arrived)
        return F.when(at >= end + self.close_after * 3600, "dropped").when(at >= end + self.publish_after * 3600, "late").when(at.isNotNull() & end.isNotNull(), "on_time")


def event_day(ts: Column) -> Column:
    """UTC day whatever the session's zone: days since 1970 from the instant."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def arrival_slot(ts: Column) -> Column:
    """The whole hour in which the record arrived."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)) * 3600)


def with_fate(events: DataFrame, event_time: str, arrived: str, cut: Cutoffs = Cutoffs()) -> DataFrame:
    """Add day, slot and fate; the fate of a record is that of its partial (day, slot).

    Null event times or arrivals give a null fate and are in no aggregate.
    """
    e = events.withColumns({"day": event_day(F.col(event_time)), "slot": arrival_slot(F.col(arrived))})
    return e.withColumn("fate", cut.fate(F.col("day"), F.col("slot")))


def partials(events: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Mergeable partial aggregates of the output of :func:`with_fate`; sums: name -> what is added up.

    The count is ``n``. Map-side combination leaves at most one row per group, day and hour in each
    map task, so a group with a third of all rows costs no more than any other.
    """
    return events.filter(F.col("fate").isNotNull()).groupBy(*group, "day", "slot", "fate").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def combine(parts: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Per group and day: each measure as first published, as corrected, and as refused."""
    out = []
    for m in ["n", *measures]:
        v = F.col(m)
        zero = F.lit(0).cast(parts.schema[m].dataType)
        pick = lambda c: F.coalesce(F.sum(F.when(c, v)), zero)
        out += [pick(F.col("fate") == "on_time").alias(f"{m}_published"), pick(F.col("fate") != "dropped").alias(f"{m}_corrected"), pick(F.col("fate") == "dropped").alias(f"{m}_dropped")]
    return parts.groupBy(*group, "day").agg(*out)


def merge_partials(store: DataFrame, arriving: DataFrame, group: list[str], measures: list[str], cut: Cutoffs = Cutoffs()) -> tuple[DataFrame, DataFrame]:
    """Add arriving partials to the store; those that arrived when their period was closed are refused.

    Gives (new store, refused). A partial's own arrival hour decides, not the time of merging, so
    merging in any order or grouping of batches gives the same store and the same refused partials.
    Refused ones carry the fate ``dropped`` and are counted by :func:`combine` when read with the store.
    """
    fate = cut.fate(F.col("day"), F.col("slot"))
    judged = arriving.withColumn("fate", fate)
    add = lambda df: df.groupBy(*group, "day", "slot", "fate").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    return add(store.unionByName(judged.filter("fate <> 'dropped'"))), add(judged.filter("fate = 'dropped'"))
