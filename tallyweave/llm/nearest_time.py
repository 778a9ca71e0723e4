"""Pairing records with the nearest record in time by expanding rings.

Both sides are reduced to their distinct points (keys, time in microseconds). Level 0 cuts time into
fine buckets: within a bucket the neighbours of each left point come from one sort, and from the two
adjacent buckets only their last and their first right point can matter, so those are
pre-aggregated and joined by equality. What lies in the three buckets is then fully known; a nearest
point closer than the reach of the three buckets is proven and accepted. Unresolved left points go
to buckets of double width: their own bucket and its sibling were already seen, so again only the
extreme points of the two adjacent buckets are joined. It ends when the width reaches the tolerance.
No step forms all pairs of a key, and a frequent key is spread over its time buckets. The finest
width follows from the densest bucket, so a bucket's rows don't grow with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.sources.tables import Scratch


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def _nearest(t: Column, lo: Column, hi: Column) -> Column:
    """Distance to the nearer of the last point before and the first point after (either may be null)."""
    return F.least(t - lo, hi - t)


def _proven(d: Column, t: Column, width: int) -> Column:
    """Nothing nearer can lie outside the bucket of t and its two neighbours."""
    b = _bucket(t, width) * width
    return d < F.least(t - (b - width - 1), (b + 2 * width) - t)


def _levels(points: DataFrame, keys: list[str], t: str, tolerance: int, per_bucket: int, least: int) -> int:
    """The number of doublings from the finest width to the tolerance: at least ``least``, and so many
    that no bucket of the finest width has more than ``per_bucket`` points."""
    levels = least
    while True:
        width = max(1, -(-tolerance // 2 ** (levels - 1)))
        most = points.groupBy(*keys, _bucket(F.col(t), width).alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= per_bucket or width == 1:
            return levels
        levels += max(1, (most // per_bucket).bit_length() - 1)


def nearest_points(spark: SparkSession, left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, least_levels: int = 4, per_bucket: int = 2_000) -> DataFrame:
    """Distinct left points with ``lo`` and ``hi``: the times of their nearest right points.

    Of lo (at or before) and hi (after) only the nearer one is set, both if they are equally near.
    Left points with nothing within the tolerance, and null keys or times, are left out.
    """
    scratch = Scratch(spark, "rings")
    whole = [F.col(k).isNotNull() for k in [*keys, t]]
    points = lambda df: df.filter(reduce(lambda a, b: a & b, whole)).select(*keys, t).distinct()
    both = scratch.put(points(left).withColumn("side", F.lit(0)).unionByName(points(right).withColumn("side", F.lit(1))), "points")
    levels = _levels(both, keys, t, tolerance, per_bucket, least_levels)
    width = max(1, -(-tolerance // 2 ** (levels - 1)))
    # own bucket: the last right point at or before each left point, and the first at or after it; both
    # frames only grow from their start, so a bucket costs what its sorting costs
    own = both.withColumn("b", _bucket(F.col(t), width))
    right_t = F.when(F.col("side") == 1, F.col(t))
    until = lambda o: Window.partitionBy(*keys, "b").orderBy(o, F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = own.withColumn("lo", F.last(right_t, ignorenulls=True).over(until(F.col(t).asc()))).withColumn("hi", F.last(right_t, ignorenulls=True).over(until(F.col(t).desc())))
    seen = scratch.put(seen, "own-buckets")
    ends = scratch.put(seen.filter("side = 1").groupBy(*keys, "b").agg(F.min(t).alias("first"), F.max(t).alias("last")), "ends")
    open_ = seen.filter("side = 0").select(*keys, t, "lo", "hi")
    accepted = []
    for level in range(levels):
        bucket = _bucket(F.col(t), width)
        probe = open_.withColumn("probe", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("b", bucket + F.col("probe"))
        at = probe.join(ends, [*keys, "b"], "left").select(*keys, t, F.when(F.col("probe") == -1, F.coalesce("lo", "last")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("probe") == 1, F.coalesce("hi", "first")).otherwise(F.col("hi")).alias("hi"))
        one = at.groupBy(*keys, t).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
        d = _nearest(F.col(t), F.col("lo"), F.col("hi"))
        last = level == levels - 1
        done = scratch.put(one.withColumns({"d": d, "done": F.coalesce(_proven(d, F.col(t), width), F.lit(False))}), f"ring-{level}")
        accepted.append(done.filter(F.col("done") | F.lit(last)).filter(F.col("d") <= tolerance))
        if last:
            break
        open_ = done.filter(~F.col("done")).select(*keys, t, "lo", "hi")
        width *= 2
        ends = scratch.put(ends.groupBy(*keys, F.floor(F.col("b") / 2).cast("bigint").alias("b")).agg(F.min("first").alias("first"), F.max("last").alias("last")), f"ends-{level + 1}")
    out = reduce(DataFrame.unionByName, accepted)
    return out.select(*keys, t, F.when(F.col(t) - F.col("lo") == F.col("d"), F.col("lo")).alias("lo"), F.when(F.col("hi") - F.col(t) == F.col("d"), F.col("hi")).alias("hi"))


def match_nearest(spark: SparkSession, left: DataFrame, right: DataFrame, keys: list[str], time: str, id_: str, tolerance_s: int, least_levels: int = 4, per_bucket: int = 2_000) -> DataFrame:
    """left_id, right_id: each left row with the right row nearest in time among equal keys.

    Of equally near right rows the smallest id is taken; a right row can serve many left rows.
    Left rows with nothing within the tolerance (inclusive), or with a null key, time or id, are
    left out; repeated rows count once. Only id, keys and time of the inputs are used. There are at
    least ``least_levels`` rings, more where a bucket would have more than ``per_bucket`` points.
    """
    slim = lambda df, name: df.filter(F.col(id_).isNotNull() & F.col(time).isNotNull()).select(*keys, F.unix_micros(time).alias("t"), F.col(id_).alias(name))
    a, b = slim(left, "left_id"), slim(right, "right_id").groupBy(*keys, "t").agg(F.min("right_id").alias("right_id"))
    near = nearest_points(spark, a, b, keys, "t", tolerance_s * 1_000_000, least_levels, per_bucket)
    chosen = near.withColumn("rt", F.explode(F.array_compact(F.array("lo", "hi")))).join(b.withColumnRenamed("t", "rt"), [*keys, "rt"]).groupBy(*keys, "t").agg(F.min("right_id").alias("right_id"))
    return a.join(chosen, [*keys, "t"]).select("left_id", "right_id").distinct()
