from pyspark.sql import functions as F

from tallyweave.operators import copy_diff


def test_buckets_follow_the_larger_side(spark, monkeypatch):
    seen = []
    slim = copy_diff._slim

    def watch(pair, df, buckets, is_copy):
        seen.append(buckets)
        return slim(pair, df, buckets, is_copy)

    monkeypatch.setattr(copy_diff, "_slim", watch)
    copy = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("x").alias("note"), F.lit(1).alias("v"), F.lit(False).alias("gone"))
    out = copy_diff.copy_differences(spark, [copy_diff.CopyPair("t", copy.limit(0), copy, "k", {"note": "text"}, "v", "gone")])
    assert min(seen) * copy_diff.BUCKET_ROWS >= 3000
    assert out.filter("diff_kind = 'missing_in_original'").count() == out.count() == 3000
