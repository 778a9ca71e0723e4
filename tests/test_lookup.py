from pyspark.sql import functions as F

from tallyweave.sources.tables import salted_lookup


def test_hot_keys_are_spread_and_give_the_same_rows(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 50}", 1000 + i) for i in range(200)] + [(None, 5000), ("gone", 5001)]
    left = spark.createDataFrame(rows, "k string, i long")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(60)] + [(None, 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "i", "v").collect()))
        for per_task in (20, 10_000):
            got = salted_lookup(left, right, ["k"], F.col("i"), len(rows), how, per_task)
            assert sorted(map(str, got.select("k", "i", "v").collect())) == want
    salted = salted_lookup(left, right, ["k"], F.col("i"), len(rows), "inner", 20)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
