import random
import time

from pyspark.sql import functions as F

from tallyweave.llm.link_groups import link_groups
from tallyweave.llm.nearest_time import match_nearest


def test_nearest_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(f"{s}{i:03d}", s, r.choice(["x", "x", "y", None]), r.choice([r.randrange(0, 400_000), r.randrange(0, 2_000)]) if r.random() < 0.97 else None, "clash") for s in "ab" for i in range(300)]
    rows += rows[:20] + [("b900", "b", "x", 5000, ""), ("b901", "b", "x", 5000, ""), ("b902", "b", "x", 5200, ""), ("a900", "a", "x", 5100, ""), ("a901", "a", "z", 1, "")]
    df = spark.createDataFrame(rows, "id string, side string, k string, s long, lo string").withColumn("t", F.timestamp_seconds("s"))
    got = {tuple(x) for x in match_nearest(spark, df.filter("side = 'a'"), df.filter("side = 'b'"), ["k"], "t", "id", 3600, 4).collect()}
    want = set()
    for i, s, k, t, _ in rows:
        near = [(abs(t - u), j) for j, z, q, u, _ in rows if z == "b" and q == k and u is not None and t is not None and abs(t - u) <= 3600] if s == "a" and k else []
        if near:
            want.add((i, min(near)[1]))
    assert got == want and ("a900", "b900") in got
    dense = {tuple(x) for x in match_nearest(spark, df.filter("side = 'a'"), df.filter("side = 'b'"), ["k"], "t", "id", 3600, 1, 3).collect()}
    assert dense == want
    assert match_nearest(spark, df.limit(0), df, ["k"], "t", "id", 3600).count() == 0


def test_one_dense_key_costs_in_proportion(spark):
    def seconds(n):
        side = lambda s, shift: spark.range(n).select(F.concat(F.lit(s), "id").alias("id"), F.lit("x").alias("k"), F.timestamp_micros(F.col("id") * 1_000 + shift).alias("t"))
        began = time.time()
        rows = match_nearest(spark, side("a", 0), side("b", 300), ["k"], "t", "id", 36 * 3600)
        assert rows.filter(F.substring("left_id", 2, 20) == F.substring("right_id", 2, 20)).count() == n
        return time.time() - began

    seconds(1_000)
    assert seconds(160_000) < 8 * seconds(20_000)


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def groups(spark, links, **k):
    rows = link_groups(spark, spark.createDataFrame([(a, b, "e") for a, b in links], "a string, b string, x string"), "a", "b", **k).collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1] for r in rows}


def test_chains_rings_stars_and_trees(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)] + [(f"r{i:02d}", f"r{(i + 1) % 17:02d}") for i in range(17)]
    links += [(f"t{i}", "hub") for i in range(60)] + [("t5", "u1"), ("u1", "u2"), ("s", "s"), (None, "q"), ("q2", None), ("n001", "n000"), ("n000", "n001"), ("r03", "w1"), ("w1", "w2")]
    assert groups(spark, links) == brute(links)
    assert groups(spark, []) == {}


def test_dense_core(spark):
    r = random.Random(8)
    links = [(f"d{r.randrange(40)}", f"d{r.randrange(40)}") for _ in range(220)] + [(f"v{r.randrange(150)}", f"v{r.randrange(150)}") for _ in range(150)]
    assert groups(spark, links) == brute(links)
