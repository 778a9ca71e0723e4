"""What lies on disk while decisions are made, and that divisions and hot keys change no result."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.operators import candidates as cand
from tallyweave.operators import matching
from tallyweave.sources.tables import Scratch


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def records(spark, r, s, n):
    refs = ["R1", "R2", "", None, None, None]
    rows = [(f"{s}{i}", s, datetime.date(2026, 9, r.randrange(1, 25)), Decimal(r.randrange(12)), r.choice(["EUR", "USD"]), r.choice(["DEBIT", "CREDIT"]), r.choice([*refs, *[f"Q{i}"] * 4, f"Q{i + 1}"])) for i in range(n)]
    return spark.createDataFrame(rows, "rid string, side string, d date, amt decimal(20,4), ccy string, dir string, ref string")


def by_proposals(a, b):
    """The decisions from all pairs, proposals and conflicts."""
    sel = matching.select_by_rule(cand.candidates(a, b)).cache()
    dup = {x.node for x in matching.conflicts(matching.proposals(sel)).collect()}
    good = [x for x in matching.pair_outcomes(matching.mutual(sel), a, b).collect() if x.a not in dup and x.b not in dup]
    want, used, n = {(x.outcome, x.a, x.b, x.rule) for x in good}, {y for x in good for y in (x.a, x.b)}, {x.node: x.n for x in sel.collect()}
    for x in a.unionByName(b).collect():
        if x.rid not in used:
            kind = "DUPLICATE" if x.rid in dup else "AMBIGUOUS" if n.get(x.rid, 0) > 1 else f"UNMATCHED_{x.side}"
            want.add((kind, x.rid, None, None) if x.side == "A" else (kind, None, x.rid, None))
    return want


def test_decisions_equal_those_by_proposals_with_and_without_hot_keys(spark):
    r = random.Random(3)
    a, b = records(spark, r, "A", 120).cache(), records(spark, r, "B", 110).cache()
    want = by_proposals(a, b)
    assert {x[0] for x in want} == {"MATCHED", "MISMATCHED", "DUPLICATE", "AMBIGUOUS", "UNMATCHED_A", "UNMATCHED_B"}
    for per_task in (1_000_000, 2):
        got = [tuple(x) for x in matching.decide(Scratch(spark, "t"), a, b, per_task=per_task).select("outcome", "a", "b", "rule").collect()]
        assert len(got) == len(want) and set(got) == want


def test_versions_in_divisions_are_the_same(spark):
    r = random.Random(4)
    a, b = records(spark, r, "A", 60).cache(), records(spark, r, "B", 60).cache()
    scratch = Scratch(spark, "t")
    one = scratch.put(matching.decide(scratch, a, b.filter("rid < 'B4'")).select("a", "b", "outcome", F.lit(1).alias("version"), F.lit(True).alias("current")))
    two = scratch.put(matching.decide(scratch, a, b).select("a", "b", "outcome"))
    rows = [sorted(map(str, matching.next_versions(scratch, one, two, whole).collect())) for whole in (1_000_000, 0)]
    assert rows[0] == rows[1] and any("version=2" in x for x in rows[0])


def test_steps_leave_no_shuffle_files(spark):
    a, b = (records(spark, random.Random(5), s, 50).cache() for s in "AB")
    a.count(), b.count()
    before, scratch = shuffle_files(spark), Scratch(spark, "t")
    one = scratch.put(matching.decide(scratch, a, b).select("a", "b", "outcome"))
    matching.next_versions(scratch, one.withColumns({"version": F.lit(1), "current": F.lit(True)}), one)
    assert shuffle_files(spark) <= before


def test_stream_of_versions_keeps_records_once(spark):
    import os

    import __spark_entry__ as entry

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/tallyweave"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    entry.queries()["stream_versions"](spark, "/root/testdata/sf0.001")
    (own,) = set(os.listdir(root)) - before
    assert own.startswith("versions-stream-") and sorted(os.listdir(f"{root}/{own}")) == ["checkpoint", "table"]
