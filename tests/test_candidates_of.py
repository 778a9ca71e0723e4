from tallyweave.operators import candidates as cand


def test_candidates_of_many_records_of_both_sides(spark):
    feed = "rid string, d date, amt decimal(20,4), ccy string, ref string"
    rows = lambda side, n: spark.createDataFrame([(f"{side}-{i}", None, None, "EUR", f"R{i // 2}") for i in range(n)], feed)
    targets = spark.createDataFrame([("A-0",), ("A-4",), ("B-5",), ("B-5",), ("C-1",)], "rid string")
    got = [(r.a, r.b) for r in cand.candidates_of(targets, rows("A", 8), rows("B", 8)).collect()]
    assert sorted(got) == [("A-0", "B-0"), ("A-0", "B-1"), ("A-4", "B-4"), ("A-4", "B-5"), ("A-5", "B-5")]
