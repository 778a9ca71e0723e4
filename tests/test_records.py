import json

from pyspark.sql import functions as F

from tallyweave.operators import records
from tallyweave.operators.reporting import fixed_window_limiter, gapless_sequence, lineage


def test_errors_in_order(spark):
    rows = [
        {"zone": True, "direction": "credit", "currency": "EURO", "amount": "12.34567", "occurred_at": "2025-13-01", "record_id": " \t"},
        {"direction": "DEBIT", "currency": 978, "amount": {"v": "1"}, "occurred_at": None, "record_id": "X77"},
        {"record_id": "X78", "direction": "CREDIT", "currency": "CHF", "amount": "-0.5", "occurred_at": "2025-11-30"},
        {},
    ]
    texts = [json.dumps(r) for r in rows] + ["[1]", '{"record_id', None]
    df = spark.createDataFrame([(i, "source_a.v1", t) for i, t in enumerate(texts)] + [(9, "other", "{}")], "id int, schema_version string, payload string")
    got = {r["id"]: r["errors"] for r in records.validate(df).collect()}
    # Fixed value: the order of errors.
    assert got[0] == ["zone/unknown_field", "amount/amount", "currency/currency", "direction/direction", "occurred_at/date", "record_id/empty"]
    assert got[1] == ["amount/type", "currency/type", "occurred_at/type"]
    assert got[2] == [] and got[3] == [f"{k}/required" for k in ("amount", "currency", "direction", "occurred_at", "record_id")]
    assert got[4] == got[5] == got[6] == ["/object"] and got[9] == ["/unsupported_schema"]


def test_equal_contents_have_equal_fingerprints(spark):
    a = '{"b": "café\\r\\nx", "a": null}'
    b = '{"a":null,  "b":"café\\nx"}'
    df = spark.createDataFrame([(a,), (b,), ("[]",)], "payload string").select(records.canonical_json().alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":null,"b":"café\\nx"}'] * 2 + [None]


def test_correction_names_the_greatest_earlier_row(spark):
    rows = [("x1", 1, 5, "c1"), ("x2", 2, 9, "c2"), ("x3", 3, 7, "c3"), ("x4", 4, 1, "c2")]
    df = spark.createDataFrame([("s", *r) for r in rows], "s string, id string, seq int, t int, c string")
    got = {r["id"]: r["supersedes"] for r in records.correction_chain(df, ["s"], "t", "id", "seq", "c").collect()}
    assert got == {"x1": None, "x2": "x1", "x3": "x2", "x4": None}


def test_limiter_and_lineage(spark):
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate((0, 10, 50, 61, 62, 130))] + [(None, 5, 9)], "u int, s long, i int").select("u", (F.col("s") * 1_000_000).alias("us"), "i")
    got = {r["i"]: r["allowed"] for r in fixed_window_limiter(df, "u", "us", "i", 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    chain = spark.createDataFrame([(f"r{i}", f"r{i - 1}" if i else None) for i in range(20)] + [("q", "gone"), ("x", "y"), ("y", "x")], "k string, s string")
    got = {r["k"]: (r["root"], r["depth"]) for r in lineage(spark, chain, "k", "s").collect()}
    assert got["r19"] == ("r0", 19) and got["r0"] == ("r0", 0) and got["q"] == ("q", 0) and "x" not in got


def test_sequences_over_blocks(spark):
    rows = [("a" if i % 3 else None, i // 2, i) for i in range(100)]
    df = spark.createDataFrame(rows, "e string, t int, i int")
    got = {(r["e"], r["i"]): r["sequence"] for r in gapless_sequence(df, ["e"], ["t", "i"], F.floor(F.col("t") / 7)).collect()}
    for e in ("a", None):
        mine = [i for x, _, i in rows if x == e]
        assert [got[e, i] for i in mine] == list(range(1, len(mine) + 1))
    assert gapless_sequence(df.limit(0), ["e"], ["t"], F.col("t")).count() == 0
