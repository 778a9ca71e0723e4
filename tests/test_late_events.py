import itertools

from pyspark.sql import functions as F

from tallyweave.operators.late_events import combine, merge_partials, partials, with_fate

ROWS = [("a", "2026-01-01 10:00:00", "2026-01-01 11:00:00", 1), ("a", "2026-01-01 23:59:59", "2026-01-02 05:59:59", 2), ("a", "2026-01-01 00:00:00", "2026-01-02 06:00:00", 4), ("a", "2026-01-01 00:00:00", "2026-01-08 23:59:59", 8), ("a", "2026-01-01 00:00:00", "2026-01-09 00:00:00", 16), ("a", None, "2026-01-09 00:00:00", 32), ("a", "2026-01-01 00:00:00", None, 64), (None, "2026-01-01 00:00:00", "2026-01-01 00:00:00", None)]


def events(spark):
    return with_fate(spark.createDataFrame(ROWS, "g string, t string, r string, v int").select("g", F.col("t").cast("timestamp"), F.col("r").cast("timestamp"), "v"), "t", "r")


def test_cutoffs_and_sums(spark):
    p = partials(events(spark), ["g"], {"v": F.col("v")})
    r = combine(p, ["g"], ["v"]).filter("g = 'a'").first()
    assert (r.n_published, r.n_corrected, r.n_dropped) == (2, 4, 1)
    assert (r.v_published, r.v_corrected, r.v_dropped) == (3, 15, 16)
    assert combine(p, ["g"], ["v"]).filter("g is null").first().n_published == 1
    assert combine(p.limit(0), ["g"], ["v"]).count() == 0


def test_merging_in_any_order_is_merging_at_once_and_closed_periods_refuse(spark):
    e = events(spark)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    merge = lambda store, arriving: merge_partials(store, arriving, ["g"], ["v"])
    whole = partials(e, ["g"], {"v": F.col("v")})
    store, refused = merge(whole.limit(0), whole)
    assert refused.first().v == 16 and refused.first().fate == "dropped" and store.agg(F.sum("n")).first()[0] == 5
    parts = [partials(e.filter(c), ["g"], {"v": F.col("v")}) for c in ("v <= 2 or v is null", "v in (4, 16)", "v >= 8 and v <> 16")]
    for order in itertools.permutations(range(3)):
        kept, gone = whole.limit(0), whole.limit(0)
        for i in order:
            kept, dropped = merge(kept, parts[i])
            gone = gone.unionByName(dropped)
        assert rows(kept) == rows(store) and rows(gone) == rows(refused)
