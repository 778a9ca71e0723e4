from pyspark.sql import functions as F

from tallyweave.operators.late_events import with_fate
from tallyweave.streaming import ingest


def test_closed_periods_are_refused_by_the_stream(spark, tmp_path):
    rows = [("a", "2026-01-01 10:00:00", "2026-01-01 11:00:00", 1), ("a", "2026-01-01 00:00:00", "2026-01-08 23:59:59", 2), ("a", "2026-01-01 00:00:00", "2026-01-09 00:00:00", 4)]
    spark.createDataFrame(rows, "g string, t string, r string, v int").select("g", F.col("t").cast("timestamp"), F.col("r").cast("timestamp"), "v").repartition(3, "v").write.parquet(f"{tmp_path}/in")
    store = f"{tmp_path}/store"
    ingest.accumulate_partials(with_fate(ingest.file_stream(spark, f"{tmp_path}/in"), "t", "r"), store, f"{tmp_path}/checkpoint", ["g"], {"v": F.col("v")})
    assert spark.read.parquet(store).agg(F.sum("v")).first()[0] == 3
    assert spark.read.parquet(f"{store}-refused").agg(F.sum("v")).first()[0] == 4
    r = ingest.read_periods(spark, store, ["g"], ["v"]).first()
    assert (r.v_published, r.v_corrected, r.v_dropped) == (1, 3, 4)
