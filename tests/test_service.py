import json
import os

import pytest
from pyspark.sql import functions as F

from tallyweave.__main__ import main
from tallyweave.operators import documents, metrics, reporting, snapshots
from tallyweave.sources.tables import Scratch, project
from tallyweave.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_redaction_at_any_depth(spark):
    docs = [json.dumps({"a": {"Session_Token": {"b": 1}, "c": [{"description": None, "d": "é"}]}}), "no json", None, "[1, 2]", "3"]
    df = spark.createDataFrame([(t,) for t in docs], "t string")
    assert [r[0] for r in df.select(documents.redact_json(F.col("t"))).collect()] == ['{"a":{"Session_Token":"[REDACTED]","c":[{"description":"[REDACTED]","d":"é"}]}}', "no json", None, "[1,2]", "3"]
    deep = spark.createDataFrame([('{"a": [{"b": "]]["}], "c\\\\": 1}',), ("5",), (None,), ("",)], "t string")
    assert [r[0] for r in deep.select(documents.json_depth(F.col("t"))).collect()] == [3, 0, None, 0]


def test_ranks_of_skewed_groups(spark):
    rows = [("g", 7.0)] * 300 + [("g", float(i)) for i in range(100)] + [(None, 1.0), ("h", None), ("k", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in reporting.ranked_values(Scratch(spark, "t"), df, ["g"], "v", reporting.nearest_ranks(0.95)).collect()}
    values = sorted(v for g, v in rows if g == "g")
    assert (got["g"].rounded, got["g"].up, got["g"].cut) == (values[379],) * 3 and got[None].up == 1.0 and got["k"].cut == 2.0 and "h" not in got
    assert reporting.ranked_values(Scratch(spark, "t"), df.limit(0), ["g"], "v", reporting.nearest_ranks(0.5)).count() == 0


def test_snapshot_shows_a_change(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", [None, "x"])], "i int, s string, l array<string>")
    snapshots.snapshot({"t": df}, f"{tmp_path}/s")
    assert [tuple(r) for r in snapshots.verify(spark, f"{tmp_path}/s").collect()] == [("t", 2, True)]
    df.filter("i = 1").write.mode("overwrite").parquet(f"{tmp_path}/s/t")
    assert [tuple(r) for r in snapshots.verify(spark, f"{tmp_path}/s").collect()] == [("t", 2, False)]


def test_routes_numbers_and_alerts(spark):
    df = spark.createDataFrame([("/v1/batches/b-1/records?x=/v1", "2.500000", 3), ("/", "10.000000", 11), ("/x//v1/", "100", 0)], "p string, n string, r int")
    got = df.select(metrics.route_template(F.col("p")), metrics.number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("/v1/batches/{id}/records", "2.5"), ("/", "10"), ("/{id}/v1", "100")]
    inputs = {"service_up": "true", "ready": "false", "db_failures": "0", "audit_failures": "1", "processing_failures": "0", "server_error_ratio": "0.02d", "latency_p95_seconds": "cast(null as double)", "in_flight": "52", "in_flight_limit": "64", "backup_stale_seconds": "3601", "retries": "r"}
    rows = df.filter("r = 11").select(*[F.expr(v).alias(k) for k, v in inputs.items()])
    assert {r.alert for r in metrics.fired(rows).collect()} == {"ReadinessFailing", "AuditFailures", "RetryStorm", "Saturation", "BackupStale"}


def test_restarted_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(f"r{i}", i) for i in ids], "rid string, k long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest_once(ingest.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["rid"], "k")
    kept = lambda: sorted((r.rid, r.batch_n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows(1, 2)
    run()
    run()
    assert kept() == [("r1", 0), ("r2", 0)]
    rows(2, 3)
    run()
    assert kept() == [("r1", 0), ("r2", 0), ("r3", 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_command_line_and_names(spark, tmp_path, capsys):
    assert main(["list", SF, "--state", "partial"]) == 0
    assert json.loads(capsys.readouterr().out)["count"] > 0
    assert main(["run", SF, str(tmp_path), "watermark"]) == 0 and main(["run", SF, str(tmp_path), "nothing"]) == 1
    with pytest.raises(ValueError):
        project(spark, SF, "passwords")
