"""Queries of reports, exports, snapshots, metrics and alerts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import candidates as cand
from tallyweave.operators import documents, metrics, reporting, snapshots
from tallyweave.plans import pipeline
from tallyweave.plans import reconciliation as rec
from tallyweave.plans.common import CURRENT, query, reconciliations
from tallyweave.sources.tables import Scratch, project, table
from tallyweave.streaming import ingest

SCOPE = ("source-a", "source-b")

# reports and scans -----------------------------------------------------------------------------------


@query("SELECT batch_id, state, received_count FROM batches WHERE source_id = 'source-a' ORDER BY received_at, batch_id")
def batches_of_source(spark, sf):
    """In the order of their reception."""
    return project(spark, sf, "batches").filter("source_id = 'source-a'").orderBy("received_at", "batch_id").select("batch_id", "state", "received_count")


@query("SELECT batch_id, source_id FROM batches ORDER BY received_at DESC, batch_id DESC LIMIT 5")
def latest_batches(spark, sf):
    return project(spark, sf, "batches").orderBy(F.desc("received_at"), F.desc("batch_id")).limit(5).select("batch_id", "source_id")


@query("SELECT canonical_id, normalization_version FROM (SELECT DISTINCT canonical_id, normalization_version, canonical_version FROM canonical_transactions) ORDER BY canonical_version DESC, canonical_id LIMIT 1")
def latest_canonical(spark, sf):
    """The one row that comes first."""
    return project(spark, sf, "canonical_transactions").select("canonical_id", "normalization_version", "canonical_version").distinct().orderBy(F.desc("canonical_version"), "canonical_id").limit(1).drop("canonical_version")


@query("SELECT reconciliation_id, state FROM (SELECT DISTINCT reconciliation_id, state FROM reconciliations) ORDER BY state DESC, reconciliation_id LIMIT 20")
def user_sorted(spark, sf):
    """A page in the order a user chose."""
    return reconciliations(spark, sf).orderBy(F.desc("state"), "reconciliation_id").limit(20).select("reconciliation_id", "state")


@query("SELECT batch_id, raw_record_id FROM raw_records GROUP BY ALL")
def records_of_batches(spark, sf):
    """The link table: every batch with the records it brought."""
    return project(spark, sf, "raw_records").select("batch_id", "raw_record_id").distinct()


@query("SELECT source_id, schema_version, source_record_id, raw_record_id, min(seq) seq FROM raw_records WHERE source_record_id IS NOT NULL GROUP BY ALL")
def records_of_native_ids(spark, sf):
    return project(spark, sf, "raw_records").filter("source_record_id is not null").groupBy("source_id", "schema_version", "source_record_id", "raw_record_id").agg(F.min("seq").alias("seq"))


@query("SELECT c.canonical_id, r.raw_record_id, r.batch_id, b.source_id, b.state batch_state FROM (SELECT DISTINCT canonical_id, raw_record_id FROM canonical_transactions) c JOIN (SELECT raw_record_id, arg_min(batch_id, seq) batch_id FROM raw_records GROUP BY 1) r USING (raw_record_id) JOIN batches b USING (batch_id)")
def record_lineage(spark, sf):
    """Each canonical transaction with its raw record and the batch that first brought it."""
    raw = project(spark, sf, "raw_records").groupBy("raw_record_id").agg(F.min_by("batch_id", "seq").alias("batch_id"))
    can = project(spark, sf, "canonical_transactions").select("canonical_id", "raw_record_id").distinct()
    return can.join(raw, "raw_record_id").join(project(spark, sf, "batches").select("batch_id", "source_id", F.col("state").alias("batch_state")), "batch_id").select("canonical_id", "raw_record_id", "batch_id", "source_id", "batch_state")


@query(f"{pipeline._OPEN} SELECT discrepancy_id, dq.reconciliation_id, b.source_id FROM dq JOIN r USING (reconciliation_id) JOIN batches b ON b.batch_id = r.batch_id WHERE b.source_id IN ('source-a', 'source-b')")
def scoped_discrepancies(spark, sf):
    """Discrepancies of two sources: by their decision, and by its batch."""
    own = reconciliations(spark, sf).select("reconciliation_id", "batch_id").join(project(spark, sf, "batches").filter(F.col("source_id").isin(*SCOPE)).select("batch_id", "source_id"), "batch_id")
    return pipeline.open_discrepancies(spark, sf).drop("batch_id").join(own, "reconciliation_id").select("discrepancy_id", "reconciliation_id", "source_id")


@query(f"{pipeline._OPEN} SELECT discrepancy_id FROM dq WHERE reconciliation_id IN (SELECT reconciliation_id FROM r WHERE batch_id = (SELECT min(batch_id) FROM batches))")
def discrepancies_of_batch(spark, sf):
    of = project(spark, sf, "batches").agg(F.min("batch_id").alias("batch_id"))
    mine = reconciliations(spark, sf).join(of, "batch_id", "left_semi").select("reconciliation_id")
    return pipeline.open_discrepancies(spark, sf).join(mine, "reconciliation_id", "left_semi").select("discrepancy_id")


@query(f"{pipeline._OPEN} SELECT coalesce(b.source_id, '?') source_id, count(*) reconciliations, CAST(count_if(r.reconciliation_id IN (SELECT reconciliation_id FROM cur)) AS BIGINT) current_reconciliations, count(dq.discrepancy_id) discrepancies FROM r LEFT JOIN batches b ON b.batch_id = r.batch_id LEFT JOIN dq ON dq.reconciliation_id = r.reconciliation_id GROUP BY 1")
def report_totals(spark, sf):
    """Decisions, current ones and their discrepancies, by source."""
    r = reconciliations(spark, sf).select("reconciliation_id", "batch_id", "supersedes_reconciliation_id")
    gone = r.filter("supersedes_reconciliation_id is not null").select(F.col("supersedes_reconciliation_id").alias("reconciliation_id"), F.lit(1).alias("gone")).distinct()
    all_ = r.join(gone, "reconciliation_id", "left").join(pipeline.open_discrepancies(spark, sf).select("reconciliation_id", "discrepancy_id"), "reconciliation_id", "left").join(project(spark, sf, "batches").select("batch_id", "source_id"), "batch_id", "left")
    return all_.groupBy(F.coalesce("source_id", F.lit("?")).alias("source_id")).agg(F.count(F.lit(1)).alias("reconciliations"), F.count_if(F.col("gone").isNull()).alias("current_reconciliations"), F.count("discrepancy_id").alias("discrepancies"))


@query("SELECT source_id, list_sort(list_distinct(list(CASE WHEN invalid_reason IS NULL THEN 'accepted' ELSE invalid_reason END))) kinds FROM raw_records GROUP BY 1".replace("list_sort(list_distinct(list(CASE WHEN invalid_reason IS NULL THEN 'accepted' ELSE invalid_reason END))) kinds", "array_to_string(list_sort(list_distinct(list(coalesce(invalid_reason, 'accepted')))), ',') kinds"))
def event_kinds(spark, sf):
    """The kinds of event each source has, sorted, each once."""
    per = project(spark, sf, "raw_records").groupBy("source_id", F.coalesce("invalid_reason", F.lit("accepted")).alias("kind")).agg(F.lit(1))
    return per.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(f"{rec._FEEDS}{rec._CAND}, n AS (SELECT rid, count(*) n FROM (SELECT a rid FROM cand UNION ALL SELECT b FROM cand) GROUP BY rid) SELECT rid, side, coalesce(n, 0) n FROM (SELECT rid, side FROM ca UNION ALL SELECT rid, side FROM cb) x LEFT JOIN n USING (rid)")
def candidates_per_target(spark, sf):
    """Candidates of every record, zeros included, without forming the pairs."""
    return cand.hits(*rec._nodes(spark, sf)).select("rid", "side", (F.col("nref") + F.col("namt") - F.col("nboth")).alias("n"))


@query("SELECT DISTINCT reconciliation_id, CASE WHEN outcome IS NOT NULL THEN concat(upper(outcome[1]), lower(replace(outcome, '_', ' '))[2:]) END label, concat(reconciliation_id[1:22], '…', reconciliation_id[-6:]) short_id FROM reconciliations")
def display_labels(spark, sf):
    """Outcomes as words and ids cut in the middle."""
    words = F.lower(F.replace(F.col("outcome"), F.lit("_"), F.lit(" ")))
    return reconciliations(spark, sf).select("reconciliation_id", F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100)).alias("label"), F.concat(F.substring("reconciliation_id", 1, 22), F.lit("…"), F.right("reconciliation_id", F.lit(6))).alias("short_id"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) customer, o_orderpriority priority FROM orders")
def query_parameters(spark, sf):
    """Parameters of encoded addresses, decoded."""
    url = F.concat(F.lit("http://h/v1/orders?customer="), F.col("o_custkey").cast("string"), F.lit("&priority="), F.url_encode("o_orderpriority"))
    part = lambda k: F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k)))
    return table(spark, sf, "orders").select("o_orderkey", part("customer").alias("customer"), part("priority").alias("priority"))


# documents -------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT reconciliation_id, CASE WHEN json_valid(evidence) THEN evidence->>'$.outcome' ELSE evidence END evidence_outcome, CASE WHEN json_valid(evidence) THEN evidence->>'$.rule_version' ELSE evidence END evidence_rule FROM reconciliations""")
def decoded_evidence(spark, sf):
    e = F.col("evidence")
    return reconciliations(spark, sf).select("reconciliation_id", documents.decoded(e, "$.outcome").alias("evidence_outcome"), documents.decoded(e, "$.rule_version").alias("evidence_rule"))


@query(f"""{pipeline._OPEN}, q AS (SELECT count(*) n, CAST(count_if(reconciliation_id IN (SELECT reconciliation_id FROM cur)) AS BIGINT) m FROM r)
SELECT 'report' kind, 'all' id, concat('{{"reconciliation_count":', n, ',"current_reconciliation_count":', m, ',"discrepancy_count":', (SELECT count(*) FROM dq), '}}') "document" FROM q
UNION ALL SELECT 'reconciliation', reconciliation_id, concat('{{"outcome":', coalesce(to_json(outcome)::VARCHAR, 'null'), ',"state":"', state, '","evidence":', evidence, ',"payload":"[REDACTED]"}}') FROM r
UNION ALL SELECT 'discrepancy', discrepancy_id, concat('{{"reconciliation_id":"', reconciliation_id, '","outcome":"', outcome, '","detail":{{"Description":"[REDACTED]","version":', ver, '}}}}') FROM dq""")
def export_document(spark, sf):
    """Report, decisions and discrepancies as lines; nested values under sensitive keys are hidden."""
    r = Scratch(spark, "export").put(reconciliations(spark, sf), "all")
    cur = reporting.current_versions(r, "reconciliation_id", "supersedes_reconciliation_id")
    d = pipeline.open_discrepancies(spark, sf)
    count = lambda df, name: df.agg(F.lit("all").alias("id"), F.count(F.lit(1)).alias(name))  # noqa: E731  (one row each)
    n = count(r, "reconciliation_count").join(count(cur, "current_reconciliation_count"), "id").join(count(d, "discrepancy_count"), "id")
    rows = r.select(F.col("reconciliation_id").alias("id"), "outcome", "state", F.col("evidence").alias("evidence_json"), F.struct("batch_id").alias("payload"))
    return documents.export_lines(n, rows, d.select(F.col("discrepancy_id").alias("id"), "reconciliation_id", "outcome", F.struct(F.col("batch_id").alias("Description"), "version").alias("detail")))


@query("SELECT event_id, concat('{\"name\":\"', event_type, '\",\"attributes\":{\"session_token\":\"[REDACTED]\",\"user\":', user_id, '},\"list\":[{\"Authorization\":\"[REDACTED]\"},', event_id, ']}') \"document\" FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL")
def telemetry_redacted(spark, sf):
    """Telemetry documents: objects within objects and lists, seven terms."""
    doc = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "attributes": {"session_token": {"a": [1]}, "user": '), F.col("user_id").cast("string"), F.lit('}, "list": [{"Authorization": "x"}, '), F.col("event_id").cast("string"), F.lit("]}"))
    return table(spark, sf, "events").filter("event_type is not null and user_id is not null").select("event_id", documents.redact_json(doc, documents.TELEMETRY_TERMS).alias("document"))


_BARE = r"""regexp_replace(regexp_replace(payload, '"(?:[^"\\]|\\.)*"', '', 'g'), '[^\[\]{}]', '', 'g')"""


@query(f"""WITH d AS (SELECT DISTINCT raw_record_id, {_BARE} s FROM raw_records WHERE payload IS NOT NULL) SELECT raw_record_id, CAST(coalesce(list_max(list_transform(range(1, length(s) + 1), lambda i: length(regexp_replace(s[1:i], '[\\]}}]', '', 'g')) - length(regexp_replace(s[1:i], '[\\[{{]', '', 'g')))), 0) AS INT) depth FROM d""")
def payload_depth(spark, sf):
    one = project(spark, sf, "raw_records").filter("payload is not null").select("raw_record_id", "payload").dropDuplicates(["raw_record_id"])
    return one.select("raw_record_id", documents.json_depth(F.col("payload")).alias("depth"))


# snapshots -------------------------------------------------------------------------------------------

_STATE = {
    "batches": ["batch_id", "source_id", "external_batch_id", "schema_version", "state", "received_count", "invalid_count", "error_summary"],
    "canonical_transactions": ["canonical_id", "source_id", "raw_record_id", "source_record_id", "*occurred_at", "amount", "currency", "direction", "normalization_version", "canonical_version", "transaction_type", "account_reference", "transaction_reference", "description", "supersedes_canonical_id", "canonical_fingerprint"],
    "match_candidates": ["candidate_id", "source_a_canonical_id", "source_b_canonical_id", "[eligible_rule_ids", "evidence"],
    "raw_records": ["raw_record_id", "source_id", "batch_id", "source_record_id", "schema_version", "seq", "payload", "content_fingerprint", "invalid_reason", "supersedes_raw_record_id"],
    "reconciliations": ["reconciliation_id", "batch_id", "source_a_record_id", "source_b_record_id", "raw_record_id", "reconciliation_version", "rule_version", "evidence", "state", "outcome", "supersedes_reconciliation_id", "resolution_id"],
    "sources": ["source_id", "name", "[schema_versions", "active", "time_zone", "locale"],
}


def _digest_sql(name: str, columns: list[str]) -> str:
    text = {"*": "CAST(epoch_us({}) AS VARCHAR)", "[": "array_to_string(list_transform({}, lambda x: coalesce(x, '?')), ',')"}
    parts = ", ".join(f"coalesce({text[c[0]].format(c[1:]) if c[0] in text else f'CAST({c} AS VARCHAR)'}, chr(0))" for c in columns)
    half = lambda a, b: f"CAST(coalesce(sum(CAST(concat('0x', x[{a}:{b}]) AS BIGINT)), 0) AS VARCHAR)"
    return f"SELECT '{name}' table_name, count(*) n_rows, concat({half(1, 12)}, '-', {half(13, 24)}) digest FROM (SELECT sha256(concat_ws(chr(31), {parts})) x FROM {name})"


_SIGNATURE = " UNION ALL ".join(_digest_sql(k, v) for k, v in _STATE.items())


def _state(spark, sf) -> dict:
    return {name: project(spark, sf, name) for name in _STATE}


@query(_digest_sql("canonical_transactions", [*_STATE["canonical_transactions"], "*created_at"]))
def table_digest(spark, sf):
    """Over all columns, so that a change of any value shows."""
    return snapshots.digest("canonical_transactions", project(spark, sf, "canonical_transactions"))


@query(_SIGNATURE)
def database_signature(spark, sf):
    return snapshots.signature(_state(spark, sf))


@query(f"SELECT sha256(string_agg(concat_ws(' ', table_name, n_rows, digest), chr(10) ORDER BY table_name)) checksum FROM ({_SIGNATURE})")
def manifest_checksum(spark, sf):
    return snapshots.checksum(snapshots.signature(_state(spark, sf)))


@query(" UNION ALL ".join(f"SELECT '{n}' table_name, count(*) n_rows, true ok FROM {n}" for n in _STATE))
def restore_drill(spark, sf):
    """A snapshot is written and every table of it proven by its digest."""
    folder = f"{Scratch(spark, 'snapshot').root}/copy"
    snapshots.snapshot(_state(spark, sf), folder)
    return snapshots.verify(spark, folder)


@query("SELECT unnest(['audit_events', 'discrepancies', 'resolutions', 'validation_results']) table_name")
def missing_tables(spark, sf):
    """Tables that a whole database has and the data directory doesn't."""
    return snapshots.missing_tables(spark, list(_STATE), [*_STATE, "validation_results", "discrepancies", "resolutions", "audit_events"])


# metrics and alerts ----------------------------------------------------------------------------------


@query("SELECT DISTINCT doc_id, regexp_replace(substr(text, 1, 96), '[\\\\\"\\n\\r\\t]', '_', 'g') label FROM documents")
def label_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", metrics.label_value(F.col("text")).alias("label"))


_WORDS = ", ".join(f"'{w}'" for w in metrics.ROUTE_WORDS)


@query(f"""WITH p AS (SELECT concat('/v1/', ['batches', 'reports', 'orders'][1 + o_orderkey % 3], '/', o_orderkey, '/records/', o_custkey, '?page=', o_custkey) path FROM orders)
SELECT concat('/', array_to_string(list_transform(list_filter(string_split(split_part(path, '?', 1), '/'), lambda s: s <> ''), lambda s: CASE WHEN s IN ({_WORDS}) THEN s ELSE '{{id}}' END), '/')) route, count(*) n FROM p GROUP BY 1""")
def route_template(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("batches", "reports", "orders"))), (1 + F.col("o_orderkey") % 3).cast("int"))
    path = F.concat(F.lit("/v1/"), kind, F.lit("/"), "o_orderkey", F.lit("/records/"), "o_custkey", F.lit("?page="), "o_custkey")
    return table(spark, sf, "orders").groupBy(metrics.route_template(path).alias("route")).agg(F.count(F.lit(1)).alias("n"))


_NUM = "CASE WHEN contains({0}, '.') THEN regexp_replace({0}, '\\.?0+$', '') ELSE {0} END"
_HIST = " UNION ALL ".join([f"SELECT concat('request_seconds_bucket{{route=\"', event_type, '\",le=\"{int(b) if b >= 1 and float(b).is_integer() else b}\"}} ', count_if(v <= {b})) line FROM e GROUP BY event_type" for b in metrics.LATENCY_BUCKETS] + ["SELECT concat('request_seconds_bucket{route=\"', event_type, '\",le=\"+Inf\"} ', count(*)) FROM e GROUP BY event_type", "SELECT concat('request_seconds_count{route=\"', event_type, '\"} ', count(*)) FROM e GROUP BY event_type", f"SELECT concat('request_seconds_sum{{route=\"', event_type, '\"}} ', {_NUM.format('s')}) FROM (SELECT event_type, CAST(CAST(sum(CAST(round(v * 1000000) AS DECIMAL(38,0))) AS DECIMAL(38,6)) / 1000000 AS VARCHAR) s FROM e GROUP BY event_type)".replace("CAST(CAST(sum(CAST(round(v * 1000000) AS DECIMAL(38,0))) AS DECIMAL(38,6)) / 1000000 AS VARCHAR)", "CAST(CAST(sum(CAST(round(v * 1000000) AS HUGEINT)) * 0.000001::DECIMAL(18,6) AS DECIMAL(38,6)) AS VARCHAR)")])


@query(f"""WITH e AS (SELECT event_type, "value" / 1000 v FROM events WHERE "value" IS NOT NULL AND event_type IS NOT NULL)
SELECT concat('requests_total{{route="', event_type, '"}} ', count(*)) line FROM events WHERE event_type IS NOT NULL GROUP BY event_type UNION ALL {_HIST}""")
def metrics_text(spark, sf):
    """Counters and histograms in the text form that scrapers read."""
    e = table(spark, sf, "events").filter("event_type is not null").withColumnRenamed("event_type", "route")
    return metrics.counter_lines(e, "requests_total", ["route"]).unionByName(metrics.histogram_lines(e, "request_seconds", ["route"], F.col("value") / 1000))


@query("""WITH m AS (SELECT count(*) n, count_if(event_type = 'error') / count(*) er FROM events), p AS (SELECT max(v) / 1000 p95 FROM (SELECT "value" v, row_number() OVER (ORDER BY "value") i, count(*) OVER () n FROM events WHERE "value" IS NOT NULL) WHERE i <= greatest(1, CAST(round_even(0.95 * n, 0) AS BIGINT))),
b AS (SELECT count_if(state = 'PARTIAL') partial, count(*) n, max(epoch_us(completed_at)) done FROM batches), w AS (SELECT count(*) n, count(*) - count(DISTINCT raw_record_id) again, max(epoch_us(accepted_at)) latest FROM raw_records), c AS (SELECT count_if(outcome IS NULL) waiting, count(*) n FROM reconciliations)
SELECT alert FROM (SELECT unnest(['ServiceDown', 'ReadinessFailing', 'DatabaseFailures', 'AuditFailures', 'ProcessingFailures', 'RetryStorm', 'ServerErrorRatio', 'LatencyHigh', 'Saturation', 'BackupStale']) alert,
 unnest([m.n = 0, b.n = 0, false, w.n = 0, b.partial > 0, again > 10, er > 0.02, p95 > 1, waiting > 0.8 * greatest(c.n, 1), (done - latest) / 1000000.0 > 3600]) fired FROM m, p, b, w, c) WHERE fired""")
def alerts_fired(spark, sf):
    """The ten rules over inputs taken from the tables."""
    one = F.lit(1).alias("one")
    events = table(spark, sf, "events")
    p95 = reporting.ranked_values(Scratch(spark, "alerts"), events, [], "value", {"p95": reporting.nearest_ranks(0.95)["rounded"]}).select(one, (F.col("p95") / 1000).alias("latency_p95_seconds"))
    m = events.agg(one, (F.count(F.lit(1)) > 0).alias("service_up"), F.try_divide(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))).alias("server_error_ratio"))
    b = project(spark, sf, "batches").agg(one, (F.count(F.lit(1)) > 0).alias("ready"), F.count_if(F.col("state") == "PARTIAL").alias("processing_failures"), F.unix_micros(F.max("completed_at")).alias("done"))
    w = project(spark, sf, "raw_records").groupBy("raw_record_id").agg(F.count(F.lit(1)).alias("k"), F.max("accepted_at").alias("t")).agg(one, F.coalesce(F.sum("k") - F.count("raw_record_id"), F.lit(0)).alias("retries"), (F.count(F.lit(1)) == 0).cast("int").alias("audit_failures"), F.unix_micros(F.max("t")).alias("latest"))
    c = project(spark, sf, "reconciliations").agg(one, F.count_if(F.col("outcome").isNull()).alias("in_flight"), F.count(F.lit(1)).alias("in_flight_limit"))
    rows = m.join(p95, "one", "left").join(b, "one").join(w, "one").join(c, "one")  # of one row each
    return metrics.fired(rows.withColumns({"db_failures": F.lit(0), "backup_stale_seconds": (F.col("done") - F.col("latest")) / 1_000_000}))


def _rate_sql(minutes: int) -> str:
    return f"SELECT event_type route, {minutes} AS \"minutes\", CAST(floor(epoch_us(ts) / {minutes * 60_000_000}) * {minutes * 60} AS BIGINT) window_s, count(*) increase FROM events GROUP BY ALL"


@query(" UNION ALL ".join(map(_rate_sql, (5, 10, 15))))
def increases(spark, sf):
    """Events by route in windows of 5, 10 and 15 minutes."""
    out = None
    for m in (5, 10, 15):
        w = table(spark, sf, "events").groupBy(F.col("event_type").alias("route"), F.window("ts", f"{m} minutes")).agg(F.count(F.lit(1)).alias("increase"))
        w = w.select("route", F.lit(m).alias("minutes"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', window.start)").alias("window_s"), "increase")
        out = w if out is None else out.unionByName(w)
    return out


@query("SELECT event_id, event_type name FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def telemetry_lines(spark, sf):
    """Events as a stream to two JSON-lines sinks, one of them for errors only, read back."""
    scratch = Scratch(spark, "lines")
    stream = rec._as_stream(spark, sf, scratch, table(spark, sf, "events").select("event_id", F.col("event_type").alias("name")), "events")
    ingest.fan_out(stream, f"{scratch.root}/checkpoint", {f"{scratch.root}/all": F.lit(True), f"{scratch.root}/errors": F.col("name") == "error"})
    back = lambda n: spark.read.schema("event_id bigint, name string").json(f"{scratch.root}/{n}").select("event_id", "name")
    return back("all").unionByName(back("errors"))
