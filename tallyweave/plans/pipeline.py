"""Queries of ingestion, normalisation, identities, decisions, outcomes and resolutions, with their SQL.

The SQL is written from the rules, apart from the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import candidates as cand
from tallyweave.operators import ingestion, matching, outcomes, records, reporting
from tallyweave.plans import reconciliation as rec
from tallyweave.plans.common import CURRENT, query, reconciliations
from tallyweave.sources.tables import Scratch, table

# ingestion -----------------------------------------------------------------------------------------


@query("SELECT source_id, name, list_sort(list_distinct(schema_versions)) schema_versions, active, false conflict FROM (SELECT DISTINCT source_id, name, schema_versions, active FROM sources)".replace("list_sort(list_distinct(schema_versions)) schema_versions", "array_to_string(list_sort(list_distinct(schema_versions)), ',') schema_versions"))
def sources_registered(spark, sf):
    return ingestion.register_sources(table(spark, sf, "sources")).withColumn("schema_versions", F.array_join("schema_versions", ","))


@query("""WITH j AS (SELECT b.*, coalesce(s.active, false) ok, coalesce(list_contains(s.schema_versions, b.schema_version), false) known FROM batches b LEFT JOIN sources s USING (source_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY ok AND known, source_id, external_batch_id, schema_version ORDER BY received_at, batch_id) i FROM j)
SELECT batch_id, source_id, external_batch_id, schema_version, CASE WHEN NOT ok THEN 'unknown or inactive source' WHEN NOT known THEN 'schema version not registered' WHEN i = 1 THEN 'created' ELSE 'existing' END "result" FROM w""")
def batches_created(spark, sf):
    return ingestion.create_batches(table(spark, sf, "batches").select("batch_id", "source_id", "external_batch_id", "schema_version", "received_at"), table(spark, sf, "sources"))


def _deliveries(spark, sf, keyed: bool) -> DataFrame:
    """The deliveries in the order of their arrival; keyed: every second has a key of its own that says where it stands."""
    raw = table(spark, sf, "raw_records").select("seq", "source_id", "batch_id", "schema_version", "payload").distinct()
    once = raw.groupBy("seq").agg(F.min(F.struct("source_id", "batch_id", "schema_version", "payload")).alias("r")).select("seq", "r.*")
    key = F.concat("batch_id", F.lit(":"), F.floor(F.col("seq") / 4).cast("string"))
    return once.withColumn("idempotency_key", F.when((F.col("seq") % 2 == 0) & F.lit(keyed), key).cast("string"))


def _ingest_sql(keyed: bool) -> str:
    key = "CASE WHEN seq % 2 = 0 THEN concat(batch_id, ':', CAST(floor(seq / 4) AS BIGINT)) END" if keyed else "NULL"
    return f"""WITH d0 AS (SELECT DISTINCT seq, source_id, batch_id, schema_version, payload FROM raw_records), d1 AS (SELECT seq, min(struct_pack(s := source_id, b := batch_id, v := schema_version, p := payload)) r FROM d0 GROUP BY seq),
d AS (SELECT seq, r.s source_id, r.b batch_id, r.v schema_version, r.p payload, CASE WHEN json_valid(r.p) AND json_type(r.p) = 'OBJECT' THEN r.p::JSON END j FROM d1),
u AS (SELECT seq, j, unnest(json_keys(j)) k FROM d WHERE j IS NOT NULL), t AS (SELECT seq, k, json_extract_string(j, concat('$."', k, '"')) t FROM u),
fp AS (SELECT seq, sha256(concat('{{', string_agg(concat(to_json(k), ':', CASE WHEN t IS NULL THEN 'null' ELSE to_json(nfc_normalize(regexp_replace(t, '\\r\\n?', chr(10), 'g')))::VARCHAR END), ',' ORDER BY k), '}}')) f FROM t GROUP BY seq),
g AS (SELECT d.*, CASE WHEN j IS NOT NULL THEN coalesce(f, sha256('{{}}')) END f, CASE WHEN schema_version = 'source_a.v1' THEN 'record_id' ELSE 'id' END nk, {key} ikey FROM d LEFT JOIN fp USING (seq)),
h AS (SELECT *, CASE WHEN f IS NOT NULL THEN concat('raw:', source_id, ':', schema_version, ':', f) END raw, json_extract_string(j, concat('$."', nk, '"')) nid, coalesce(json_type(j, concat('$."', nk, '"')) = 'VARCHAR', false) isstr FROM g),
m AS (SELECT *, coalesce(ikey, raw, concat('raw:', source_id, ':', schema_version, ':', sha256(coalesce(payload, '')))) key, f IS NOT NULL AND isstr AND trim(nid, concat(' ', chr(9), chr(10), chr(13), chr(160))) <> '' named FROM h),
n AS (SELECT *, CASE WHEN f IS NULL THEN 'REJECTED' WHEN NOT named THEN 'INVALID' ELSE 'ACCEPTED' END st, CASE WHEN f IS NULL THEN 'payload must be a JSON object' WHEN NOT named THEN concat('missing ', nk) END why, CASE WHEN f IS NULL THEN NULL WHEN named THEN nid ELSE concat('invalid-', f[1:16]) END sid,
 first_value(seq) OVER w first_seq FROM m WINDOW w AS (PARTITION BY source_id, key ORDER BY seq)),
l AS (SELECT batch_id, raw, min(seq) linked FROM n WHERE raw IS NOT NULL AND (seq = first_seq OR ikey IS NULL) GROUP BY ALL),
res AS (SELECT n.seq, n.batch_id delivered_to, o.batch_id batch_id, o.raw raw_record_id, o.st status, o.f fingerprint, o.why invalid_reason, o.sid source_record_id, n.seq <> n.first_seq OR coalesce(l.linked < n.seq, false) duplicate FROM n JOIN n o ON o.seq = n.first_seq LEFT JOIN l ON l.batch_id = n.batch_id AND l.raw = n.raw)"""


@query(f"{_ingest_sql(False)} SELECT * FROM res")
def ingest_results(spark, sf):
    """The content is the key of every delivery."""
    return ingestion.ingest(_deliveries(spark, sf, False))


@query(f"{_ingest_sql(True)} SELECT * FROM res")
def ingest_results_keyed(spark, sf):
    """Every second delivery has a key of its own, which another may repeat."""
    return ingestion.ingest(_deliveries(spark, sf, True))


@query(f"{_ingest_sql(True)} SELECT delivered_to batch_id, count(*) received, count_if(status <> 'REJECTED') accepted, count_if(status = 'REJECTED') rejected, count_if(status = 'INVALID') invalid FROM res WHERE NOT duplicate GROUP BY 1")
def ingest_counters(spark, sf):
    return ingestion.ingest_counters(ingestion.ingest(_deliveries(spark, sf, True)))


@query(f"{rec._VALIDATED}, half AS (SELECT DISTINCT raw_record_id FROM raw_records WHERE seq % 2 = 0) SELECT raw_record_id, errors, raw_record_id IN (SELECT raw_record_id FROM half) reused FROM v")
def validation_memo(spark, sf):
    """Results are kept per raw record: those of the records already validated are read, only the others are checked."""
    raw = table(spark, sf, "raw_records").select("raw_record_id", "schema_version", "payload", "seq")
    text = lambda df: records.validate(df.dropDuplicates(["raw_record_id"])).select("raw_record_id", F.concat_ws(",", "errors").alias("errors"))
    memo = Scratch(spark, "memo").put(text(raw.filter("seq % 2 = 0")), "results")
    new = text(raw.join(memo.select("raw_record_id"), "raw_record_id", "left_anti"))
    return memo.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))


# normalisation and identities ------------------------------------------------------------------------


@query(f"""{rec._VALIDATED}, n AS (SELECT k.raw_record_id, errors, {rec._field('amount')} amount FROM k JOIN v USING (raw_record_id)), c AS (SELECT raw_record_id, CASE WHEN errors <> '' THEN 'validation_invalid' WHEN length(regexp_extract(amount, '^[+-]?([0-9]+)', 1)) > 24 THEN 'invalid_amount' WHEN length(regexp_extract(amount, '^[+-]?([0-9]+)', 1)) > 16 THEN 'invalid_value' END failure_code FROM n)
SELECT raw_record_id, CASE WHEN failure_code IS NULL THEN 'SUCCESS' ELSE 'FAILED' END status, failure_code FROM c""")
def normalization_results(spark, sf):
    return outcomes.normalization_results(rec._validated(spark, sf))


def _canonical(spark, sf) -> DataFrame:
    return table(spark, sf, "canonical_transactions").dropDuplicates(["canonical_id"])


_ISO = "concat(strftime(make_timestamp(epoch_us(occurred_at)), '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN '' ELSE concat('.', lpad(CAST(epoch_us(occurred_at) % 1000000 AS VARCHAR), 6, '0')) END, '+00:00')"
_PAYLOAD = "concat('{', " + ", ',', ".join(f"'\"{c}\":', coalesce(CAST(to_json({_ISO if c == 'occurred_at' else f'CAST({c} AS VARCHAR)'}) AS VARCHAR), 'null')" if c != "transaction_status" else "'\"transaction_status\":null'" for c in outcomes.SEMANTIC) + ", '}')"


@query(f"SELECT DISTINCT canonical_id, {_PAYLOAD} payload FROM canonical_transactions")
def semantic_payloads(spark, sf):
    can = _canonical(spark, sf)
    return can.select("canonical_id", outcomes.semantic_payload(set(can.columns)).alias("payload"))


@query(f"SELECT DISTINCT canonical_id, canonical_id = concat('can:', raw_record_id, ':', normalization_version, ':', canonical_version) id_ok, canonical_fingerprint = sha256({_PAYLOAD}) fingerprint_ok FROM canonical_transactions")
def identity_check(spark, sf):
    return outcomes.identity_check(_canonical(spark, sf))


@query("""SELECT canonical_id, CAST(row_number() OVER w AS INT) "version", lag(canonical_id) OVER w supersedes FROM (SELECT DISTINCT canonical_id, raw_record_id, canonical_version FROM canonical_transactions) WINDOW w AS (PARTITION BY raw_record_id ORDER BY canonical_version, canonical_id)""")
def canonical_versions(spark, sf):
    return outcomes.canonical_versions(_canonical(spark, sf))


@query("SELECT candidate_id, a_missing, b_missing FROM (SELECT DISTINCT candidate_id, source_a_canonical_id IS NULL OR source_a_canonical_id NOT IN (SELECT canonical_id FROM canonical_transactions) a_missing, source_b_canonical_id IS NULL OR source_b_canonical_id NOT IN (SELECT canonical_id FROM canonical_transactions) b_missing FROM match_candidates) WHERE a_missing OR b_missing")
def candidates_without_canonical(spark, sf):
    """Candidates that name a transaction which doesn't exist: evaluating them would be refused."""
    known = table(spark, sf, "canonical_transactions").select("canonical_id").distinct()
    c = table(spark, sf, "match_candidates").select("candidate_id", "source_a_canonical_id", "source_b_canonical_id").distinct()
    for s in "ab":
        has = known.select(F.col("canonical_id").alias(f"source_{s}_canonical_id"), F.lit(False).alias(f"{s}_missing"))
        c = c.join(has, f"source_{s}_canonical_id", "left").withColumn(f"{s}_missing", F.coalesce(f"{s}_missing", F.lit(True)))
    return c.filter("a_missing or b_missing").select("candidate_id", "a_missing", "b_missing")


# decisions -------------------------------------------------------------------------------------------

_BATCH = "concat('batch-', lower(side), '-', k % 7)"
_ROWS = """, bt AS (SELECT rid, concat('batch-', lower(side), '-', k % 7) batch_id FROM (SELECT rid, side, k FROM ca UNION ALL SELECT rid, side, k FROM cb)),
js AS (SELECT *, concat('[', coalesce(to_json(a)::VARCHAR, 'null'), ',', coalesce(to_json(b)::VARCHAR, 'null'), ',null,"', outcome, '","standard_v1",null]') j, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE least(a, b) END first FROM dec),
rows_ AS (SELECT concat('reconciliation:', sha256(j)) reconciliation_id, batch_id, outcome, a, b, rule FROM js JOIN bt ON bt.rid = first)"""


def _decision_rows(spark, sf) -> DataFrame:
    a, b = rec._ab(spark, sf)
    batch = a.unionByName(b).select("rid", F.concat(F.lit("batch-"), F.lower("side"), F.lit("-"), (F.col("k") % 7).cast("string")).alias("batch_id"))
    return matching.decision_rows(rec._decisions(spark, sf), batch)


@query(f"{rec._FEEDS}{rec._CAND}{rec._SEL}{_ROWS} SELECT * FROM rows_")
def decision_rows(spark, sf):
    """Decisions with their identity, and the batch of the record that comes first."""
    return _decision_rows(spark, sf)


@query(f"""{rec._FEEDS}{rec._CAND}{rec._SEL}{_ROWS} SELECT concat('discrepancy:', sha256(concat('["', reconciliation_id, '","', outcome, '","standard_v1"]'))) discrepancy_id, reconciliation_id, batch_id, outcome, CASE outcome WHEN 'MISMATCHED' THEN 'amount, currency, or direction differs' ELSE 'multiple candidates satisfy the highest applicable rule' END reason FROM rows_ WHERE outcome IN ('MISMATCHED', 'AMBIGUOUS')""")
def discrepancy_rows(spark, sf):
    return _discrepancies(_decision_rows(spark, sf)).select("discrepancy_id", "reconciliation_id", "batch_id", "outcome", matching.reason(F.col("outcome")).alias("reason"))


def _discrepancies(decided: DataFrame, rule_version=None) -> DataFrame:
    rid = matching.identity("discrepancy", F.col("reconciliation_id"), F.col("outcome"), F.lit("standard_v1") if rule_version is None else rule_version)
    return decided.filter(F.col("outcome").isin(*matching.REASONS)).withColumn("discrepancy_id", rid)


@query(f"""{rec._FEEDS}{rec._CAND}, l AS (SELECT a node, 'A' side, * FROM cand UNION ALL SELECT b, 'B', * FROM cand), f AS (SELECT node, side, max(isref) one FROM l GROUP BY ALL)
SELECT node, side, a, b, rule_id, matched, matched selected FROM (SELECT l.node, l.side, a, b, 'M-001' rule_id, isref = 1 matched FROM l UNION ALL SELECT l.node, l.side, a, b, 'M-002', isamt = 1 FROM l JOIN f ON f.node = l.node AND f.side = l.side WHERE one = 0)""")
def decision_evidence(spark, sf):
    """Every comparison made, until the first rule that hits."""
    return matching.comparisons(cand.candidates(*rec._ab(spark, sf)))


_SECOND = rec._WAVES.split("\nSELECT f.a")[0]


@query(f"""{_SECOND}, added AS (SELECT f.a, f.b, f.outcome, CASE WHEN h.found THEN 2 ELSE 1 END ver, h.old_a.v old_a, h.old_b.v old_b, coalesce(h.found, false) found FROM fresh f LEFT JOIN best h ON f.a IS NOT DISTINCT FROM h.a AND f.b IS NOT DISTINCT FROM h.b),
gone AS (SELECT DISTINCT old_a, old_b FROM added WHERE found),
live AS (SELECT a, b, outcome, 1 ver FROM w1 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.old_a IS NOT DISTINCT FROM w1.a AND g.old_b IS NOT DISTINCT FROM w1.b) UNION ALL SELECT a, b, outcome, ver FROM added),
again AS (SELECT * FROM w1 n WHERE NOT EXISTS (SELECT 1 FROM live o WHERE n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b AND n.outcome = o.outcome)),
over_ AS (SELECT n.a, n.b, n.outcome, max(o.ver) ver FROM again n JOIN live o ON (n.a = o.a AND (o.b IS NULL OR n.b = o.b)) OR (n.b = o.b AND (o.a IS NULL OR n.a = o.a)) GROUP BY ALL)
SELECT a, b, outcome, CAST(ver + 1 AS INT) "version" FROM over_""")
def third_wave_versions(spark, sf):
    """The first wave is decided once more after the second: only what supersedes a current row is added."""
    scratch = Scratch(spark, "third")
    a, b = rec._ab(spark, sf)
    a, b = scratch.put(a, "a"), scratch.put(b, "b")
    cols = ["a", "b", "outcome"]
    one = scratch.put(matching.decide(scratch, a, b.filter("k % 5 <> 0")).select(*cols), "one")
    first = one.withColumns({"version": F.lit(1), "current": F.lit(True)})
    added = scratch.put(matching.next_versions(scratch, first, matching.decide(scratch, a, b).select(*cols)), "added")
    key = lambda x, y: F.concat_ws("|", F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))
    gone = added.filter("version > 1").select(key("old_a", "old_b").alias("k"), F.lit(True).alias("gone")).distinct()
    kept = first.withColumn("k", key("a", "b")).join(gone, "k", "left").select(*cols, "version", F.col("gone").isNull().alias("current"))
    stored = scratch.put(kept.unionByName(added.select(*cols, "version", F.lit(True).alias("current"))), "versions")
    return matching.next_versions(scratch, stored, one).select(*cols, "version")


# outcomes and counters -------------------------------------------------------------------------------

_OUTCOMES = f"""{rec._VALIDATED}, rr AS (SELECT raw_record_id, arg_min(batch_id, seq) batch_id, bool_or(invalid_reason IS NOT NULL) bad FROM raw_records GROUP BY 1),
rc AS (SELECT raw_record_id, min(canonical_id) canonical_id FROM canonical_transactions GROUP BY 1), ro AS (SELECT DISTINCT * FROM reconciliations WHERE outcome IS NOT NULL AND supersedes_reconciliation_id IS NULL),
oc AS (SELECT c, arg_max(outcome, reconciliation_id) outcome FROM (SELECT source_a_record_id c, outcome, reconciliation_id FROM ro UNION ALL SELECT source_b_record_id, outcome, reconciliation_id FROM ro) WHERE c IS NOT NULL GROUP BY 1),
orr AS (SELECT raw_record_id, arg_max(outcome, reconciliation_id) outcome FROM ro WHERE raw_record_id IS NOT NULL GROUP BY 1),
res AS (SELECT raw_record_id, batch_id, CASE WHEN bad OR errors <> '' THEN 'INVALID' ELSE coalesce(oc.outcome, orr.outcome) END outcome FROM rr JOIN v USING (raw_record_id) LEFT JOIN rc USING (raw_record_id) LEFT JOIN oc ON oc.c = rc.canonical_id LEFT JOIN orr USING (raw_record_id)),
ct AS (SELECT batch_id, count(*) processed, count_if(outcome = 'MATCHED') matched, count_if(outcome = 'MISMATCHED') mismatched, count_if(outcome IN ('UNMATCHED_A', 'UNMATCHED_B')) unmatched, count_if(outcome = 'AMBIGUOUS') ambiguous, count_if(outcome = 'DUPLICATE') duplicate, count_if(outcome = 'INVALID') invalid FROM res WHERE outcome IS NOT NULL GROUP BY 1)"""


def _record_outcomes(spark, sf) -> DataFrame:
    raw = table(spark, sf, "raw_records").select("raw_record_id", "batch_id", "seq", "invalid_reason", "schema_version", "payload")
    one = raw.groupBy("raw_record_id").agg(F.min_by(F.struct("batch_id", "schema_version", "payload"), "seq").alias("r"), F.bool_or(F.col("invalid_reason").isNotNull()).alias("bad")).select("raw_record_id", "r.*", "bad")
    checked = records.validate(one).select("raw_record_id", "batch_id", (F.col("bad") | (F.size("errors") > 0)).alias("invalid"))
    return outcomes.record_outcomes(checked, table(spark, sf, "canonical_transactions").select("canonical_id", "raw_record_id"), reconciliations(spark, sf))


@query(f"{_OUTCOMES} SELECT * FROM res WHERE outcome IS NOT NULL")
def record_outcomes(spark, sf):
    return _record_outcomes(spark, sf)


@query(f"{_OUTCOMES} SELECT * FROM ct")
def record_counters(spark, sf):
    """Counters in records: both records of a pair count."""
    return outcomes.outcome_counters(_record_outcomes(spark, sf))


_BATCHES = f"""{_OUTCOMES}, rx AS (SELECT batch_id, count(DISTINCT raw_record_id) accepted FROM (SELECT raw_record_id, arg_min(batch_id, seq) batch_id FROM raw_records GROUP BY 1) GROUP BY 1),
al AS (SELECT b.batch_id, b.received_count received, coalesce(rx.accepted, 0) accepted, ct.* EXCLUDE (batch_id) FROM batches b LEFT JOIN rx USING (batch_id) LEFT JOIN ct ON ct.batch_id = b.batch_id)"""


@query(f"""{_BATCHES} SELECT batch_id, equation FROM (SELECT batch_id, unnest(['received', 'processed', 'accepted']) equation, unnest([received <> accepted, coalesce(processed, 0) <> coalesce(matched + mismatched + unmatched + ambiguous + duplicate + invalid, 0), coalesce(processed, 0) > accepted]) bad FROM al) WHERE bad""")
def counter_equations(spark, sf):
    """Batches whose stored number of received records isn't the number of records they brought first, and the like."""
    first = table(spark, sf, "raw_records").groupBy("raw_record_id").agg(F.min_by("batch_id", "seq").alias("batch_id")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted"))
    b = table(spark, sf, "batches").select("batch_id", F.col("received_count").alias("received"), F.lit(0).alias("rejected"), F.lit(0).alias("failed"))
    return outcomes.counter_violations(b.join(first, "batch_id", "left").join(outcomes.outcome_counters(_record_outcomes(spark, sf)), "batch_id", "left"))


# resolutions and audit -------------------------------------------------------------------------------

_OPEN = f"""{CURRENT}, dq AS (SELECT concat('discrepancy:', sha256(concat('["', reconciliation_id, '","', outcome, '","', rule_version, '"]'))) discrepancy_id, reconciliation_id, outcome, reconciliation_version ver, batch_id FROM cur WHERE outcome IN ('MISMATCHED', 'AMBIGUOUS')),
hq AS (SELECT *, CAST(concat('0x', substr(discrepancy_id, 13, 6)) AS BIGINT) h FROM dq),
rq AS (SELECT discrepancy_id, i seq, ['MANUAL_APPROVED', 'AUTOMATIC', 'DEFERRED', 'REJECTED'][1 + (h + i) % 4] resolution_type, concat(' reason ', i, ' ') reason FROM hq, (VALUES (1), (2), (3)) x(i) WHERE h % 5 >= i),
fq AS (SELECT discrepancy_id, arg_min(resolution_type, seq) resolution_type, trim(arg_min(reason, seq)) reason FROM rq GROUP BY 1),
st AS (SELECT dq.*, resolution_type, CASE WHEN resolution_type IS NOT NULL THEN concat('resolution:', sha256(concat('["', discrepancy_id, '","', reconciliation_id, '","', resolution_type, '","', reason, '"]'))) END resolution_id, CASE WHEN resolution_type IN ('AUTOMATIC', 'MANUAL_APPROVED') THEN 'RESOLVED' ELSE coalesce(resolution_type, 'OPEN') END state FROM dq LEFT JOIN fq USING (discrepancy_id))"""


def open_discrepancies(spark, sf) -> DataFrame:
    """The discrepancies of the current decisions: discrepancy_id, reconciliation_id, outcome, version, batch_id."""
    cur = reporting.current_versions(reconciliations(spark, sf), "reconciliation_id", "supersedes_reconciliation_id")
    return _discrepancies(cur, F.col("rule_version")).select("discrepancy_id", "reconciliation_id", "outcome", F.col("reconciliation_version").alias("version"), "batch_id")


def _resolved(spark, sf) -> tuple[DataFrame, DataFrame]:
    """With up to three requests for each discrepancy, made from its id."""
    d = Scratch(spark, "resolve").put(open_discrepancies(spark, sf), "open")
    h = F.conv(F.substring("discrepancy_id", 13, 6), 16, 10).cast("bigint")
    kinds = F.array(*map(F.lit, ("MANUAL_APPROVED", "AUTOMATIC", "DEFERRED", "REJECTED")))
    asked = d.select("discrepancy_id", h.alias("h"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq")).filter("h % 5 >= seq")
    requests = asked.select("discrepancy_id", "seq", F.element_at(kinds, (1 + (F.col("h") + F.col("seq")) % 4).cast("int")).alias("resolution_type"), F.concat(F.lit(" reason "), F.col("seq").cast("string"), F.lit(" ")).alias("reason"))
    return outcomes.apply_resolutions(d, requests)


@query(f"{_OPEN} SELECT discrepancy_id, resolution_id, resolution_type, state FROM st")
def resolutions_applied(spark, sf):
    """One resolution per discrepancy, whatever is asked later."""
    return _resolved(spark, sf)[0]


@query(f"""{_OPEN} SELECT concat('reconciliation:', sha256(concat('["', reconciliation_id, '","', resolution_id, '"]'))) reconciliation_id, reconciliation_id supersedes, outcome, CAST(ver + 1 AS INT) "version", resolution_id FROM st WHERE state = 'RESOLVED'""")
def resolved_versions(spark, sf):
    return _resolved(spark, sf)[1]


@query("""WITH f AS (SELECT raw_record_id, source_id, min(seq) seq, min_by(batch_id, seq) batch_id FROM raw_records GROUP BY 1, 2), e AS (SELECT source_id entity, concat('ingest:', raw_record_id) event_id, seq FROM f UNION ALL SELECT source_id, concat('batch:', batch_id), min(seq) FROM f GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq > (SELECT max(seq) // 2 FROM raw_records), seq, event_id) "sequence" FROM e) SELECT entity, event_id, "sequence" FROM n WHERE seq > (SELECT max(seq) // 2 FROM raw_records)""")
def audit_append(spark, sf):
    """Events appended to a trail that has the earlier half: those that are there add nothing, numbers go on without gaps."""
    raw = table(spark, sf, "raw_records")
    scratch, top = Scratch(spark, "audit"), raw.agg(F.max("seq")).first()[0] or 0
    first = raw.groupBy("raw_record_id", "source_id").agg(F.min("seq").alias("seq"), F.min_by("batch_id", "seq").alias("batch_id"))
    ingest = first.select(F.col("source_id").alias("entity"), F.concat(F.lit("ingest:"), "raw_record_id").alias("event_id"), "seq")
    batch = first.groupBy(F.col("source_id").alias("entity"), F.concat(F.lit("batch:"), "batch_id").alias("event_id")).agg(F.min("seq").alias("seq"))
    events, block = scratch.put(ingest.unionByName(batch), "events"), reporting.order_blocks(raw, "seq")
    before = scratch.put(reporting.gapless_sequence(events.filter(F.col("seq") <= top // 2), ["entity"], ["seq", "event_id"], block), "trail")
    return reporting.append_events(before, events, ["entity"], "event_id", ["seq", "event_id"], block).select("entity", "event_id", "sequence")
