"""Queries of the reconciliation operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.text import newlines, nfc
from tallyweave.operators import candidates as cand
from tallyweave.operators import matching, records, reporting
from tallyweave.operators.documents import EXPORT_TERMS
from tallyweave.plans.common import CURRENT as _R
from tallyweave.plans.common import SQL, query
from tallyweave.plans.common import reconciliations as _recs
from tallyweave.plans.data_quality import _FATES, _p2_events
from tallyweave.sources import feeds
from tallyweave.sources.tables import Scratch, table
from tallyweave.streaming import ingest

_FEEDS = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) k, CAST(o_orderdate AS DATE) d, CAST(o_totalprice AS DECIMAL(20,4)) amt, o_custkey c, o_orderstatus st FROM orders),
fa AS (SELECT concat('A-', k) rid, 'A' side, k, d, concat(CAST(amt AS VARCHAR), CASE WHEN k % 29 = 0 THEN 'x' ELSE '' END) amount, CASE WHEN c % 5 = 0 THEN 'EUR' ELSE 'USD' END ccy, CASE WHEN st = 'F' THEN 'DEBIT' ELSE 'CREDIT' END dir, CASE WHEN k % 3 <> 0 THEN concat('REF-', k) END ref, k % 29 <> 0 valid FROM o),
fb AS (SELECT concat('B-', k) rid, 'B' side, k, CAST(d + CAST(k % 4 AS INT) AS DATE) d, CAST(CASE WHEN k % 13 = 0 THEN CAST(amt + 5 AS DECIMAL(20,4)) ELSE amt END AS VARCHAR) amount, CASE WHEN c % 5 = 0 THEN 'EUR' ELSE 'USD' END ccy, CASE WHEN (st = 'F') <> (k % 17 = 0) THEN 'DEBIT' ELSE 'CREDIT' END dir, CASE WHEN k % 23 = 1 THEN concat('REF-', k + 1) WHEN k % 3 <> 0 THEN concat('REF-', k) END ref, true valid FROM o WHERE k % 11 <> 0
  UNION ALL SELECT concat('B2-', k), 'B', k, d, CAST(amt AS VARCHAR), CASE WHEN c % 5 = 0 THEN 'EUR' ELSE 'USD' END, CASE WHEN st = 'F' THEN 'DEBIT' ELSE 'CREDIT' END, NULL, true FROM o WHERE k % 19 = 0),
ca AS (SELECT rid, side, k, d, CAST(amount AS DECIMAL(20,4)) amt, ccy, dir, ref FROM fa WHERE valid),
cb AS (SELECT rid, side, k, d, CAST(amount AS DECIMAL(20,4)) amt, ccy, dir, ref FROM fb WHERE valid)"""
_CAND = """,
jr AS (SELECT ca.rid a, cb.rid b FROM ca JOIN cb ON ca.ref = cb.ref),
ja AS (SELECT ca.rid a, cb.rid b FROM ca JOIN cb ON ca.ccy = cb.ccy AND ca.amt = cb.amt AND abs(datediff('day', ca.d, cb.d)) <= 2),
cand AS (SELECT a, b, max(r) isref, max(m) isamt FROM (SELECT a, b, 1 r, 0 m FROM jr UNION ALL SELECT a, b, 0, 1 FROM ja) GROUP BY a, b)"""
_SEL = """,
long AS (SELECT a node, b other, isref, isamt, 'A' side FROM cand UNION ALL SELECT b, a, isref, isamt, 'B' FROM cand),
sel AS (SELECT node, side, CASE WHEN sum(isref) > 0 THEN 'M-001' ELSE 'M-002' END rule, CAST(CASE WHEN sum(isref) > 0 THEN sum(isref) ELSE sum(isamt) END AS BIGINT) n, CASE WHEN sum(isref) > 0 THEN min(CASE WHEN isref = 1 THEN other END) ELSE min(CASE WHEN isamt = 1 THEN other END) END pick FROM long GROUP BY node, side),
edges AS (SELECT DISTINCT CASE WHEN s.side = 'A' THEN s.node ELSE s.pick END a, CASE WHEN s.side = 'A' THEN s.pick ELSE s.node END b FROM sel s JOIN sel t ON t.node = s.pick WHERE s.n = 1 AND t.n = 1),
deg AS (SELECT a, b, count(*) OVER (PARTITION BY a) da, count(*) OVER (PARTITION BY b) db FROM edges),
dup AS (SELECT a node FROM deg WHERE da > 1 OR db > 1 UNION SELECT b FROM deg WHERE da > 1 OR db > 1),
mut AS (SELECT s.node a, t.node b, s.rule FROM sel s JOIN sel t ON s.pick = t.node AND t.pick = s.node WHERE s.side = 'A' AND s.n = 1 AND t.n = 1),
good AS (SELECT * FROM mut WHERE a NOT IN (SELECT node FROM dup) AND b NOT IN (SELECT node FROM dup)),
dec AS (SELECT CASE WHEN ca.amt = cb.amt AND ca.ccy = cb.ccy AND ca.dir = cb.dir THEN 'MATCHED' ELSE 'MISMATCHED' END outcome, a, b, rule FROM good JOIN ca ON ca.rid = a JOIN cb ON cb.rid = b
  UNION ALL SELECT CASE WHEN dup.node IS NOT NULL THEN 'DUPLICATE' WHEN sel.n > 1 THEN 'AMBIGUOUS' ELSE concat('UNMATCHED_', x.side) END, CASE WHEN x.side = 'A' THEN x.rid END, CASE WHEN x.side = 'B' THEN x.rid END, NULL
  FROM (SELECT rid, side FROM ca UNION ALL SELECT rid, side FROM cb) x LEFT JOIN dup ON dup.node = x.rid LEFT JOIN sel ON sel.node = x.rid WHERE x.rid NOT IN (SELECT a FROM good) AND x.rid NOT IN (SELECT b FROM good))"""


def _ab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return feeds.canonical(feeds.source_a(spark, sf)), feeds.canonical(feeds.source_b(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cand.candidates(*_ab(spark, sf))


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    a, b = _ab(spark, sf)
    nodes, seen = Scratch(spark, "nodes").put_counted(a.unionByName(b), "nodes")
    return nodes, seen["n"]


def _selections(spark: SparkSession, sf: str) -> DataFrame:
    return Scratch(spark, "selections").put(matching.select(*_nodes(spark, sf)), "selections")


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return matching.decide(Scratch(spark, "decide"), *_ab(spark, sf))


_FEED_COLS = "rid, side, d, amount, ccy, dir, ref, valid"


@query(f"{_FEEDS} SELECT {_FEED_COLS} FROM fa")
def source_a_feed(spark, sf):
    return feeds.source_a(spark, sf).drop("k")


@query("""SELECT concat(s, '-', lpad(CAST(i AS VARCHAR), 6, '0')) rid, s side, CAST(DATE '2026-01-01' + CAST(i % 5 AS INT) AS DATE) d, CAST(100 + i AS DECIMAL(20,4)) amt, 'USD' ccy, CASE WHEN s = 'B' AND i % 8 = 0 THEN 'DEBIT' ELSE 'CREDIT' END dir, concat('REF-', lpad(CAST(i AS VARCHAR), 6, '0')) "ref" FROM range((SELECT count(*) FROM orders)) t(i), (VALUES ('A'), ('B')) x(s)""")
def benchmark_pairs(spark, sf):
    """As many generated pairs as there are orders."""
    return feeds.pairs(spark, table(spark, sf, "orders").count()).drop("k")


@query(f"{_FEEDS} SELECT {_FEED_COLS} FROM fb")
def source_b_feed(spark, sf):
    return feeds.source_b(spark, sf).drop("k")


@query(f"{_FEEDS}{_CAND} SELECT a, b FROM jr")
def candidates_reference(spark, sf):
    return cand.by_reference(*_ab(spark, sf))


@query(f"{_FEEDS}{_CAND} SELECT a, b FROM ja")
def candidates_amount_date(spark, sf):
    return cand.by_amount_and_date(*_ab(spark, sf))


@query(f"{_FEEDS}{_CAND} SELECT a, b, isref, isamt FROM cand")
def candidates_union(spark, sf):
    return _pairs(spark, sf)


_CLASSES = """, al AS (SELECT rid, side, ref, ccy, amt, d FROM ca UNION ALL SELECT rid, side, ref, ccy, amt, d FROM cb),
cm AS (SELECT 'IDX-REFERENCE' "index", side, min(rid) OVER (PARTITION BY side, ref) "class", rid FROM al WHERE ref IS NOT NULL AND ref <> '' UNION ALL SELECT 'IDX-AMOUNT-CURRENCY-DATE', side, min(rid) OVER (PARTITION BY side, ccy, amt, d), rid FROM al)"""


@query(f"{_FEEDS}{_CLASSES} SELECT * FROM cm")
def candidate_class_members(spark, sf):
    return cand.class_members(*_nodes(spark, sf))


@query(f"""{_FEEDS}{_CAND}{_CLASSES}, pr AS (SELECT 'IDX-REFERENCE' "index", a, b FROM jr UNION ALL SELECT 'IDX-AMOUNT-CURRENCY-DATE', a, b FROM ja)
SELECT p."index", x."class" class_a, y."class" class_b, count(DISTINCT p.a) n_a, count(DISTINCT p.b) n_b FROM pr p JOIN cm x ON x."index" = p."index" AND x.rid = p.a JOIN cm y ON y."index" = p."index" AND y.rid = p.b GROUP BY ALL""")
def candidate_class_links(spark, sf):
    """All candidate pairs, as pairs of classes; the SQL forms the pairs and gathers them."""
    return cand.class_links(_nodes(spark, sf)[0])


@query(f"{_FEEDS}{_CAND} SELECT a, b, isref, isamt FROM cand WHERE a = 'A-38' OR b = 'A-38'")
def candidates_of_target(spark, sf):
    return cand.candidates_of(spark.createDataFrame([("A-38",)], "rid string"), *_ab(spark, sf))


@query(f"{_FEEDS}{_CAND} SELECT a, b, isref, isamt FROM cand WHERE CAST(split_part(a, '-', 2) AS BIGINT) % 100 = 0 OR CAST(split_part(b, '-', 2) AS BIGINT) % 100 = 0")
def candidates_of_hundredths(spark, sf):
    """The candidates of every record of both sides whose number is divisible by 100."""
    a, b = _ab(spark, sf)
    return cand.candidates_of(a.unionByName(b).filter("k % 100 = 0"), a, b)


@query(f"""{_FEEDS}{_CAND}, n AS (SELECT rid, count(*) n FROM (SELECT a rid FROM cand UNION ALL SELECT b FROM cand) GROUP BY rid)
SELECT side, count(*) records, min(coalesce(n, 0)) least, CAST(median(coalesce(n, 0)) AS DOUBLE) middle, max(coalesce(n, 0)) most, CAST(sum(coalesce(n, 0)) AS BIGINT) total FROM (SELECT rid, side FROM ca UNION ALL SELECT rid, side FROM cb) x LEFT JOIN n USING (rid) GROUP BY side""")
def candidate_distribution(spark, sf):
    return cand.distribution(*_nodes(spark, sf))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT node, side, rule, n, pick FROM sel")
def rule_selection(spark, sf):
    """From the records, without forming their pairs."""
    return matching.select(*_nodes(spark, sf))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT node, side, rule, n, pick FROM sel")
def rule_selection_of_candidates(spark, sf):
    """The same from the pairs, as a stored candidate table gives them."""
    return matching.select_by_rule(_pairs(spark, sf))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT a, b FROM edges")
def proposal_edges(spark, sf):
    return matching.proposals(_selections(spark, sf))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT node FROM dup")
def conflict_duplicates(spark, sf):
    return matching.conflicts(matching.proposals(_selections(spark, sf)))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT a, b, rule FROM mut")
def mutual_pairs(spark, sf):
    return matching.mutual(_selections(spark, sf))


@query(f"{_FEEDS}{_CAND} SELECT a, b, CASE WHEN ca.amt = cb.amt AND ca.ccy = cb.ccy AND ca.dir = cb.dir THEN 'MATCHED' ELSE 'MISMATCHED' END outcome FROM cand JOIN ca ON ca.rid = a JOIN cb ON cb.rid = b")
def pair_outcome(spark, sf):
    return matching.pair_outcomes(_pairs(spark, sf).select("a", "b"), *_ab(spark, sf))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT outcome, a, b, rule FROM dec")
def decisions(spark, sf):
    return _decisions(spark, sf)


_SIDES = """WITH tx AS (SELECT DISTINCT t.canonical_id rid, t.amount amt, t.currency ccy, t.direction dir, nullif(t.transaction_reference, '') ref, CAST(DATE '1970-01-01' + CAST(floor(epoch_us(t.occurred_at) / 86400000000) AS INT) AS DATE) d, list_contains(s.schema_versions, 'source_a.v1') is_a FROM canonical_transactions t JOIN sources s USING (source_id)),
ca AS (SELECT *, 'A' side FROM tx WHERE is_a), cb AS (SELECT *, 'B' side FROM tx WHERE NOT is_a)"""


@query(f"{_SIDES}{_CAND}{_SEL} SELECT outcome, a, b, rule FROM dec")
def transaction_decisions(spark, sf):
    """The decisions about all canonical transactions, of which superseded versions stay in the pool."""
    schemas = F.col("schema_versions")
    sides = table(spark, sf, "sources").select("source_id", F.when(F.array_contains(schemas, "source_a.v1"), "A").otherwise("B").alias("side")).dropDuplicates(["source_id"])
    can = table(spark, sf, "canonical_transactions").select("canonical_id", "source_id", "occurred_at", "amount", "currency", "direction", "transaction_reference").dropDuplicates(["canonical_id"])
    day = F.date_from_unix_date(F.floor(F.unix_micros("occurred_at") / F.lit(86_400_000_000)).cast("int"))
    rows = can.join(sides, "source_id").select(F.col("canonical_id").alias("rid"), "side", day.alias("d"), F.col("amount").alias("amt"), F.col("currency").alias("ccy"), F.col("direction").alias("dir"), F.col("transaction_reference").alias("ref"))
    scratch = Scratch(spark, "transactions")
    stored = scratch.put(rows, "rows")
    return matching.decide(scratch, stored.filter("side = 'A'"), stored.filter("side = 'B'"))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT outcome, count(*) n FROM (SELECT outcome FROM dec UNION ALL SELECT 'INVALID' FROM fa WHERE NOT valid) GROUP BY outcome")
def outcome_counts(spark, sf):
    bad = feeds.source_a(spark, sf).filter("not valid").select(F.lit("INVALID").alias("outcome"))
    return _decisions(spark, sf).select("outcome").unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT outcome, a, b, CASE outcome WHEN 'MISMATCHED' THEN 'amount, currency, or direction differs' ELSE 'multiple candidates satisfy the highest applicable rule' END reason FROM dec WHERE outcome IN ('MISMATCHED', 'AMBIGUOUS')")
def discrepancies(spark, sf):
    return _decisions(spark, sf).filter(F.col("outcome").isin("MISMATCHED", "AMBIGUOUS")).select("outcome", "a", "b", matching.reason(F.col("outcome")).alias("reason"))


@query(f"{_FEEDS} SELECT 'INVALID' outcome, rid, 1 \"version\" FROM fa WHERE NOT valid")
def invalid_decisions(spark, sf):
    return feeds.source_a(spark, sf).filter("not valid").select(F.lit("INVALID").alias("outcome"), "rid", F.lit(1).alias("version"))


_MATCHED_FIRST = f"{_FEEDS.replace('FROM fb WHERE valid', 'FROM fb WHERE valid AND k % 5 <> 0')}{_CAND}{_SEL}"
_WAVES = f"""WITH w1 AS ({_MATCHED_FIRST} SELECT outcome, a, b FROM dec), w2 AS ({_FEEDS}{_CAND}{_SEL} SELECT outcome, a, b FROM dec),
fresh AS (SELECT * FROM w2 n WHERE NOT EXISTS (SELECT 1 FROM w1 o WHERE n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b AND n.outcome = o.outcome)),
hit AS (SELECT n.a, n.b, n.outcome, o.a old_a, o.b old_b, concat(coalesce(o.a, ''), '|', coalesce(o.b, '')) k FROM fresh n JOIN w1 o ON n.a = o.a WHERE (o.b IS NULL OR n.b = o.b)
  UNION SELECT n.a, n.b, n.outcome, o.a, o.b, concat(coalesce(o.a, ''), '|', coalesce(o.b, '')) FROM fresh n JOIN w1 o ON n.b = o.b WHERE (o.a IS NULL OR n.a = o.a)),
best AS (SELECT a, b, max_by(old_a, k) old_a, max_by(old_b, k) old_b, true found FROM (SELECT a, b, struct_pack(v := old_a) old_a, struct_pack(v := old_b) old_b, k FROM hit) GROUP BY a, b)
SELECT f.a, f.b, f.outcome, CAST(CASE WHEN h.found THEN 2 ELSE 1 END AS INT) "version", h.old_a.v old_a, h.old_b.v old_b FROM fresh f LEFT JOIN best h ON f.a IS NOT DISTINCT FROM h.a AND f.b IS NOT DISTINCT FROM h.b"""


@query(_WAVES)
def late_arrival_versions(spark, sf):
    """Versions added when every fifth B record arrives after the first run."""
    scratch = Scratch(spark, "waves")
    a, b = _ab(spark, sf)
    a, b = scratch.put(a, "a"), scratch.put(b, "b")
    first = b.filter("k % 5 <> 0")
    one = matching.decide(scratch, a, first)
    old = scratch.put(one.select("a", "b", "outcome", F.lit(1).alias("version"), F.lit(True).alias("current")), "versions")
    two = matching.decide(scratch, a, b).select("a", "b", "outcome")
    return matching.next_versions(scratch, old, two)


@query("SELECT 0 added")
def pipeline_idempotent_replay(spark, sf):
    """Deciding again over the same records adds no version."""
    scratch, own = Scratch(spark, "replay"), Scratch(spark, "replay-first")
    done = scratch.put(matching.decide(own, *_ab(spark, sf)).select("a", "b", "outcome"), "decisions")
    own.clear()
    old = done.select("a", "b", "outcome", F.lit(1).alias("version"), F.lit(True).alias("current"))
    own = Scratch(spark, "replay-second")
    again = matching.decide(own, *_ab(spark, sf)).select("a", "b", "outcome")
    return matching.next_versions(scratch, old, again, made_in=own).agg(F.count(F.lit(1)).cast("int").alias("added"))


# records of the raw table ------------------------------------------------------------------------


def _raw(spark, sf):
    return table(spark, sf, "raw_records")


def _case(i: int) -> str:
    names = {f: k[i] for f, k in records.FIELDS.items()}
    known = "[" + ", ".join(f"'{k}'" for k in names.values()) + "]"
    parts = [f"CASE WHEN NOT list_contains(keys, '{names[f]}') THEN '{names[f]}/required' END" for f in records.REQUIRED]
    for f, k in sorted(names.items(), key=lambda x: x[1]):
        v = f"(j->>'$.{k}')"
        bad = {
            "record_id": f"WHEN trim({v}) = '' THEN '{k}/empty'",
            "occurred_at": f"WHEN NOT ((regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR regexp_full_match({v}, '{records.OFFSET_TIME[2:-2]}')) AND try_cast({v}[1:10] AS DATE) IS NOT NULL) THEN '{k}/date'",
            "amount": f"WHEN NOT regexp_full_match({v}, '{records.AMOUNT[2:-2]}') THEN '{k}/amount'",
            "currency": f"WHEN NOT regexp_full_match({v}, '[A-Z]{{3}}') THEN '{k}/currency'",
            "direction": f"WHEN {v} NOT IN ('CREDIT', 'DEBIT') THEN '{k}/direction'",
        }.get(f, "")
        parts.append(f"CASE WHEN list_contains(keys, '{k}') THEN CASE WHEN json_type(j, '$.{k}') <> 'VARCHAR' THEN '{k}/type' {bad} END END")
    return f"list_concat(list_transform(list_sort(list_filter(keys, lambda x: NOT list_contains({known}, x))), lambda x: concat(x, '/unknown_field')), list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


_VALIDATED = f"""WITH r AS (SELECT DISTINCT raw_record_id, schema_version, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END j FROM raw_records), k AS (SELECT *, json_keys(j) keys FROM r),
v AS (SELECT raw_record_id, array_to_string(CASE WHEN schema_version NOT IN ('source_a.v1', 'source_b.v1') THEN ['/unsupported_schema'] WHEN j IS NULL THEN ['/object'] WHEN schema_version = 'source_a.v1' THEN {_case(0)} ELSE {_case(1)} END, ',') errors FROM k)"""


def _validated(spark, sf):
    return records.validate(_raw(spark, sf).select("raw_record_id", "schema_version", "payload").dropDuplicates(["raw_record_id"]))


@query(f"{_VALIDATED} SELECT raw_record_id, errors FROM v")
def validate_records(spark, sf):
    return _validated(spark, sf).select("raw_record_id", F.concat_ws(",", "errors").alias("errors"))


@query(f"{_VALIDATED} SELECT error, count(*) n FROM (SELECT unnest(string_split(errors, ',')) error FROM v WHERE errors <> '') GROUP BY error")
def validation_error_counts(spark, sf):
    return _validated(spark, sf).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _field(name: str) -> str:
    a, b = records.FIELDS[name]
    return f"CASE WHEN schema_version = 'source_a.v1' THEN j->>'$.{a}' ELSE j->>'$.{b}' END"


_TRIM = r"regexp_replace(regexp_replace(nfc_normalize({}), '^[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ''), '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '')"


@query(f"""{_VALIDATED}, g AS (SELECT k.* FROM k JOIN v USING (raw_record_id) WHERE errors = '')
SELECT raw_record_id, epoch_us(CAST(CASE WHEN length({_field('occurred_at')}) = 10 THEN concat({_field('occurred_at')}, 'T00:00:00Z') ELSE replace({_field('occurred_at')}, ',', '.') END AS TIMESTAMPTZ)) occurred_us, CAST({_field('amount')} AS DECIMAL(20,4)) amount, upper({_field('currency')}) currency, {_field('direction')} direction, nullif({_TRIM.format(_field('description'))}, '') description FROM g""")
def normalize_canonical(spark, sf):
    good = _validated(spark, sf).filter(F.size("errors") == 0)
    c = records.canonical_columns()
    return good.select("raw_record_id", F.unix_micros(c["occurred_at"]).alias("occurred_us"), *[c[k].alias(k) for k in ("amount", "currency", "direction", "description")])


@query("SELECT doc_id, nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')) text FROM documents")
def nfc_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nfc(newlines(F.col("text"))).alias("text"))


_FINGERPRINT = """WITH r AS (SELECT DISTINCT raw_record_id, content_fingerprint, payload::JSON j FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), e AS (SELECT raw_record_id, content_fingerprint, unnest(json_keys(j)) k, j FROM r)"""


@query(f"""{_FINGERPRINT}, v AS (SELECT raw_record_id, content_fingerprint, k, json_extract_string(j, concat('$."', k, '"')) t FROM e)
SELECT raw_record_id, sha256(concat('{{', string_agg(concat(to_json(k), ':', CASE WHEN t IS NULL THEN 'null' ELSE to_json(nfc_normalize(regexp_replace(t, '\\r\\n?', chr(10), 'g')))::VARCHAR END), ',' ORDER BY k), '}}')) fingerprint FROM v GROUP BY raw_record_id""")
def content_fingerprint(spark, sf):
    rows = _raw(spark, sf).select("raw_record_id", "payload").dropDuplicates(["raw_record_id"])
    return rows.select("raw_record_id", records.canonical_json().alias("j")).filter("j is not null").select("raw_record_id", F.sha2("j", 256).alias("fingerprint"))


@query("SELECT count(DISTINCT canonical_id) n_rows, CAST(count(DISTINCT CASE WHEN canonical_id <> concat('can:', raw_record_id, ':', normalization_version, ':', canonical_version) THEN canonical_id END) AS BIGINT) mismatches FROM canonical_transactions")
def canonical_identity(spark, sf):
    t = table(spark, sf, "canonical_transactions").select("canonical_id", "raw_record_id", "normalization_version", "canonical_version").distinct()
    wrong = F.col("canonical_id") != F.concat(F.lit("can:"), "raw_record_id", F.lit(":"), "normalization_version", F.lit(":"), F.col("canonical_version").cast("string"))
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("mismatches"))


@query("""SELECT DISTINCT canonical_id, concat(strftime(make_timestamp(epoch_us(occurred_at)), '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN '' ELSE concat('.', lpad(CAST(epoch_us(occurred_at) % 1000000 AS VARCHAR), 6, '0')) END, '+00:00') occurred_iso, CAST(amount AS VARCHAR) amount_text FROM canonical_transactions""")
def canonical_texts(spark, sf):
    t = table(spark, sf, "canonical_transactions")
    return t.select("canonical_id", records.iso_instant(F.col("occurred_at")).alias("occurred_iso"), F.col("amount").cast("string").alias("amount_text")).distinct()


@query("SELECT sha256(text) fingerprint, min(doc_id) doc_id, count(*) copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def fingerprint_dedup(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT source_id, canonical_fingerprint, min(canonical_id) first_id, count(DISTINCT canonical_id) ids FROM canonical_transactions GROUP BY ALL HAVING count(DISTINCT canonical_id) > 1")
def fingerprint_duplicates(spark, sf):
    ids = table(spark, sf, "canonical_transactions").select("source_id", "canonical_fingerprint", "canonical_id").distinct()
    return ids.groupBy("source_id", "canonical_fingerprint").agg(F.min("canonical_id").alias("first_id"), F.count(F.lit(1)).alias("ids")).filter("ids > 1")


@query("SELECT source_id, raw_record_id, min(seq) seq, min_by(batch_id, seq) batch_id, min_by(epoch_us(accepted_at), seq) accepted_us FROM raw_records GROUP BY ALL")
def submission_dedup(spark, sf):
    rows = _raw(spark, sf).select("source_id", "raw_record_id", "seq", "batch_id", F.unix_micros("accepted_at").alias("accepted_us"))
    return records.first_submissions(rows, ["source_id", "raw_record_id"], "seq")


@query("SELECT batch_id, count(DISTINCT raw_record_id) records, CAST(count(*) - count(DISTINCT raw_record_id) AS BIGINT) duplicates FROM raw_records GROUP BY batch_id")
def batch_links(spark, sf):
    per = _raw(spark, sf).groupBy("batch_id", "raw_record_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("batch_id").agg(F.count("raw_record_id").alias("records"), (F.sum("n") - F.count("raw_record_id")).alias("duplicates"))


@query("SELECT count(*) collisions FROM (SELECT content_fingerprint FROM raw_records GROUP BY source_id, schema_version, content_fingerprint HAVING count(DISTINCT payload) > 1)")
def fingerprint_collisions(spark, sf):
    one = _raw(spark, sf).select("source_id", "schema_version", "content_fingerprint", F.xxhash64("payload").alias("p"), F.length("payload").alias("l")).distinct()
    return one.groupBy("source_id", "schema_version", "content_fingerprint").count().filter("count > 1").agg(F.count(F.lit(1)).alias("collisions"))


@query("""WITH f AS (SELECT raw_record_id, source_id, schema_version, source_record_id, content_fingerprint, min(seq) seq, min_by(accepted_at, seq) t FROM raw_records WHERE source_record_id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, max(struct_pack(t := t, i := raw_record_id, c := content_fingerprint)) OVER (PARTITION BY source_id, schema_version, source_record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) x FROM f)
SELECT raw_record_id, seq, CASE WHEN x.c IS DISTINCT FROM content_fingerprint THEN x.i END supersedes FROM p""")
def correction_chain(spark, sf):
    raw = _raw(spark, sf).filter("source_record_id is not null")
    first = raw.groupBy("raw_record_id", "source_id", "schema_version", "source_record_id", "content_fingerprint").agg(F.min("seq").alias("seq"), F.min_by("accepted_at", "seq").alias("t"))
    return records.correction_chain(first, ["source_id", "schema_version", "source_record_id"], "t", "raw_record_id", "seq", "content_fingerprint", reporting.order_blocks(raw, "seq"))


# versions, reports, integrity ----------------------------------------------------------------------


@query(f"{_R} SELECT reconciliation_id, batch_id, outcome, state, reconciliation_version FROM cur")
def current_reconciliations(spark, sf):
    return reporting.current_versions(_recs(spark, sf), "reconciliation_id", "supersedes_reconciliation_id").select("reconciliation_id", "batch_id", "outcome", "state", "reconciliation_version")


@query("""WITH RECURSIVE r AS (SELECT DISTINCT reconciliation_id i, supersedes_reconciliation_id s FROM reconciliations), c AS (SELECT i, i root, 0 depth FROM r WHERE s IS NULL OR s NOT IN (SELECT i FROM r) UNION ALL SELECT r.i, c.root, c.depth + 1 FROM r JOIN c ON r.s = c.i)
SELECT i reconciliation_id, root, depth FROM c""")
def supersession_lineage(spark, sf):
    return reporting.lineage(spark, _recs(spark, sf), "reconciliation_id", "supersedes_reconciliation_id")


@query("""WITH f AS (SELECT raw_record_id, min(seq) seq, source_id FROM raw_records GROUP BY raw_record_id, source_id), e AS (SELECT source_id entity, concat('ingest:', raw_record_id) event_id, seq FROM f)
SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY seq, event_id) sequence FROM e""")
def audit_trail(spark, sf):
    e = _raw(spark, sf).groupBy("raw_record_id", "source_id").agg(F.min("seq").alias("seq")).select(F.col("source_id").alias("entity"), F.concat(F.lit("ingest:"), "raw_record_id").alias("event_id"), "seq")
    return reporting.gapless_sequence(e, ["entity"], ["seq", "event_id"], reporting.order_blocks(_raw(spark, sf), "seq")).select("entity", "event_id", F.col("sequence").cast("bigint").alias("sequence"))


_COUNTS = ("MATCHED", "MISMATCHED", "AMBIGUOUS", "DUPLICATE")
_COUNTERS = f"""{_R}, b AS (SELECT batch_id, count(*) decided, {", ".join(f"count_if(outcome = '{o}') {o.lower()}" for o in _COUNTS)}, count_if(outcome IN ('UNMATCHED_A', 'UNMATCHED_B')) unmatched, count_if(outcome IS NULL) undecided, count_if(outcome = 'INVALID') invalid FROM r WHERE supersedes_reconciliation_id IS NULL GROUP BY batch_id)"""


def _counters(spark, sf):
    roots = _recs(spark, sf).filter("supersedes_reconciliation_id is null")
    o = F.col("outcome")
    return roots.groupBy("batch_id").agg(F.count(F.lit(1)).alias("decided"), *[F.count_if(o == x).alias(x.lower()) for x in _COUNTS], F.count_if(o.isin("UNMATCHED_A", "UNMATCHED_B")).alias("unmatched"), F.count_if(o.isNull()).alias("undecided"), F.count_if(o == "INVALID").alias("invalid"))


@query(f"{_COUNTERS} SELECT * FROM b")
def batch_counters(spark, sf):
    return _counters(spark, sf)


@query(f"""{_R} SELECT coalesce(outcome, state) outcome, count(*) n_all, CAST(count_if(reconciliation_id IN (SELECT reconciliation_id FROM cur)) AS BIGINT) n_current FROM r GROUP BY 1""")
def report_summary(spark, sf):
    r = _recs(spark, sf)
    gone = r.filter("supersedes_reconciliation_id is not null").select(F.col("supersedes_reconciliation_id").alias("reconciliation_id"), F.lit(1).alias("gone")).distinct()
    return r.join(gone, "reconciliation_id", "left").groupBy(F.coalesce("outcome", "state").alias("outcome")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("gone").isNull()).alias("n_current"))


@query(f"{_R} SELECT outcome, count(*) n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DOUBLE) share FROM cur GROUP BY outcome")
def match_rate_share(spark, sf):
    from pyspark.sql import Window

    per = reporting.current_versions(_recs(spark, sf), "reconciliation_id", "supersedes_reconciliation_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))


@query("SELECT count(*) n, epoch_us(max(accepted_at)) latest_us FROM raw_records")
def watermark(spark, sf):
    return _raw(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("accepted_at")).alias("latest_us"))


@query(f"{_R} SELECT r.reconciliation_id, b.source_id FROM r JOIN batches b USING (batch_id) WHERE b.source_id IN ('source-a', 'source-b')")
def scope_filtered_rows(spark, sf):
    b = table(spark, sf, "batches").filter(F.col("source_id").isin("source-a", "source-b")).select("batch_id", "source_id")
    return _recs(spark, sf).select("reconciliation_id", "batch_id").join(b, "batch_id").select("reconciliation_id", "source_id")


@query("SELECT event_id, CASE WHEN regexp_matches(lower(k), 'payload|description|secret|token|credential') THEN '[REDACTED]' ELSE v END \"value\", k \"key\" FROM (SELECT event_id, unnest(['event_type', 'session_token', 'Description']) k, unnest([event_type, CAST(user_id AS VARCHAR), props]) v FROM events)")
def export_redacted(spark, sf):
    m = F.map_from_arrays(F.array(*map(F.lit, ("event_type", "session_token", "Description"))), F.array("event_type", F.col("user_id").cast("string"), "props"))
    return table(spark, sf, "events").select("event_id", F.explode(reporting.redact(m, EXPORT_TERMS)).alias("key", "value"))


@query(f"{_R} SELECT reconciliation_id, outcome, state FROM cur WHERE outcome IN ('MISMATCHED', 'AMBIGUOUS') ORDER BY outcome, reconciliation_id LIMIT 5")
def open_queue_topk(spark, sf):
    return reporting.current_versions(_recs(spark, sf), "reconciliation_id", "supersedes_reconciliation_id").filter(F.col("outcome").isin("MISMATCHED", "AMBIGUOUS")).orderBy("outcome", "reconciliation_id").limit(5).select("reconciliation_id", "outcome", "state")


_FKS = (("raw_to_batch", "raw_records", "batch_id", "batches", "batch_id"), ("raw_to_source", "raw_records", "source_id", "sources", "source_id"), ("canonical_to_raw", "canonical_transactions", "raw_record_id", "raw_records", "raw_record_id"), ("reconciliation_to_a", "reconciliations", "source_a_record_id", "canonical_transactions", "canonical_id"), ("reconciliation_to_old", "reconciliations", "supersedes_reconciliation_id", "reconciliations", "reconciliation_id"), ("candidate_to_a", "match_candidates", "source_a_canonical_id", "canonical_transactions", "canonical_id"))


@query(" UNION ALL ".join(f"SELECT '{n}' reference, count(DISTINCT {c}) violations FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)" for n, t, c, p, k in _FKS))
def referential_violations(spark, sf):
    out = None
    for n, t, c, p, k in _FKS:
        one = reporting.foreign_key_violations(n, table(spark, sf, t), c, table(spark, sf, p), k)
        out = one if out is None else out.unionByName(one)
    return out


_EVENT_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
_EDGES = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]


@query(" UNION ALL ".join(f"SELECT '{e}' le, count_if(\"value\" <= {e}) n FROM events" for e in _EDGES) + " UNION ALL SELECT '+Inf', count(\"value\") FROM events")
def latency_histogram(spark, sf):
    return reporting.cumulative_histogram(table(spark, sf, "events"), "value", _EDGES)


_RANKED = """r AS (SELECT event_type, "value" v, row_number() OVER (PARTITION BY event_type ORDER BY "value") i, count(*) OVER (PARTITION BY event_type) n FROM events WHERE "value" IS NOT NULL)"""


@query(f"""WITH {_RANKED}, k AS (SELECT DISTINCT event_type, n, greatest(1, least(n, CAST(round_even(0.95 * n, 0) AS BIGINT))) r, greatest(1, least(n, CAST(ceil(CAST(0.95 AS DOUBLE) * n) AS BIGINT))) u, greatest(1, least(n, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT))) c FROM r)
SELECT k.event_type, k.n, max(v) FILTER (i = k.r) rounded, max(v) FILTER (i = k.u) up, max(v) FILTER (i = k.c) cut FROM r JOIN k USING (event_type) GROUP BY 1, 2""")
def latency_p95(spark, sf):
    """The three nearest-rank variants of the 95th percentile."""
    return reporting.ranked_values(Scratch(spark, "p95"), table(spark, sf, "events"), ["event_type"], "value", reporting.nearest_ranks(0.95))


@query("""SELECT event_type, count(*) n, median("value") middle, max("value") peak, count(*) / median("value") per_second FROM events GROUP BY event_type""")
def throughput(spark, sf):
    """Rows, median, maximum, and rows by median time of each group, the median exact and distributed."""
    events, n = table(spark, sf, "events"), F.col("n")
    ranks = {"low": F.floor((n + 1) / 2).cast("bigint"), "high": F.ceil((n + 1) / 2).cast("bigint"), "peak": n}
    r = reporting.ranked_values(Scratch(spark, "median"), events, ["event_type"], "value", ranks)
    middle = (F.col("low") + F.col("high")) / 2
    return r.select("event_type", "n", middle.alias("middle"), "peak", F.try_divide(n, middle).alias("per_second"))


@query("SELECT count_if(event_type = 'error') errors, count(*) n, count_if(event_type = 'error') / count(*) ratio FROM events")
def error_ratio(spark, sf):
    e = F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").agg(e.alias("errors"), F.count(F.lit(1)).alias("n"), F.try_divide(e, F.count(F.lit(1))).alias("ratio"))


@query("SELECT event_type route, CAST(floor(epoch_us(ts) / 300000000) * 300 AS BIGINT) window_s, count(*) n, count(*) / 300.0 per_second FROM events GROUP BY ALL".replace("count(*) / 300.0 per_second", "CAST(count(*) AS DOUBLE) / 300 per_second"))
def rate_by_route_5m(spark, sf):
    w = F.window("ts", "5 minutes")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("route"), w).agg(F.count(F.lit(1)).alias("n")).select("route", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', window.start)").alias("window_s"), "n", (F.col("n").cast("double") / 300).alias("per_second"))


@query("""WITH c AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) h, count(*) n FROM events GROUP BY ALL), t AS (SELECT event_type, h, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY h) AS BIGINT) counter FROM c)
SELECT event_type, h "hour", counter, counter - coalesce(lag(counter) OVER (PARTITION BY event_type ORDER BY h), 0) increase FROM t""")
def counter_increase(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("hour")
    per = table(spark, sf, "events").groupBy("event_type", F.floor(F.expr(_EVENT_US) / 3_600_000_000).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("counter", F.sum("n").over(w)).select("event_type", "hour", "counter", (F.col("counter") - F.coalesce(F.lag("counter").over(w), F.lit(0))).alias("increase"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, event_id, i, t, t s, 1 n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, e.t, CASE WHEN e.t - w.s >= 86400000000 THEN e.t ELSE w.s END, CASE WHEN e.t - w.s >= 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, n <= 2 allowed FROM w""")
def rate_limiter(spark, sf):
    return reporting.fixed_window_limiter(table(spark, sf, "events").withColumn("us", F.expr(_EVENT_US)), "user_id", "us", "event_id", 86_400, 2)


# streams ------------------------------------------------------------------------------------------


def _as_stream(spark, sf, scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch.root}/{name}-files"
    df.repartition(4).write.parquet(path)
    return ingest.file_stream(spark, path)


@query("SELECT DISTINCT source_id, raw_record_id, schema_version, payload, content_fingerprint FROM raw_records")
def stream_ingest_dedup(spark, sf):
    """Whole raw records as a stream, each kept once."""
    scratch = Scratch(spark, "stream")
    stream = _as_stream(spark, sf, scratch, _raw(spark, sf), "raw")
    ingest.ingest_once(stream, f"{scratch.root}/ingested", f"{scratch.root}/checkpoint", ["source_id", "raw_record_id"], "seq")
    return spark.read.parquet(f"{scratch.root}/ingested").select("source_id", "raw_record_id", "schema_version", "payload", "content_fingerprint")


@query("SELECT source_id, count(*) n_published, CAST(sum(seq) AS BIGINT) seq_published FROM raw_records WHERE accepted_at IS NOT NULL GROUP BY source_id")
def stream_partials(spark, sf):
    """Partials of a stream by day of acceptance, combined on read; equal to the batch result."""
    from tallyweave.operators.late_events import with_fate

    scratch = Scratch(spark, "partials")
    stream = _as_stream(spark, sf, scratch, _raw(spark, sf).select("source_id", "accepted_at", "seq"), "raw")
    events = with_fate(stream, "accepted_at", "accepted_at")
    ingest.accumulate_partials(events, f"{scratch.root}/store", f"{scratch.root}/checkpoint", ["source_id"], {"seq": F.col("seq")})
    days = ingest.read_periods(spark, f"{scratch.root}/store", ["source_id"], ["seq"])
    return days.groupBy("source_id").agg(F.sum("n_published").alias("n_published"), F.sum("seq_published").alias("seq_published"))


@query(f"""WITH {_FATES} SELECT source_id, CAST(DATE '1970-01-01' + CAST(day_n AS INT) AS DATE) "day", count(*) FILTER (fate = 'on_time') n_published, count(*) FILTER (fate <> 'dropped') n_corrected, count(*) FILTER (fate = 'dropped') n_dropped,
 coalesce(sum(amount) FILTER (fate = 'on_time'), 0) amount_published, coalesce(sum(amount) FILTER (fate <> 'dropped'), 0) amount_corrected, coalesce(sum(amount) FILTER (fate = 'dropped'), 0) amount_dropped FROM e WHERE fate IS NOT NULL GROUP BY 1, 2""")
def stream_late_daily(spark, sf):
    """Current transactions as a stream, by day of occurrence: published, corrected and refused as too late."""
    from tallyweave.operators.late_events import with_fate

    scratch = Scratch(spark, "late-stream")
    stream = _as_stream(spark, sf, scratch, _p2_events(spark, sf).select("source_id", "occurred_at", "arrived", "amount"), "current")
    ingest.accumulate_partials(with_fate(stream, "occurred_at", "arrived"), f"{scratch.root}/store", f"{scratch.root}/checkpoint", ["source_id"], {"amount": F.col("amount")})
    return ingest.read_periods(spark, f"{scratch.root}/store", ["source_id"], ["amount"])


def _in_order(spark, scratch: Scratch, parts: list[DataFrame], name: str) -> DataFrame:
    """A stream of one file per part, in their order."""
    path = f"{scratch.root}/{name}-files"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return ingest.file_stream(spark, path)


@query(SQL["rate_limiter"])
def stream_rate_limiter(spark, sf):
    """The limiter with its state carried from micro-batch to micro-batch."""
    scratch = Scratch(spark, "limiter")
    events = table(spark, sf, "events").withColumn("us", F.expr(_EVENT_US)).select("user_id", "event_id", "us")
    mid = (events.agg(F.avg("us").cast("long").alias("m")).first() or [0])[0] or 0
    stream = _in_order(spark, scratch, [events.filter(F.col("us") < mid), events.filter(F.col("us") >= mid)], "events")
    allowed = ingest.limit_rate(stream, "user_id", "us", "event_id", 86_400, 2)
    allowed.writeStream.format("parquet").option("path", f"{scratch.root}/out").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, allowed boolean").parquet(f"{scratch.root}/out")


@query(_WAVES.replace("SELECT f.a, f.b, f.outcome", "SELECT a, b, outcome, CAST(1 AS INT) \"version\", NULL old_a, NULL old_b FROM w1 UNION ALL SELECT f.a, f.b, f.outcome"))
def stream_versions(spark, sf):
    """Side A and most of side B arrive first, the rest of B late: the stream appends what the late records change."""
    scratch = Scratch(spark, "versions-stream")
    a, b = _ab(spark, sf)

    def decide(own: Scratch, records: DataFrame) -> DataFrame:
        return matching.decide(own, records.filter("side = 'A'"), records.filter("side = 'B'"))

    for wave in (a.unionByName(b.filter("k % 5 <> 0")), b.filter("k % 5 = 0")):
        arrived = scratch.put(wave, "arrived", "arrived")  # the stream goes on where it ended; what it has taken in isn't kept twice
        ingest.version_decisions(ingest.file_stream(spark, arrived._tallyweave_path, None), f"{scratch.root}/table", f"{scratch.root}/checkpoint", decide)
        scratch.drop(arrived)
    return spark.read.parquet(f"{scratch.root}/table/versions").select("a", "b", "outcome", "version", "old_a", "old_b")


@query(f"{_FEEDS}{_CAND}{_SEL} SELECT outcome, a, b, rule FROM dec")
def stream_reconcile(spark, sf):
    """Both feeds arrive as streams of files; every record is re-evaluated globally, none is dropped."""
    scratch = Scratch(spark, "stream")
    for name, df in zip("ab", _ab(spark, sf)):
        ingest.ingest_once(_as_stream(spark, sf, scratch, df, name), f"{scratch.root}/{name}", f"{scratch.root}/checkpoint-{name}", ["rid"], "k")
    a, b = (spark.read.parquet(f"{scratch.root}/{n}").drop("batch_n", "part") for n in "ab")
    return matching.decide(scratch, a, b)
