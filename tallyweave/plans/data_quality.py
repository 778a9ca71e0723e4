"""The queries of the general operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.copy_diff import CopyPair, copy_differences
from tallyweave.functions.text import strip
from tallyweave.operators.instant_dictionary import InstantDictionary
from tallyweave.operators.late_events import combine, merge_partials, partials, with_fate
from tallyweave.sources.tables import Scratch, table

CANONICAL_FIELDS = {"source_record_id": "text", "occurred_at": "instant", "amount": "decimal", "currency": "text", "direction": "text", "account_reference": "text", "transaction_reference": "text", "description": "text"}
RECONCILIATION_FIELDS = {"source_a_record_id": "text", "source_b_record_id": "text", "state": "text", "outcome": "text"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return copy_differences(
        spark,
        [
            CopyPair("canonical_transactions", t("canonical_transactions"), t("canonical_restored"), "canonical_id", CANONICAL_FIELDS, "copied_at", "is_deleted"),
            CopyPair("reconciliations", t("reconciliations"), t("reconciliations_restored"), "reconciliation_id", RECONCILIATION_FIELDS, "copied_at", "is_deleted"),
        ],
    )


def _p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current transactions with arrival, day and fate."""
    can = table(spark, sf_dir, "canonical_transactions").select("canonical_id", "source_id", "raw_record_id", "occurred_at", "amount", "supersedes_canonical_id")
    arrivals = table(spark, sf_dir, "raw_records").groupBy("raw_record_id").agg(F.min("accepted_at").alias("arrived"))
    superseded = can.filter(F.col("supersedes_canonical_id").isNotNull()).select(F.col("supersedes_canonical_id").alias("canonical_id")).distinct()
    current = can.drop("supersedes_canonical_id").dropDuplicates(["canonical_id"]).join(superseded, "canonical_id", "left_anti")
    return with_fate(current.join(arrivals, "raw_record_id", "left"), "occurred_at", "arrived")


def _rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["reconciliation_id", "source_a_record_id", "source_b_record_id", "outcome", "supersedes_reconciliation_id"]
    return table(spark, sf_dir, "reconciliations").select(*cols).dropDuplicates(["reconciliation_id"])


def _links(rec: DataFrame) -> DataFrame:
    return rec.select("reconciliation_id", F.explode(F.array_distinct(F.filter(F.array("source_a_record_id", "source_b_record_id"), lambda x: x.isNotNull()))).alias("canonical_id"))


def _corrections(rec: DataFrame, events: DataFrame) -> DataFrame:
    """reconciliation_id of rows superseded by one that brings in a late transaction and no dropped one."""
    fates = events.filter(F.col("fate").isin("late", "dropped")).select("canonical_id", "fate")
    new = rec.filter(F.col("supersedes_reconciliation_id").isNotNull())
    named = _links(new.select("reconciliation_id", "source_a_record_id", "source_b_record_id")).join(fates, "canonical_id")
    of = named.groupBy("reconciliation_id").agg(F.collect_set(F.when(F.col("fate") == "late", F.col("canonical_id"))).alias("late"), F.max((F.col("fate") == "dropped").cast("int")).alias("dropped"))
    pairs = new.join(of.filter("dropped = 0"), "reconciliation_id").select(F.col("supersedes_reconciliation_id").alias("reconciliation_id"), "late")
    old = rec.select("reconciliation_id", F.array("source_a_record_id", "source_b_record_id").alias("had"))
    return old.join(pairs, "reconciliation_id").filter(F.size(F.array_except("late", "had")) > 0).select("reconciliation_id").distinct()


def _stored(scratch: Scratch, events: DataFrame, sums: dict) -> tuple[DataFrame, DataFrame]:
    """The partials of events merged into a new store, and the refused ones; both as tables."""
    arriving = scratch.put(partials(events, ["source_id"], sums), "arriving")
    store, refused = merge_partials(arriving.limit(0), arriving, ["source_id"], list(sums))
    return scratch.put(store, "store"), scratch.put(refused, "refused")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fates by the stored partials: what merging at the arrival hour takes or refuses decides for its records."""
    scratch = Scratch(spark, "late")
    events = scratch.put(_p2_events(spark, sf_dir).select("canonical_id", "source_id", "day", "slot", "fate"), "events")
    store, refused = _stored(scratch, events, {})
    periods = store.filter("fate = 'late'").select("source_id", "day", "slot", "fate").unionByName(refused.select("source_id", "day", "slot", F.lit("dropped").alias("fate")))
    e, p = events.drop("fate").alias("e"), periods.alias("p")
    same = F.col("e.source_id").eqNullSafe(F.col("p.source_id")) & (F.col("e.day") == F.col("p.day")) & (F.col("e.slot") == F.col("p.slot"))
    fates = scratch.put(e.join(p, same).select("canonical_id", "fate"), "fates")
    corrected = _corrections(_rec(spark, sf_dir), fates).select(F.col("reconciliation_id").alias("record_key"), F.lit("corrected").alias("fate"))
    return fates.select(F.col("canonical_id").alias("record_key"), "fate").unionByName(corrected)


# The outcomes of decisions about records.
OUTCOMES = ("MATCHED", "MISMATCHED", "UNMATCHED_A", "UNMATCHED_B", "AMBIGUOUS", "DUPLICATE")


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and day: counts and sums as published, corrected and dropped, and outcome counts.

    The published outcomes are those of reconciliations that no row supersedes or that were
    superseded by a correction only; the corrected ones are those of the current rows.
    """
    scratch = Scratch(spark, "daily")
    events = scratch.put(_p2_events(spark, sf_dir).select("canonical_id", "source_id", "amount", "day", "slot", "fate"), "events")
    rec = _rec(spark, sf_dir)
    corrected = _corrections(rec, events).withColumn("was_corrected", F.lit(True))
    superseded = rec.filter(F.col("supersedes_reconciliation_id").isNotNull()).select(F.col("supersedes_reconciliation_id").alias("reconciliation_id"), F.lit(True).alias("superseded")).distinct()
    state = rec.join(superseded, "reconciliation_id", "left").join(corrected, "reconciliation_id", "left").filter("superseded is null or was_corrected")
    links = _links(state).join(state.select("reconciliation_id", "outcome", F.col("superseded").isNull().alias("current")), "reconciliation_id")
    per = links.groupBy("canonical_id").agg(
        F.max(F.when(F.col("current"), F.struct("reconciliation_id", "outcome")))["outcome"].alias("outcome_now"),
        F.max(F.struct(~F.col("current"), "reconciliation_id", "outcome"))["outcome"].alias("outcome_then"),
    )
    known = events.join(per, "canonical_id", "left")
    sums = {"amount": F.col("amount")} | {o.lower(): F.when(F.col("outcome_now") == o, 1).otherwise(0) for o in OUTCOMES} | {f"first_{o.lower()}": F.when((F.col("fate") == "on_time") & (F.col("outcome_then") == o), 1).otherwise(0) for o in OUTCOMES}
    store, refused = _stored(scratch, known, sums)
    daily = combine(store.unionByName(refused), ["source_id"], list(sums))
    keep = {"source_id": "source_id", "day": "day", "n_published": "n_published", "n_corrected": "n_corrected", "n_dropped": "n_dropped", "amount_published": "amount_published", "amount_corrected": "amount_corrected", "amount_dropped": "amount_dropped"}
    keep |= {f"first_{o.lower()}_published": f"{o.lower()}_published" for o in OUTCOMES} | {f"{o.lower()}_corrected": f"{o.lower()}_corrected" for o in OUTCOMES}
    return daily.select(*[F.col(k).alias(v) for k, v in keep.items()])


def pending_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_record_id, seq (first arrival), value, zone, locale of the raw records that no canonical transaction names."""
    raw = table(spark, sf_dir, "raw_records").filter(F.col("raw_record_id").isNotNull())
    whole = strip(F.col("payload")).endswith("}")
    fields = F.from_json("payload", "map<string,string>")
    value = F.when(whole & (F.col("schema_version") == "source_a.v1"), fields["occurred_at"]).when(whole & (F.col("schema_version") == "source_b.v1"), fields["posted"])
    one = raw.select("raw_record_id", "source_id", value.alias("value"), "seq").groupBy("raw_record_id").agg(F.min(F.struct("source_id", "value")).alias("r"), F.min("seq").alias("seq"))
    named = table(spark, sf_dir, "canonical_transactions").select("raw_record_id").filter(F.col("raw_record_id").isNotNull()).distinct()
    zones = table(spark, sf_dir, "sources").select("source_id", F.col("time_zone").alias("zone"), "locale").dropDuplicates(["source_id"])
    return one.join(named, "raw_record_id", "left_anti").select("raw_record_id", "seq", "r.*").join(zones, "source_id", "left").drop("source_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "instants")
    rows = scratch.put(pending_values(spark, sf_dir).filter(F.col("value").isNotNull()), "pending")
    known, last, done = InstantDictionary(spark), rows.agg(F.max("seq").alias("n")).first()["n"] or 0, None
    second = F.coalesce(F.col("seq") > last // 2, F.lit(False))
    for batch in (~second, second):  # as they arrive: each half only adds the values that the dictionary doesn't have
        # stored, as Spark takes scans of one folder for equal although files were added in between
        part = scratch.put(known.normalise(rows.filter(batch), "raw_record_id", "value", "zone", "locale").select("raw_record_id", "micros"), "instants")
        done = part if done is None else done.unionByName(part)
    return done.select("raw_record_id", F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros("micros").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at_utc"))


def _text(c: str) -> str:
    return f"nullif(trim(nfc_normalize({c})), '')"


def _diff_sql(name: str, copy: str, key: str, fields: dict[str, str]) -> str:
    def sides(f: str, kind: str) -> str:
        if kind == "decimal":
            return f"CAST(o.{f} AS DECIMAL(38,10)) IS DISTINCT FROM try_cast({_text('c.' + f)} AS DECIMAL(38,10))"
        if kind == "instant":
            return f"o.{f} IS DISTINCT FROM try_cast({_text('c.' + f)} AS TIMESTAMPTZ)"
        return f"{_text('o.' + f)} IS DISTINCT FROM {_text('c.' + f)}"

    latest = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY copied_at DESC) rn FROM {copy}) WHERE rn = 1 AND NOT is_deleted)"
    orig = f"(SELECT DISTINCT {key}, {', '.join(fields)} FROM {name})"
    out = [f"SELECT '{name}' table_name, {key} record_key, 'missing_in_copy' diff_kind, '' field_name FROM {orig} o WHERE NOT EXISTS (SELECT 1 FROM {latest} c WHERE c.{key} = o.{key})", f"SELECT '{name}', {key}, 'missing_in_original', '' FROM {latest} c WHERE NOT EXISTS (SELECT 1 FROM {name} o WHERE c.{key} = o.{key})"]
    out += [f"SELECT '{name}', o.{key}, 'value', '{f}' FROM {orig} o JOIN {latest} c ON o.{key} = c.{key} WHERE {sides(f, k)}" for f, k in fields.items()]
    return " UNION ALL ".join(out)


_FATES = """t AS (SELECT DISTINCT canonical_id, source_id, raw_record_id, occurred_at, amount FROM canonical_transactions WHERE canonical_id NOT IN (SELECT supersedes_canonical_id FROM canonical_transactions WHERE supersedes_canonical_id IS NOT NULL)),
arr AS (SELECT raw_record_id, min(accepted_at) arr_at FROM raw_records GROUP BY 1),
f AS (SELECT t.*, CAST(floor(epoch_us(occurred_at) / 86400000000) AS BIGINT) day_n, epoch_us(arr_at) us, (CAST(floor(epoch_us(occurred_at) / 86400000000) AS BIGINT) + 1) * 86400000000 day_end FROM t LEFT JOIN arr USING (raw_record_id)),
e AS (SELECT *, CASE WHEN us >= day_end + 168 * 3600000000 THEN 'dropped' WHEN us >= day_end + 6 * 3600000000 THEN 'late' WHEN us IS NOT NULL THEN 'on_time' END fate FROM f),
r AS (SELECT DISTINCT reconciliation_id, source_a_record_id a, source_b_record_id b, outcome, supersedes_reconciliation_id s FROM reconciliations),
corrected AS (SELECT DISTINCT o.reconciliation_id FROM r n JOIN r o ON n.s = o.reconciliation_id LEFT JOIN e ea ON ea.canonical_id = n.a LEFT JOIN e eb ON eb.canonical_id = n.b
 WHERE coalesce(ea.fate, '') <> 'dropped' AND coalesce(eb.fate, '') <> 'dropped' AND ((ea.fate = 'late' AND n.a IS DISTINCT FROM o.a AND n.a IS DISTINCT FROM o.b) OR (eb.fate = 'late' AND n.b IS DISTINCT FROM o.a AND n.b IS DISTINCT FROM o.b)))"""


def _daily_sql() -> str:
    o = [(x, x.lower()) for x in OUTCOMES]
    return f"""WITH {_FATES}, st AS (SELECT r.*, (SELECT count(*) FROM r n WHERE n.s = r.reconciliation_id) = 0 cur FROM r), keep AS (SELECT * FROM st WHERE cur OR reconciliation_id IN (SELECT reconciliation_id FROM corrected)),
links AS (SELECT a canonical_id, reconciliation_id, outcome, cur FROM keep WHERE a IS NOT NULL UNION SELECT b, reconciliation_id, outcome, cur FROM keep WHERE b IS NOT NULL),
per AS (SELECT canonical_id, max(CASE WHEN cur THEN struct_pack(i := reconciliation_id, o := outcome) END).o now_o, max(struct_pack(c := NOT cur, i := reconciliation_id, o := outcome)).o then_o FROM links GROUP BY 1)
SELECT source_id, CAST(DATE '1970-01-01' + CAST(day_n AS INT) AS DATE) "day", count(*) FILTER (fate = 'on_time') n_published, count(*) FILTER (fate <> 'dropped') n_corrected, count(*) FILTER (fate = 'dropped') n_dropped,
 coalesce(sum(amount) FILTER (fate = 'on_time'), 0) amount_published, coalesce(sum(amount) FILTER (fate <> 'dropped'), 0) amount_corrected, coalesce(sum(amount) FILTER (fate = 'dropped'), 0) amount_dropped,
 {", ".join(f"count(*) FILTER (fate = 'on_time' AND then_o = '{x}') {y}_published" for x, y in o)}, {", ".join(f"count(*) FILTER (fate <> 'dropped' AND now_o = '{x}') {y}_corrected" for x, y in o)}
FROM e LEFT JOIN per USING (canonical_id) WHERE fate IS NOT NULL GROUP BY 1, 2"""


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_daily": p2_daily, "p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _diff_sql("canonical_transactions", "canonical_restored", "canonical_id", CANONICAL_FIELDS) + " UNION ALL " + _diff_sql("reconciliations", "reconciliations_restored", "reconciliation_id", RECONCILIATION_FIELDS),
        "p2_found": f"WITH {_FATES} SELECT canonical_id record_key, fate FROM e WHERE fate IN ('late', 'dropped') UNION ALL SELECT reconciliation_id, 'corrected' FROM corrected",
        "p2_daily": _daily_sql(),
    }
