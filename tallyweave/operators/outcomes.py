"""Normalisation results, identities of canonical rows, and what became of each raw record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import records
from tallyweave.operators.matching import identity

# The fields that the canonical fingerprint covers, in the order of their JSON.
SEMANTIC = ["account_reference", "amount", "currency", "description", "direction", "occurred_at", "transaction_reference", "transaction_status", "transaction_type"]
# Digits before the point of an amount that still fits, and of one that can be rounded to four places.
WHOLE_DIGITS, ROUNDED_DIGITS = 16, 24


def semantic_payload(columns: set[str]) -> Column:
    """The JSON object of a canonical row's meaning; a field without a column is null."""
    at = lambda c: records.iso_instant(F.col(c)) if c == "occurred_at" else F.col(c).cast("string")
    parts = [(at(c) if c in columns else F.lit(None).cast("string")).alias(c) for c in SEMANTIC]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def identity_check(canonical: DataFrame) -> DataFrame:
    """canonical_id, id_ok, fingerprint_ok: whether the stored id and fingerprint are those of the row."""
    can = F.concat(F.lit("can:"), "raw_record_id", F.lit(":"), "normalization_version", F.lit(":"), F.col("canonical_version").cast("string"))
    return canonical.select("canonical_id", F.col("canonical_id").eqNullSafe(can).alias("id_ok"), F.col("canonical_fingerprint").eqNullSafe(F.sha2(semantic_payload(set(canonical.columns)), 256)).alias("fingerprint_ok"))


def canonical_versions(canonical: DataFrame) -> DataFrame:
    """canonical_id, version, supersedes: 1, 2, ... of each raw record, each naming the one before it.

    A raw record has as many versions as normalisations, so its rows are few.
    """
    w = Window.partitionBy("raw_record_id").orderBy("canonical_version", "canonical_id")
    return canonical.select("canonical_id", F.row_number().over(w).alias("version"), F.lag("canonical_id").over(w).alias("supersedes"))


def normalization_results(raw: DataFrame) -> DataFrame:
    """raw_record_id, status, failure_code of rows with ``errors`` (see :func:`records.validate`).

    Invalid rows fail with ``validation_invalid``. Of the valid ones an amount with more digits than can be
    rounded fails with ``invalid_amount``, one with more than the type holds with ``invalid_value``, and an
    instant outside the years 1 to 9999 with ``invalid_amount``, as all arithmetic errors.
    """
    f, c = records.fields(), records.canonical_columns()
    digits = F.length(F.regexp_extract(f["amount"], r"^[+-]?(\d+)", 1))
    code = F.when(F.size("errors") > 0, "validation_invalid").when(digits > ROUNDED_DIGITS, "invalid_amount").when(digits > WHOLE_DIGITS, "invalid_value").when(c["occurred_at"].isNull(), "invalid_amount")
    return raw.select("raw_record_id", code.alias("failure_code")).select("raw_record_id", F.when(F.col("failure_code").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), "failure_code")


def record_outcomes(raw: DataFrame, canonical: DataFrame, decisions: DataFrame) -> DataFrame:
    """raw_record_id, batch_id, outcome of every raw record that has one.

    raw: raw_record_id (unique), batch_id (the first that brought it), invalid (by validation or on
    arrival); canonical: canonical_id, raw_record_id; decisions: reconciliation_id, source_a_record_id,
    source_b_record_id, raw_record_id, outcome, supersedes_reconciliation_id. INVALID comes first; then
    the outcome of the record's canonical row, of a pair for both its records; then that of a decision
    about the raw record itself. Only decisions that supersede nothing count, so a record whose only
    decision is a later version has no outcome. Of several canonical rows the smallest id counts, of
    several decisions the greatest.
    """
    root = decisions.filter("outcome is not null and supersedes_reconciliation_id is null")
    named = root.select("reconciliation_id", "outcome", F.explode(F.array_compact(F.array("source_a_record_id", "source_b_record_id"))).alias("canonical_id"))
    by_canonical = named.groupBy("canonical_id").agg(F.max_by("outcome", "reconciliation_id").alias("by_canonical"))
    by_raw = root.filter("raw_record_id is not null").groupBy("raw_record_id").agg(F.max_by("outcome", "reconciliation_id").alias("by_raw"))
    one = canonical.groupBy("raw_record_id").agg(F.min("canonical_id").alias("canonical_id"))
    both = raw.join(one, "raw_record_id", "left").join(by_canonical, "canonical_id", "left").join(by_raw, "raw_record_id", "left")
    return both.select("raw_record_id", "batch_id", F.when(F.col("invalid"), "INVALID").otherwise(F.coalesce("by_canonical", "by_raw")).alias("outcome")).filter("outcome is not null")


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """batch_id, processed, matched, mismatched, unmatched, ambiguous, duplicate, invalid, in records."""
    o = F.col("outcome")
    return outcomes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(o == x.upper()).alias(x) for x in ("matched", "mismatched")], F.count_if(o.isin("UNMATCHED_A", "UNMATCHED_B")).alias("unmatched"), *[F.count_if(o == x.upper()).alias(x) for x in ("ambiguous", "duplicate", "invalid")])


def counter_violations(batches: DataFrame) -> DataFrame:
    """batch_id, equation of every batch whose counters don't add up.

    batches: batch_id, received, accepted, rejected, processed, failed and the counts of outcomes.
    Missing counters are 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcomes = sum((n(c) for c in ("matched", "mismatched", "unmatched", "ambiguous", "duplicate", "invalid")), F.lit(0))
    rules = {"received": n("received") != n("accepted") + n("rejected"), "processed": n("processed") != outcomes, "accepted": n("processed") + n("failed") > n("accepted")}
    broken = F.array_compact(F.array(*[F.when(bad, k) for k, bad in rules.items()]))
    return batches.select("batch_id", F.explode(broken).alias("equation"))


def apply_resolutions(discrepancies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, versions). discrepancies: discrepancy_id, reconciliation_id, outcome, version; requests:
    discrepancy_id, seq, resolution_type, reason.

    The first request of a discrepancy is applied, ever; later ones change nothing. states has
    discrepancy_id, resolution_id, resolution_type, state for every discrepancy, OPEN without a request.
    AUTOMATIC and MANUAL_APPROVED resolve it and add a version that keeps the outcome; DEFERRED and
    REJECTED only change its state.
    """
    first = requests.groupBy("discrepancy_id").agg(F.min_by(F.struct("resolution_type", "reason"), "seq").alias("q")).select("discrepancy_id", "q.*")
    d = discrepancies.join(first, "discrepancy_id", "left")
    solved = F.col("resolution_type").isin("AUTOMATIC", "MANUAL_APPROVED")
    rid = F.when(F.col("resolution_type").isNotNull(), identity("resolution", F.col("discrepancy_id"), F.col("reconciliation_id"), F.col("resolution_type"), F.trim("reason")))
    d = d.withColumns({"resolution_id": rid, "state": F.when(solved, "RESOLVED").otherwise(F.coalesce("resolution_type", F.lit("OPEN")))})
    versions = d.filter(solved).select(identity("reconciliation", F.col("reconciliation_id"), F.col("resolution_id")).alias("reconciliation_id"), F.col("reconciliation_id").alias("supersedes"), "outcome", (F.col("version") + 1).cast("int").alias("version"), "resolution_id")
    return d.select("discrepancy_id", "resolution_id", "resolution_type", "state"), versions
