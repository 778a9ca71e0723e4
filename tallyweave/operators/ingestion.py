"""Accepting deliveries: idempotency keys, content that is already there, and the result of each delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import strip
from tallyweave.operators import records

REJECTED, NO_ID = "payload must be a JSON object", "missing "


def register_sources(asked: DataFrame) -> DataFrame:
    """source_id, name, schema_versions (sorted, each once), active, conflict: one row per source.

    asked may repeat a source; the same metadata are the same registration, other ones a conflict (then
    the smallest are given). Null versions count as none.
    """
    one = asked.select("source_id", "name", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("schema_versions", F.array().cast("array<string>"))))).alias("schema_versions"), "active").distinct()
    return one.groupBy("source_id").agg(F.min(F.struct("name", "schema_versions", "active")).alias("m"), (F.count(F.lit(1)) > 1).alias("conflict")).select("source_id", "m.*", "conflict")


def create_batches(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """asked with result: ``created``, ``existing`` (an earlier row has the same natural key), or the
    reason of refusal. asked: batch_id, source_id, external_batch_id, schema_version, received_at."""
    key = ["source_id", "external_batch_id", "schema_version"]
    known = asked.join(sources.select("source_id", "schema_versions", "active"), "source_id", "left")
    refused = F.when(~F.coalesce("active", F.lit(False)), "unknown or inactive source").when(~F.coalesce(F.array_contains("schema_versions", F.col("schema_version")), F.lit(False)), "schema version not registered")
    judged = known.withColumn("refused", refused)
    first = judged.filter("refused is null").groupBy(*key).agg(F.min(F.struct("received_at", "batch_id")).alias("f"))
    same = F.col("f.received_at").eqNullSafe(F.col("received_at")) & F.col("f.batch_id").eqNullSafe(F.col("batch_id"))
    return judged.join(first, key, "left").select("batch_id", *key, F.coalesce("refused", F.when(same, "created").otherwise("existing")).alias("result"))


def ingest(deliveries: DataFrame) -> DataFrame:
    """seq, batch_id, raw_record_id, status, fingerprint, invalid_reason, source_record_id, duplicate of each delivery.

    deliveries: seq (unique), source_id, batch_id, schema_version, payload, idempotency_key (or null: the
    content is the key). The first delivery of a source with a key decides; later ones get its result,
    whatever they contain. Content that was linked to the batch before is a duplicate under any key. A
    payload that is no JSON object is REJECTED; one without native id is INVALID and gets one made
    of its fingerprint; the others are ACCEPTED.
    """
    tree, keys = F.try_parse_json("payload"), F.json_object_keys("payload")
    whole = tree.isNotNull() & keys.isNotNull()
    native = F.when(F.col("schema_version") == records.SCHEMAS[0], records.FIELDS["record_id"][0]).otherwise(records.FIELDS["record_id"][1])
    at = lambda kind: F.when(F.col("schema_version") == records.SCHEMAS[0], F.try_variant_get(tree, f"$.{records.FIELDS['record_id'][0]}", kind)).otherwise(F.try_variant_get(tree, f"$.{records.FIELDS['record_id'][1]}", kind))
    named = (F.schema_of_variant(at("variant")) == "STRING") & (strip(at("string")) != "")
    d = deliveries.withColumn("fingerprint", F.when(whole, F.sha2(records.canonical_json(), 256)))
    d = d.select(
        "seq", "source_id", "batch_id", "idempotency_key", "fingerprint",
        F.when(whole, F.concat(F.lit("raw:"), "source_id", F.lit(":"), "schema_version", F.lit(":"), "fingerprint")).alias("raw_record_id"),
        F.when(~whole, REJECTED).when(~F.coalesce(named, F.lit(False)), F.concat(F.lit(NO_ID), native)).alias("invalid_reason"),
        F.when(whole, F.when(F.coalesce(named, F.lit(False)), at("string")).otherwise(F.concat(F.lit("invalid-"), F.substring("fingerprint", 1, 16)))).alias("source_record_id"),
        F.coalesce("idempotency_key", F.when(whole, F.concat(F.lit("raw:"), "source_id", F.lit(":"), "schema_version", F.lit(":"), "fingerprint")), F.concat(F.lit("raw:"), "source_id", F.lit(":"), "schema_version", F.lit(":"), F.sha2(F.coalesce("payload", F.lit("")), 256))).alias("key"),
    )
    status = F.when(F.col("raw_record_id").isNull(), "REJECTED").when(F.col("invalid_reason").isNotNull(), "INVALID").otherwise("ACCEPTED")
    d = d.withColumn("status", status)
    result = ["batch_id", "raw_record_id", "status", "fingerprint", "invalid_reason", "source_record_id"]
    first = d.groupBy("source_id", "key").agg(F.min("seq").alias("first_seq"), F.min_by(F.struct(*result), "seq").alias("original"))
    d = d.join(first, ["source_id", "key"])
    fresh = F.col("seq") == F.col("first_seq")
    # what links content to a batch: a first delivery, or a repeated one without a key of its own
    links = d.filter(F.col("raw_record_id").isNotNull() & (fresh | F.col("idempotency_key").isNull())).groupBy("batch_id", "raw_record_id").agg(F.min("seq").alias("linked_at"))
    d = d.join(links, ["batch_id", "raw_record_id"], "left")
    again = F.coalesce(F.col("linked_at") < F.col("seq"), F.lit(False))
    told = [F.when(fresh, F.col(c)).otherwise(F.col(f"original.{c}")).alias(c) for c in result]
    return d.select("seq", F.col("batch_id").alias("delivered_to"), *told, (~fresh | again).alias("duplicate"))


def ingest_counters(results: DataFrame) -> DataFrame:
    """batch_id, received, accepted, rejected, invalid: what the first deliveries add to their batches."""
    s = F.col("status")
    return results.filter("not duplicate").groupBy(F.col("delivered_to").alias("batch_id")).agg(F.count(F.lit(1)).alias("received"), F.count_if(s != "REJECTED").alias("accepted"), F.count_if(s == "REJECTED").alias("rejected"), F.count_if(s == "INVALID").alias("invalid"))
