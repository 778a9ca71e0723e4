"""Checking, typing and identifying raw JSON records with JVM expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import clean_text, newlines, strip

# Canonical field -> key in the two schema versions, and the required fields.
FIELDS = {"record_id": ("record_id", "id"), "occurred_at": ("occurred_at", "posted"), "amount": ("amount", "value"), "currency": ("currency", "ccy"), "direction": ("direction", "side"), "account_reference": ("account_reference", "account_ref"), "transaction_reference": ("transaction_reference", "reference"), "description": ("description", "memo"), "transaction_type": ("transaction_type", "type")}
REQUIRED = ("amount", "currency", "direction", "occurred_at", "record_id")
SCHEMAS = ("source_a.v1", "source_b.v1")
AMOUNT = r"\A[+-]?(?:0|[1-9][0-9]*)(?:\.[0-9]{1,4})?\z"
OFFSET_TIME = r"\A\d{4}-\d{2}-\d{2}[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})\z"


def _checks(key: str, field: str, v: Column, kind: Column) -> Column:
    """The error of one present field, or null; a value that is no string is only a type error."""
    e = lambda c: F.concat(F.lit(key + "/"), F.lit(c))
    typed = F.when(kind != "STRING", e("type"))
    if field == "record_id":
        return typed.when(strip(v) == "", e("empty"))
    if field == "occurred_at":
        date = F.substring(v, 1, 10).try_cast("date").isNotNull()
        return typed.when(~((v.rlike(r"\A\d{4}-\d{2}-\d{2}\z") | v.rlike(OFFSET_TIME)) & date), e("date"))
    if field == "amount":
        return typed.when(~v.rlike(AMOUNT), e("amount"))
    if field == "currency":
        return typed.when(~v.rlike(r"\A[A-Z]{3}\z"), e("currency"))
    if field == "direction":
        return typed.when(~v.isin("CREDIT", "DEBIT"), e("direction"))
    return typed


def validate(raw: DataFrame, payload: str = "payload", schema: str = "schema_version") -> DataFrame:
    """raw with ``errors``: all errors in a fixed order as ``key/code``; empty if the record is valid.

    Order: unknown keys by name, missing required fields by canonical name, then the checks of the
    present fields by source key. Presence, not null, is what required asks for: a JSON null is a
    type error. Payloads that are no JSON object give the one error ``/object``, and unsupported
    schemas ``/unsupported_schema``. Keys are compared as written.
    """
    p = F.col(payload)
    tree = F.try_parse_json(p)
    keys = F.json_object_keys(p)
    arrays = []
    for i, s in enumerate(SCHEMAS):
        names = {f: k[i] for f, k in FIELDS.items()}
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, names.values())))), lambda x: F.concat(x, F.lit("/unknown_field")))
        missing = [F.when(~F.array_contains(keys, names[f]), F.lit(names[f] + "/required")) for f in REQUIRED]
        checks = []
        for f, k in sorted(names.items(), key=lambda x: x[1]):
            kind = F.schema_of_variant(F.try_variant_get(tree, f"$.{k}", "variant"))
            checks.append(F.when(F.array_contains(keys, k), _checks(k, f, F.try_variant_get(tree, f"$.{k}", "string"), F.coalesce(kind, F.lit("VOID")))))
        arrays.append(F.concat(unknown, F.array_compact(F.array(*missing, *checks))))
    good = tree.isNotNull() & keys.isNotNull()
    errors = F.when(~F.col(schema).isin(*SCHEMAS), F.array(F.lit("/unsupported_schema"))).when(~good, F.array(F.lit("/object"))).when(F.col(schema) == SCHEMAS[0], arrays[0]).otherwise(arrays[1])
    return raw.withColumn("errors", errors)


def fields(payload: str = "payload", schema: str = "schema_version") -> dict[str, Column]:
    """Canonical name -> text of the payload, by the keys of the row's schema version."""
    m = F.from_json(F.col(payload), "map<string,string>")
    return {f: F.when(F.col(schema) == SCHEMAS[0], m[a]).when(F.col(schema) == SCHEMAS[1], m[b]) for f, (a, b) in FIELDS.items()}


def canonical_columns(payload: str = "payload", schema: str = "schema_version") -> dict[str, Column]:
    """Typed canonical columns of valid records: exact decimals, instants in UTC, NFC and trimmed text."""
    f = fields(payload, schema)
    at = f["occurred_at"]
    return {
        "source_record_id": clean_text(f["record_id"]),
        "occurred_at": F.when(F.length(at) == 10, F.concat(at, F.lit("T00:00:00Z"))).otherwise(F.regexp_replace(at, ",", ".")).try_cast("timestamp"),
        "amount": F.when(f["amount"].rlike(AMOUNT), f["amount"].try_cast("decimal(20,4)")),
        "currency": F.upper(f["currency"]),
        "direction": f["direction"],
    } | {k: clean_text(f[k]) for k in ("account_reference", "transaction_reference", "description", "transaction_type")}


def canonical_json(payload: str = "payload") -> Column:
    """The payload's object with sorted keys, NFC values and plain newlines; null for anything else.

    For payloads whose values are strings or null. Control characters are written in lower-case hex.
    """
    m = F.from_json(F.col(payload), "map<string,string>")
    entries = F.array_sort(F.map_entries(m))
    clean = F.transform(entries, lambda x: F.struct(x["key"].alias("key"), F.when(x["value"].rlike(r"[^\x00-\x7f]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), newlines(x["value"]), F.lit(False))).otherwise(newlines(x["value"])).alias("value")))
    return F.to_json(F.map_from_entries(clean), {"ignoreNullFields": "false"})


def iso_instant(c: Column) -> Column:
    """2026-01-02T03:04:05[.micros]+00:00 of a timestamp, in UTC."""
    t = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    part = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def first_submissions(raw: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (a replay keeps the original), by one aggregation."""
    rest = [c for c in raw.columns if c not in keys]
    return raw.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def correction_chain(raw: DataFrame, group: list[str], at: str, id_: str, seq: str, content: str, block: Column | None = None) -> DataFrame:
    """id, seq, supersedes: the greatest (at, id) among the rows that came earlier, if its content differs.

    ``block`` never falls as seq rises. The greatest row of the earlier blocks comes from one row per
    block, that of the own block from the block, so a group with most rows is walked by many tasks.
    """
    block = F.lit(0) if block is None else block
    row = F.struct(F.col(at).alias("t"), F.col(id_).alias("i"), F.col(content).alias("c"))
    placed = raw.withColumns({"_b": block, "_row": row})
    earlier = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(*group, "_b").agg(F.max("_row").alias("_top")).withColumn("_before", F.max("_top").over(earlier(group, "_b"))).drop("_top")
    same = functools.reduce(lambda x, y: x & y, [F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}")) for g in [*group, "_b"]])
    both = placed.alias("r").join(tops.alias("t"), same).select("r.*", "t._before")
    prior = F.greatest(F.col("_before"), F.max("_row").over(earlier([*group, "_b"], seq)))
    return both.withColumn("_prior", prior).select(id_, seq, F.when(~F.col("_prior.c").eqNullSafe(F.col(content)), F.col("_prior.i")).alias("supersedes"))
