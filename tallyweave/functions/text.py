"""Text normalisation with JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def nfc(c: Column) -> Column:
    """Unicode NFC. ASCII text passes unchanged; other text goes to the ICU library inside Spark."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_text(c: Column) -> Column:
    """NFC, trimmed, and null where nothing is left."""
    t = strip(nfc(c))
    return F.when(t != "", t)


def exact_decimal_text(c: Column) -> Column:
    """One spelling for every spelling of the same decimal number, without rounding.

    ``+09.90`` and ``9.9`` become ``9.9``; text that is no number stays as it is behind ``!``.
    """
    t = clean_text(c.cast("string"))
    number = t.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z")
    body = F.regexp_replace(t, r"^[+-]", "")
    whole = F.regexp_replace(F.regexp_replace(body, r"\..*$", ""), r"^0+", "")
    part = F.when(body.contains("."), F.regexp_replace(F.regexp_replace(body, r"^[^.]*\.", ""), r"0+$", "")).otherwise("")
    plain = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    signed = F.when(t.startswith("-") & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
    wide = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(number, signed).otherwise(F.coalesce(F.when(t.rlike("[eE]"), wide), F.concat(F.lit("!"), t)))


def instant_text(c: Column) -> Column:
    """Microseconds since 1970 as text for a timestamp or a text with one; other text behind ``!``."""
    t = clean_text(c.cast("string"))
    return F.when(t.isNotNull(), F.coalesce(F.unix_micros(t.try_cast("timestamp")).cast("string"), F.concat(F.lit("!"), t)))
