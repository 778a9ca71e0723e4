"""Two transaction feeds derived from the orders table by fixed arithmetic, for reconciliation at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.tables import table

COLS = ["rid", "side", "k", "d", "amount", "ccy", "dir", "ref", "valid"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("decimal(20,4)").alias("amt"), F.when(F.col("o_custkey") % 5 == 0, "EUR").otherwise("USD").alias("ccy"), (F.col("o_orderstatus") == "F").alias("debit")
    )


def source_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A: a third without reference, one in 29 with an amount that is no number."""
    k = F.col("k")
    broken = k % 29 == 0
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("A-"), k).alias("rid"), F.lit("A").alias("side"), "k", "d", F.concat(F.col("amt").cast("string"), F.when(broken, "x").otherwise("")).alias("amount"), "ccy", F.when(F.col("debit"), "DEBIT").otherwise("CREDIT").alias("dir"), F.when(k % 3 != 0, F.concat(F.lit("REF-"), k)).alias("ref"), (~broken).alias("valid")
    )


def source_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side B: shifted dates, some other amounts, directions and references, missing and extra rows."""
    o, k = _orders(spark, sf_dir), F.col("k")
    ref = F.when(k % 23 == 1, F.concat(F.lit("REF-"), k + 1)).when(k % 3 != 0, F.concat(F.lit("REF-"), k))
    side = lambda p, d, amt, debit, r: [F.concat(F.lit(p), k).alias("rid"), F.lit("B").alias("side"), "k", d.alias("d"), amt.cast("decimal(20,4)").cast("string").alias("amount"), "ccy", F.when(debit, "DEBIT").otherwise("CREDIT").alias("dir"), r.alias("ref"), F.lit(True).alias("valid")]
    amt = F.when(k % 13 == 0, F.col("amt") + 5).otherwise(F.col("amt"))
    main = o.filter(k % 11 != 0).select(*side("B-", F.date_add("d", (k % 4).cast("int")), amt, F.col("debit") != (k % 17 == 0), ref))
    return main.unionByName(o.filter(k % 19 == 0).select(*side("B2-", F.col("d"), F.col("amt"), F.col("debit"), F.lit(None).cast("string"))))


def canonical(feed: DataFrame) -> DataFrame:
    """rid, side, k, d, amt, ccy, dir, ref of the valid rows."""
    return feed.filter("valid").select("rid", "side", "k", "d", F.col("amount").try_cast("decimal(20,4)").alias("amt"), "ccy", "dir", "ref")


def pairs(spark: SparkSession, n: int) -> DataFrame:
    """2 n canonical rows: n payments on either side with common references, every eighth in another direction on side B."""
    i = F.col("id")
    number = F.lpad(i.cast("string"), 6, "0")
    side = lambda s, d: spark.range(n).select(F.concat(F.lit(f"{s}-"), number).alias("rid"), F.lit(s).alias("side"), i.alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), (i % 5).cast("int")).alias("d"), (100 + i).cast("decimal(20,4)").alias("amt"), F.lit("USD").alias("ccy"), d.alias("dir"), F.concat(F.lit("REF-"), number).alias("ref"))
    return side("A", F.lit("CREDIT")).unionByName(side("B", F.when(i % 8 == 0, "DEBIT").otherwise("CREDIT")))
