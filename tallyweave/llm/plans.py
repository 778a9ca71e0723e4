"""The queries of the llm operators over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.link_groups import link_groups
from tallyweave.llm.merge_replay import encode_corpus, token_counts
from tallyweave.llm.mixing import mix_sources
from tallyweave.llm.nearest_time import match_nearest
from tallyweave.llm.pii import find_pii, redact_pii
from tallyweave.sources.tables import Scratch, table


def current_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current canonical transactions with their side, ``A`` or ``B``, by the schema of their source."""
    can = table(spark, sf_dir, "canonical_transactions").select("canonical_id", "source_id", "occurred_at", "amount", "currency", "supersedes_canonical_id")
    superseded = can.filter(F.col("supersedes_canonical_id").isNotNull()).select(F.col("supersedes_canonical_id").alias("canonical_id")).distinct()
    schemas = F.col("schema_versions")
    side = F.when(F.array_contains(schemas, "source_a.v1"), "A").when(F.array_contains(schemas, "source_b.v1"), "B")
    sides = table(spark, sf_dir, "sources").select("source_id", side.alias("side")).dropDuplicates(["source_id"])
    one = can.drop("supersedes_canonical_id").dropDuplicates(["canonical_id"])
    return one.join(superseded, "canonical_id", "left_anti").join(sides, "source_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "nearest").put(current_by_side(spark, sf_dir), "current")
    pairs = match_nearest(spark, rows.filter("side = 'A'"), rows.filter("side = 'B'"), ["currency", "amount"], "occurred_at", "canonical_id", 36 * 3600)
    return pairs.select(F.least("left_id", "right_id").alias("canonical_id_1"), F.greatest("left_id", "right_id").alias("canonical_id_2")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "match_candidates")
    return link_groups(spark, links, "source_a_canonical_id", "source_b_canonical_id").withColumnRenamed("id", "canonical_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark, table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str, tempering: bool) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized, seen = Scratch(spark, "sized").put_counted(token_counts(spark, docs, keep=["source"]), "sized", tokens=F.sum("n_tokens"))
    corpus = seen["tokens"] or 0
    return mix_sources(spark, sized, table(spark, sf_dir, "mix_targets"), tempering=tempering, corpus_tokens=corpus)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, False)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the draws of p7_mix make of each target."""
    return _mix(spark, sf_dir, False)[1]


def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where token shares to a power, of the targets' entropy, take the targets' place."""
    return _mix(spark, sf_dir, True)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_pii(spark, table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_tempered_shares": p7_tempered_shares, "p8_found": p8_found, "p8_redacted": p8_redacted}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """WITH t AS (SELECT DISTINCT canonical_id, source_id, epoch_us(occurred_at) us, amount, currency FROM canonical_transactions WHERE canonical_id NOT IN (SELECT supersedes_canonical_id FROM canonical_transactions WHERE supersedes_canonical_id IS NOT NULL)),
s AS (SELECT t.*, list_contains(schema_versions, 'source_a.v1') is_a FROM t JOIN sources USING (source_id)),
m AS (SELECT a.canonical_id a, min_by(b.canonical_id, struct_pack(d := abs(a.us - b.us), i := b.canonical_id)) b FROM s a JOIN s b ON a.currency = b.currency AND a.amount = b.amount AND b.us BETWEEN a.us - 129600000000 AND a.us + 129600000000 WHERE a.is_a AND NOT b.is_a GROUP BY 1)
SELECT DISTINCT least(a, b) canonical_id_1, greatest(a, b) canonical_id_2 FROM m""",
        "p5_found": """WITH RECURSIVE l AS (SELECT DISTINCT source_a_canonical_id a, source_b_canonical_id b FROM match_candidates WHERE source_a_canonical_id IS NOT NULL AND source_b_canonical_id IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a canonical_id, min(b) group_id FROM r GROUP BY a""",
    }
