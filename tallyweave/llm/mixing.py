"""Mixing sources to target weights under repetition limits, in tokens.

The weights of a mix are tempered: q_i(x) is proportional to s_i^(1-x) * w_i^x for token shares s and
targets w, so that x = 0 is the corpus as it is and x = 1 the targets; without targets it is s_i^x.
With targets the exponent is bisected to the greatest x at which no source would be repeated beyond
its limit. The source that is at its limit there is fixed, and the exponent is bisected again for what
is left of the total and of the sources, until none is left or x is 1. So the asked total is met
whenever the limits allow it, and the sources below their limit stand to each other as their targets.
Without targets the exponent is bisected to a target entropy, and sources beyond their limit are fixed
in the same way. Each source is drawn with the budget of the exponent reported for it.

Budgets are realised as block permutations: whole passes over a source, and of one more pass the first
blocks of a permutation made of hashed blocks; of the block where the budget ends, the documents that
still fit. Block totals are pre-aggregated and summed up in two levels, so no task orders a whole
source, however many blocks it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.sources.tables import Scratch

#: Documents of a block on the average, and blocks of an upper block.
BLOCK_DOCS, FAN_OUT = 1_000, 4_096


def tempered(shares: np.ndarray, weights: np.ndarray | None, x: float) -> np.ndarray:
    """Weights at exponent x, sum 1; sources without tokens or without weight get nothing."""
    ok = shares > 0 if weights is None else (shares > 0) & (weights > 0)
    if not ok.any():
        return np.zeros(len(shares))
    logs = np.full(len(shares), -np.inf)
    logs[ok] = x * np.log(shares[ok]) if weights is None else (1 - x) * np.log(shares[ok]) + x * np.log(weights[ok])
    q = np.exp(logs - logs.max())
    return q / q.sum()


def entropy(q: np.ndarray) -> float:
    return float(-(q[q > 0] * np.log(q[q > 0])).sum())


def exponent_for_entropy(shares: np.ndarray, target: float, top: float = 16.0, steps: int = 60) -> float:
    """x in [0, top] at which shares^x has the target entropy (which falls as x grows), or the nearer end."""
    lo, hi = 0.0, top
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(tempered(shares, None, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def exponent_for_limits(shares: np.ndarray, weights: np.ndarray, limits: np.ndarray, steps: int = 60) -> float:
    """Greatest x in [0, 1] at which no q_i(x) is above limits_i; 0 if there is none.

    log q_i is concave in x. So a source that is above its limit at some x and not at 0 crosses it once
    in between, and lowering x to that crossing, source after source, ends within all limits; one
    that is above it at both is so everywhere in between.
    """
    above = lambda x: tempered(shares, weights, x) > limits * (1 + 1e-12) + 1e-15
    x, first = 1.0, above(0.0)
    while (over := np.flatnonzero(above(x))).size:
        if first[over].any():
            return 0.0
        lo, hi = 0.0, x
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if above(mid)[over[0]] else (mid, hi)
        x = lo
    return x


def budgets(shares: np.ndarray, weights: np.ndarray, caps: np.ndarray, total: float, tempering: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, exponent) of each source for a total, of shares of the corpus' tokens and at most caps.

    The tokens sum up to total unless all caps together are below it. tempering: the targets only give
    the entropy that shares^x is brought to.
    """
    want, free = np.zeros(len(shares)), (shares > 0) & (weights > 0) & (caps > 0)
    x = exponent_for_entropy(shares * (weights > 0), entropy(weights[weights > 0])) if tempering else 1.0
    exponent = np.full(len(shares), x)
    while free.any() and total > 0:
        s, w = np.where(free, shares, 0.0), np.where(free, weights, 0.0)
        asked = tempered(s, None if tempering else w, x if tempering else 1.0) * total
        over = free & (asked > caps * (1 + 1e-12))
        if not over.any():
            want[free], exponent[free] = asked[free], x if tempering else 1.0
            break
        if not tempering:
            x = exponent_for_limits(s, w, caps / total)
            at = over & (tempered(s, w, x) * total >= caps * (1 - 1e-9))
            over = at if at.any() else over
        want[over], exponent[over] = caps[over], x
        total -= caps[over].sum()
        free &= ~over
    return want, exponent


_BUDGET = "mix_name string, source string, target_share double, target_tokens bigint, budget bigint, source_tokens bigint, max_repeats int, exponent double"


def _budgets(tempering: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["source_tokens"].to_numpy(float)
        w = np.where(pdf["target_weight"].to_numpy(float) > 0, pdf["target_weight"], 0.0)
        w = w / w.sum() if w.sum() > 0 else w
        total = float(pdf["corpus_multiple"].max()) * float(pdf["corpus_tokens"].iloc[0])
        total = total if total > 0 else 0.0
        want, x = budgets(s / s.sum() if s.sum() > 0 else s, w, s * pdf["max_repeats"].to_numpy(float), total, tempering)
        return pd.DataFrame({"mix_name": pdf["mix_name"], "source": pdf["source"], "target_share": w, "target_tokens": np.rint(w * total).astype("int64"), "budget": np.floor(want + 1e-6).astype("int64"), "source_tokens": s.astype("int64"), "max_repeats": pdf["max_repeats"], "exponent": x})

    return run


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Of the one block where the budget ends (some BLOCK_DOCS documents): what still fits, in order."""
    block = block.sort_values(["place", "doc_id"])
    left, taken = int(block["left"].iloc[0]), []
    for doc, n in zip(block["doc_id"], block["n_tokens"]):
        if n <= left:
            left -= n
            taken.append(doc)
    return pd.DataFrame({"mix_name": block["mix_name"].iloc[0], "source": block["source"].iloc[0], "doc_id": taken})


def mix_sources(spark: SparkSession, sized: DataFrame, targets: DataFrame, seed: int = 7, tempering: bool = False, corpus_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) of the mixes. sized: doc_id, source, n_tokens, one row per document.

    draws has mix_name, source, doc_id, n_tokens, repeats (how often the document is in the mix, 1 to
    max_repeats). A source gets its budget, short of it by less than one document; see
    :func:`budgets` for what it is where limits bind. tempering: token shares to a power, with the
    entropy of the target weights, instead of the targets.
    shares has a row for every row of the targets, also for absent sources: what was asked, the budget,
    what was drawn, the share of the mix's actual total, and the exponent of the budget (1: the targets).
    corpus_tokens is what corpus_multiple multiplies, the tokens of all documents whether they have a
    source or not; where it isn't given, those of the documents that can be drawn.
    Documents without tokens or source are never drawn. Weights below or equal to 0 or null give
    nothing; a source named twice in a mix has the sum of its weights and the smaller limit.
    """
    scratch = Scratch(spark, "mix")
    sized = sized.select("doc_id", "source", "n_tokens").filter("n_tokens > 0 and source is not null")
    per = scratch.put(sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    corpus = scratch.put(sized.agg(F.sum("n_tokens").alias("n")), "total").first()["n"] or 0 if corpus_tokens is None else corpus_tokens
    one = targets.filter("source is not null and mix_name is not null").groupBy("mix_name", "source").agg(F.max("corpus_multiple").alias("corpus_multiple"), F.sum("target_weight").alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
    asked = one.join(per, "source", "left").select("mix_name", "source", "corpus_multiple", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.lit(corpus).alias("corpus_tokens"))
    budgets = scratch.put(asked.groupBy("mix_name").applyInPandas(_budgets(tempering), _BUDGET), "budgets")

    plan = budgets.filter("budget > 0").join(per.select("source", "n_docs"), "source").withColumns(
        {
            "passes": F.floor(F.col("budget") / F.col("source_tokens")).cast("int"),
            "rest": F.col("budget") % F.col("source_tokens"),
            "blocks": F.ceil(F.col("n_docs") / BLOCK_DOCS),
        }
    )
    place = F.xxhash64(F.lit(seed), "mix_name", "doc_id")
    rows = sized.join(plan.select("mix_name", "source", "passes", "rest", "blocks"), "source").withColumn("place", place).withColumn("block", F.pmod(F.col("place"), F.col("blocks")))
    totals = rows.groupBy("mix_name", "source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    totals = totals.withColumn("upper", F.floor(F.col("block") / FAN_OUT))
    run = lambda part, order: F.coalesce(F.sum("block_tokens").over(Window.partitionBy("mix_name", "source", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uppers = totals.groupBy("mix_name", "source", "upper").agg(F.sum("block_tokens").alias("block_tokens")).withColumn("base", run([], "upper")).drop("block_tokens")
    starts = totals.withColumn("offset", run(["upper"], "block")).join(uppers, ["mix_name", "source", "upper"]).select("mix_name", "source", "block", "block_tokens", (F.col("base") + F.col("offset")).alias("start"))
    placed = rows.join(starts, ["mix_name", "source", "block"]).withColumns({"left": F.col("rest") - F.col("start"), "whole": F.col("start") + F.col("block_tokens") <= F.col("rest")})
    cols = ["mix_name", "source", "doc_id", "n_tokens"]
    cut = placed.filter("left > 0 and not whole").select(*cols, "place", "left").groupBy("mix_name", "source").applyInPandas(_fill, "mix_name string, source string, doc_id bigint").withColumn("extra", F.lit(1))
    passes = placed.select(*cols, (F.col("passes") + F.col("whole").cast("int")).alias("passes")).join(cut, ["mix_name", "source", "doc_id"], "left")
    draws = scratch.put(passes.select(*cols, (F.col("passes") + F.coalesce("extra", F.lit(0))).alias("repeats")).filter("repeats > 0"), "draws")
    actual = draws.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    all_ = Window.partitionBy("mix_name")
    got = F.coalesce("actual_tokens", F.lit(0))
    shares = budgets.join(actual, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", "target_tokens", "budget", got.alias("actual_tokens"), F.coalesce(F.try_divide(got, F.sum(got).over(all_)), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats", (F.abs(F.col("budget") - F.col("target_tokens")) > 1).alias("limited"), "exponent",
    )
    return draws, shares
