"""Candidate pairs of two sides from two indexes, as a union of equi-joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.tables import DIVISIONS, Scratch, divided, hot_keys, salted_lookup

BY_REFERENCE, BY_AMOUNT = "IDX-REFERENCE", "IDX-AMOUNT-CURRENCY-DATE"


def by_reference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the same non-empty reference. Null and blank references are gone before the shuffle."""
    side = lambda df, n: df.filter("ref is not null and ref <> ''").select(F.col("rid").alias(n), "ref")
    return side(a, "a").join(side(b, "b"), "ref").select("a", "b")


def by_amount_and_date(a: DataFrame, b: DataFrame, days: int = 2) -> DataFrame:
    """Pairs of equal currency and amount at most ``days`` days apart.

    Each A row probes the day buckets around it, so the join has three equality keys: an amount with
    a third of all rows is spread over the days, and no pair outside the band is ever formed.
    """
    probe = a.select(F.col("rid").alias("a"), "ccy", "amt", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))).alias("d"))
    return probe.join(b.select(F.col("rid").alias("b"), "ccy", "amt", "d"), ["ccy", "amt", "d"]).select("a", "b")


def candidates(a: DataFrame, b: DataFrame, days: int = 2) -> DataFrame:
    """a, b, isref, isamt: one row per pair, with the indexes that found it."""
    hits = by_reference(a, b).select("a", "b", F.lit(1).alias("isref"), F.lit(0).alias("isamt")).unionByName(by_amount_and_date(a, b, days).select("a", "b", F.lit(0).alias("isref"), F.lit(1).alias("isamt")))
    return hits.groupBy("a", "b").agg(F.max("isref").alias("isref"), F.max("isamt").alias("isamt"))


def candidates_of(targets: DataFrame, a: DataFrame, b: DataFrame, days: int = 2) -> DataFrame:
    """The candidates of all records whose ``rid`` is in targets, of either side; others are gone before the joins."""
    one = targets.select("rid").distinct()
    pick = lambda df: df.join(one, "rid", "left_semi")
    return candidates(pick(a), b, days).unionByName(candidates(a, pick(b), days)).distinct()


def _seen(nodes: DataFrame, keys: list[str], days: int | None) -> DataFrame:
    """For each key: na, nb (records of the sides that a record of this key can see), ma, mb (the
    smallest of them). With days, the last key is a date that sees the days around it."""
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    of = lambda s: F.col("side") == s
    per = nodes.filter(whole).groupBy(*keys).agg(F.count_if(of("A")).alias("na"), F.count_if(of("B")).alias("nb"), F.min(F.when(of("A"), F.col("rid"))).alias("ma"), F.min(F.when(of("B"), F.col("rid"))).alias("mb"))
    if days is None:
        return per
    around = per.withColumn("by", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("d", F.date_add("d", F.col("by")))
    return around.groupBy(*keys).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.min("ma").alias("ma"), F.min("mb").alias("mb"))


def hits(nodes: DataFrame, total: int, days: int = 2) -> DataFrame:
    """rid, side, nref, pref, namt, pamt, nboth: for each record of either side the number and the
    smallest of its counterparts by reference and by amount and date, and the number found by both.

    nodes: rid (unique), side, ref, ccy, amt, d of both sides, a stored table of ``total`` rows. Keys are
    counted map-side and looked up by salt, so a key with a third of the rows costs what its rows
    cost; no pairs are formed. Null keys and blank references see nothing.
    """
    rows = nodes.select("rid", "side", F.when(F.col("ref") != "", F.col("ref")).alias("ref"), "ccy", "amt", "d")
    out = rows
    for name, keys, band in (("ref", ["ref"], None), ("amt", ["ccy", "amt", "d"], days), ("both", ["ref", "ccy", "amt", "d"], days)):
        other = lambda a, b: F.when(F.col("side") == "A", F.col(b)).otherwise(F.col(a))
        found = salted_lookup(out, _seen(rows, keys, band), keys, F.col("rid"), total, "left")
        out = found.withColumns({f"n{name}": F.coalesce(other("na", "nb"), F.lit(0)), f"p{name}": other("ma", "mb")}).drop("na", "nb", "ma", "mb")
    return out.select("rid", "side", "nref", "pref", "namt", "pamt", "nboth")


VALUES = ["ccy", "amt", "dir"]


def by_first_rule(scratch: Scratch, rows: DataFrame, per_task: int = 1_000_000) -> Iterator[DataFrame]:
    """node, side, n, pick, outcome, ccy, amt, dir, d: what the reference says of each row of both sides, in divisions.

    n: counterparts by reference, null without one; pick: the one of n = 1. Two records that have a
    reference to themselves are one row, A's, with the outcome of the pair. Rows go through one shuffle
    by reference; those of references with very many rows through none.
    rows: rid (unique), side, ref, ccy, amt, d, dir, read several times.
    """
    a, b = F.col("side") == "A", F.col("side") == "B"
    rows = rows.select(F.col("rid").alias("node"), "side", F.when(F.col("ref") != "", F.col("ref")).alias("ref"), *VALUES, "d")
    some = rows.filter("ref is not null")
    hot, total = hot_keys(scratch, some, ["ref"], per_task)
    first = lambda s: F.min(F.when(s, F.struct("node", *VALUES)))
    counts = {"na": F.count_if(a), "nb": F.count_if(b), "ma": first(a), "mb": first(b)}
    own = Window.partitionBy("ref")
    two = (F.col("na") == 1) & (F.col("nb") == 1)
    n = F.nullif(F.when(a, F.col("nb")).otherwise(F.col("na")), F.lit(0))
    other = F.when(a, F.col("mb.node")).otherwise(F.col("ma.node"))
    same = F.struct(*[F.col(f"ma.{v}") for v in VALUES]) == F.struct(*[F.col(f"mb.{v}") for v in VALUES])
    own_values = [F.when(~two, F.col(c)).alias(c) for c in (*VALUES, "d")]
    out = lambda met: met.filter(~two | a).select("node", "side", n.alias("n"), F.when(n == 1, other).alias("pick"), F.when(two, F.when(same, "MATCHED").otherwise("MISMATCHED")).alias("outcome"), *own_values)
    cold = some if hot is None else some.join(F.broadcast(hot), "ref", "left_anti")
    for part in divided(cold, ["ref"], DIVISIONS if total > per_task else 1):
        yield out(part.withColumns({k: v.over(own) for k, v in counts.items()}))
    if hot is not None:
        many = some.join(F.broadcast(hot), "ref", "left_semi")
        per = scratch.put(many.groupBy("ref").agg(*[v.alias(k) for k, v in counts.items()]), "per")
        yield out(many.join(F.broadcast(per), "ref"))
    yield rows.filter("ref is null").select("node", "side", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("pick"), F.lit(None).cast("string").alias("outcome"), *VALUES, "d")


def by_second_rule(scratch: Scratch, rows: DataFrame, open_: DataFrame, days: int = 2, per_task: int = 1_000_000) -> Iterator[DataFrame]:
    """In divisions, open_ (node, side, ccy, amt, dir, d; stored) with n, the number of counterparts by amount and date among
    rows (as above), and pick, the one of n = 1. Rows are counted per key and day; a key has at most a row a day, over which its days are summed up."""
    keys = ["ccy", "amt", "d"]
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    of = lambda s: F.col("side") == s
    per = rows.filter(whole).groupBy(*keys).agg(F.count_if(of("A")).alias("na"), F.count_if(of("B")).alias("nb"), F.min(F.when(of("A"), F.col("rid"))).alias("ma"), F.min(F.when(of("B"), F.col("rid"))).alias("mb"))
    near = Window.partitionBy("ccy", "amt").orderBy(F.unix_date("d")).rangeBetween(-days, days)
    seen = scratch.put(per.select(*keys, *[f("n" + s).over(near).alias("n" + s) for f, s in ((F.sum, "a"), (F.sum, "b"))], *[F.min("m" + s).over(near).alias("m" + s) for s in "ab"]), "seen")
    other = lambda x, y: F.when(of("A"), F.col(y)).otherwise(F.col(x))
    n = F.coalesce(other("na", "nb"), F.lit(0))
    out = lambda found: found.select("node", "side", n.alias("n"), F.when(n == 1, other("ma", "mb")).alias("pick"), *VALUES)
    rest = open_.filter(whole)
    hot, total = hot_keys(scratch, rest, keys, per_task)
    cold, parts = rest if hot is None else rest.join(F.broadcast(hot), keys, "left_anti"), DIVISIONS if total > per_task else 1
    for mine, theirs in zip(divided(cold, keys, parts), divided(seen, keys, parts)):
        yield out(mine.join(theirs, keys, "left"))
    if hot is not None:
        few = scratch.put(seen.join(F.broadcast(hot), keys, "left_semi"), "few")
        yield out(rest.join(F.broadcast(few), keys))
    yield open_.filter(~whole).select("node", "side", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("pick"), *VALUES)


_KEYS = {BY_REFERENCE: ["ref"], BY_AMOUNT: ["ccy", "amt", "d"]}


def _class_rows(nodes: DataFrame, index: str) -> DataFrame:
    keys = _KEYS[index]
    rows = nodes.select("rid", "side", F.when(F.col("ref") != "", F.col("ref")).alias("ref"), "ccy", "amt", "d")
    return rows.filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])).select("rid", "side", *keys)


def class_members(nodes: DataFrame, total: int) -> DataFrame:
    """index, side, class, rid: records of one side that an index can't tell apart, named by the smallest."""
    out = None
    for index, keys in _KEYS.items():
        rows = _class_rows(nodes, index)
        name = rows.groupBy("side", *keys).agg(F.min("rid").alias("class"))
        one = salted_lookup(rows, name, ["side", *keys], F.col("rid"), total).select(F.lit(index).alias("index"), "side", "class", "rid")
        out = one if out is None else out.unionByName(one)
    return out


def class_links(nodes: DataFrame, days: int = 2) -> DataFrame:
    """index, class_a, class_b, n_a, n_b: which classes of the two sides are candidates of each other.

    With :func:`class_members` this holds every pair of :func:`candidates` without expanding equal records
    into pairs: a key with n records a side gives one row, not n squared.
    """
    out = None
    for index, keys in _KEYS.items():
        per = _class_rows(nodes, index).groupBy("side", *keys).agg(F.min("rid").alias("class"), F.count(F.lit(1)).alias("n"))
        mine = lambda s: per.filter(F.col("side") == s.upper()).select(*keys, F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n_{s}"))  # noqa: E731, B023
        a = mine("a")
        if index == BY_AMOUNT:
            a = a.withColumn("d", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))))
        one = a.join(mine("b"), keys).select(F.lit(index).alias("index"), "class_a", "class_b", "n_a", "n_b")
        out = one if out is None else out.unionByName(one)
    return out


def distribution(nodes: DataFrame, total: int, days: int = 2) -> DataFrame:
    """Per side: records, and minimum, median, maximum and sum of candidates per record, zeros included."""
    n = F.col("nref") + F.col("namt") - F.col("nboth")
    return hits(nodes, total, days).groupBy("side").agg(F.count(F.lit(1)).alias("records"), F.min(n).alias("least"), F.median(n).alias("middle"), F.max(n).alias("most"), F.sum(n).alias("total"))
