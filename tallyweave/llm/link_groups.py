"""Consolidating pairwise matches into groups: rake, compress, solve the core, restore.

Every round takes the vertices with at most two neighbours out of the graph. Maximal chains of
vertices with two neighbours are compressed to one edge between their ends by list ranking: each
direction through a vertex is a list element pointing to the next, and pointers double until they
reach the end of the chain (a closed ring is recognised by its smallest vertex). Vertices with one
neighbour are then stripped. Trees vanish in a logarithmic number of rounds, whatever their depth.
When stripping stops paying, what is left is the core: every vertex of it is hooked to its smallest
neighbour and the stars are contracted, after which stripping goes on. It is the same at every size.
Removed vertices keep a pointer to a vertex that stayed longer; doubling those pointers restores the
labels.

Vertices are 64-bit hashes of the ids, checked to be free of collisions. Degrees come from map-side
aggregation, edges are only ever joined by both ends, and lookups of a frequent parent are salted, so
a vertex with a third of all links is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.tables import Scratch, salted_lookup

#: A round that removes a smaller share of the edges than this ends the stripping.
WORTHWHILE = 0.15


def _ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _neighbours(edges: DataFrame) -> DataFrame:
    """x, n, lo, hi: number, smallest and greatest of the neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


def rank_lists(scratch: Scratch, chain: DataFrame) -> tuple[DataFrame, bool]:
    """chain: x, lo, hi of the vertices with two neighbours. List ranking by pointer doubling.

    Gives the list elements p, v (coming from p through v), q, w (the last step of the list that
    starts so: w is the vertex at its end), rank (steps to there), m (smallest vertex passed),
    live (in a ring, which has no end), and whether there are any.
    """
    one = lambda p, w: F.struct(F.col(p).alias("p"), F.col("x").alias("v"), F.col("x").alias("q"), F.col(w).alias("w"))
    arcs, seen = scratch.put_counted(chain.select(F.explode(F.array(one("lo", "hi"), one("hi", "lo"))).alias("a"), "x").select("a.*", F.lit(1).cast("bigint").alias("rank"), F.col("x").alias("m"), F.lit(True).alias("live"), F.lit(False).alias("same")), "arcs")
    if not seen["n"]:
        return arcs, False
    while True:
        to = arcs.select(F.col("p").alias("q"), F.col("v").alias("w"), F.col("q").alias("nq"), F.col("w").alias("nw"), F.col("rank").alias("nr"), F.col("m").alias("nm"))
        went = arcs.filter("live").join(to, ["q", "w"], "left").select("p", "v", F.coalesce("nq", "q").alias("q"), F.coalesce("nw", "w").alias("w"), (F.col("rank") + F.coalesce("nr", F.lit(0))).alias("rank"), F.least("m", "nm").alias("m"), F.col("nw").isNotNull().alias("live"), F.coalesce(F.col("m") == F.col("nm"), F.lit(False)).alias("same"))
        new, seen = scratch.put_counted(went.unionByName(arcs.filter("not live")), "arcs", live=F.count_if("live"), moving=F.count_if(F.expr("live and not same")))
        scratch.drop(arcs)
        arcs = new
        if not seen["moving"]:
            return arcs, seen["live"] > 0


def _round(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Compress the chains, then strip the leaves: the remaining edges and the removed x -> parent."""
    low = scratch.put(_neighbours(edges).filter("n <= 2"), "low")
    arcs, rings = rank_lists(scratch, low.filter("n = 2"))
    ended = arcs.filter("not live")
    removed = []
    if rings:
        removed.append(arcs.filter("live and v != m").select(F.col("v").alias("x"), F.col("m").alias("parent")).distinct())
    # a chain vertex knows both ends; it goes to the smaller, and the chain becomes one edge
    ends = scratch.put(ended.groupBy("v").agg(F.min("w").alias("u1"), F.max("w").alias("v1")), "ends")
    removed.append(ends.select(F.col("v").alias("x"), F.col("u1").alias("parent")))
    bridges = ends.filter("u1 != v1").select(F.col("u1").alias("u"), F.col("v1").alias("v")).distinct()
    # a leaf's neighbour is the far end of the chain beside it, if there is one
    far = ended.select(F.col("p").alias("x"), F.col("v").alias("lo"), F.col("w").alias("far"))
    leaves = low.filter("n = 1").join(far, ["x", "lo"], "left").select("x", F.coalesce("far", "lo").alias("parent"))
    pair = leaves.select("x", "parent", *_ordered("x", "parent"))
    pairs = scratch.put(pair.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.max("x").alias("x")).select("u", "v", "x", F.when(F.col("x") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent")), "leaves")
    removed.append(pairs.select("x", "parent"))
    chain_edges = low.filter("n = 2").select(F.explode(F.array(F.struct(*_ordered("x", "lo")), F.struct(*_ordered("x", "hi")))).alias("e")).select("e.*")
    gone = chain_edges.unionByName(pairs.select("u", "v"))
    kept = edges.join(gone, ["u", "v"], "left_anti").unionByName(bridges.join(pairs.select("u", "v"), ["u", "v"], "left_anti")).distinct()
    return kept, removed


def _root(scratch: Scratch, parents: DataFrame, total: int) -> DataFrame:
    """x, parent with parent a root, by doubling until nothing moves. total: the rows of parents, a stored table."""
    while True:
        up = parents.select(F.col("x").alias("parent"), F.col("parent").alias("up"))
        moved = salted_lookup(parents, up, ["parent"], F.col("x"), total, "left")
        new, seen = scratch.put_counted(moved.select("x", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "pointers", moved=F.count_if("moved"))
        scratch.drop(parents)
        parents = new.drop("moved")
        if not seen["moved"]:
            return parents


def _relabel(edges: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    for end in ("u", "v"):
        to = roots.select(F.col("x").alias(end), F.col("parent").alias("_to"))
        edges = salted_lookup(edges, to, [end], F.struct("u", "v"), total, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.filter("u != v").select(*_ordered("u", "v")).distinct()


def group_roots(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """edges: distinct u < v (bigint). Gives x, parent for every vertex but one in each group."""
    edges, seen = scratch.put_counted(edges, "edges")
    size, removed = seen["n"], []
    while size:
        kept, gone = _round(scratch, edges)
        kept, seen = scratch.put_counted(kept, "edges")
        removed += gone
        before, size, edges = size, seen["n"], kept
        if not size or before - size >= WORTHWHILE * before:
            continue
        hooks, seen = scratch.put_counted(_neighbours(edges).filter("lo < x").select("x", F.col("lo").alias("parent")), "hooks")
        roots = _root(scratch, hooks, seen["n"])
        removed.append(roots)
        edges, seen = scratch.put_counted(_relabel(edges, roots, size), "edges")
        size = seen["n"]
    if not removed:
        return None
    parents = removed[0]
    for r in removed[1:]:
        parents = parents.unionByName(r)
    parents, seen = scratch.put_counted(parents, "parents")
    return _root(scratch, parents, seen["n"])


def _hashed(spark: SparkSession, scratch: Scratch, links: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The ids with their 64-bit vertex, and the links as vertices; another seed if two ids collide."""
    for seed in range(8):
        v = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        ids = scratch.put(links.select(F.explode(F.array(a, b)).alias("id")).distinct().withColumn("x", v("id")), "ids")
        if ids.groupBy("x").count().filter("count > 1").isEmpty():
            return ids, links.select(v(a).alias("a"), v(b).alias("b")).filter("a != b").select(*_ordered("a", "b")).distinct()
    raise RuntimeError("ids collide under every seed")


def link_groups(spark: SparkSession, links: DataFrame, a: str, b: str) -> DataFrame:
    """id, group_id: every id of a link with both sides, with the smallest id of its group (byte order).

    Repeated links, exchanged sides and links of an id with itself count as they say; an id that is
    only linked with itself is its own group. Links with a null side and other columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(spark, "groups")
    whole = scratch.put(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")), "links")
    ids, edges = _hashed(spark, scratch, whole, "a", "b")
    roots = group_roots(scratch, edges)
    if roots is None:
        return ids.select("id", F.col("id").alias("group_id"))
    rooted, seen = scratch.put_counted(ids.join(roots, "x", "left").select("id", F.coalesce("parent", "x").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    return salted_lookup(rooted, groups, ["root"], F.col("id"), seen["n"]).select("id", "group_id")
