"""Differences between two copies of data by characteristic-polynomial set reconciliation.

Each side hashes a row (key and all compared fields) to one element of the field of 2^61 - 1, and
puts it into a bucket by a hash of its key, so that exact copies of a key collapse and no bucket can
be hot. Per bucket a side gives its size and the value of its characteristic polynomial
prod(z - element) at a few common points. Only those sketches meet: from the ratios the two monic
polynomials whose roots are the elements on one side only are interpolated, the smallest degree
first, and verified at two points kept apart. Buckets that differ by more than the degree bound come
again with the bound doubled. The rows whose elements are roots are fetched and compared field by
field. A bucket's polynomials are checked a last time against its rows; if a root should be missing,
all rows of the bucket are fetched, so no difference can be lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import field61 as gf
from tallyweave.functions.text import clean_text, exact_decimal_text, instant_text
from tallyweave.sources.tables import Scratch

#: Rows of a bucket on the average, first degree bound, points kept apart for verification.
BUCKET_ROWS, FIRST_DEGREE, VERIFY = 64, 12, 2
_SUPER = 512
_KINDS = {"text": clean_text, "decimal": exact_decimal_text, "instant": instant_text}


@dataclass
class CopyPair:
    """Two copies of one table. fields: name -> ``text``, ``decimal`` or ``instant``.

    version and deleted name columns of ``copy``: the state of a key is its row with the greatest
    version (null versions are the smallest; of equal versions the greatest row hash), and a deleted
    state means that the key is not in the copy.
    """

    name: str
    original: DataFrame
    copy: DataFrame
    key: str
    fields: dict[str, str]
    version: str | None = None
    deleted: str | None = None
    _cols: dict = field(default_factory=dict)

    def text(self, f: str) -> Column:
        return _KINDS[self.fields[f]](F.col(f))


def _slim(p: CopyPair, df: DataFrame, buckets: int, versioned: bool) -> DataFrame:
    """k1, k2 (a key of 96 bits), bucket, elem; one row per key and state."""
    df = df.filter(F.col(p.key).isNotNull())
    parts = [F.coalesce(p.text(f), F.lit("\x01")) for f in p.fields]
    elem = (F.pmod(F.xxhash64(F.col(p.key), *parts), F.lit(int(gf.P) - 1)) + 1).alias("elem")
    keys = [F.xxhash64(p.key).alias("k1"), F.hash(F.col(p.key), F.lit(7)).alias("k2")]
    if not versioned:
        out = df.select(*keys, elem).distinct()
    else:
        version = F.col(p.version) if p.version else F.lit(0)
        gone = F.coalesce(F.col(p.deleted), F.lit(False)) if p.deleted else F.lit(False)
        last = df.select(*keys, F.struct(version.alias("v"), elem, gone.alias("gone")).alias("s")).groupBy("k1", "k2").agg(F.max("s").alias("s"))
        out = last.filter(~F.col("s.gone")).select("k1", "k2", F.col("s.elem").alias("elem"))
    return out.select("k1", "k2", F.pmod(F.col("k1"), F.lit(buckets)).cast("int").alias("bucket"), "elem")


def _segments(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    ids, start = np.unique(bucket[order], return_index=True)
    return order, ids, start


def _products(elem: np.ndarray, bucket: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per bucket: its size and prod(z - elem) at each z."""
    order, ids, start = _segments(bucket)
    size = np.diff(np.append(start, len(order)))
    place = np.arange(len(order)) - np.repeat(start, size)
    row = np.repeat(np.arange(len(ids)), size)
    grid = np.zeros((len(ids), 1 << max(0, int(size.max() - 1).bit_length())), np.uint64)
    used = np.zeros(grid.shape, bool)
    grid[row, place], used[row, place] = elem[order], True
    out = np.empty((len(ids), len(z)), np.uint64)
    for j, x in enumerate(z):
        v = np.where(used, gf.sub(np.full_like(grid, x), grid), np.uint64(1))
        while v.shape[1] > 1:
            h = v.shape[1] // 2
            v = gf.mul(v[:, :h], v[:, h:])
        out[:, j] = v[:, 0]
    return ids, size, out


_SKETCH = "t int, bucket int, side int, n int, evals array<bigint>"
_POLY = "t int, bucket int, side int, coeffs array<bigint>, solved boolean"


def _long_lists(a: np.ndarray) -> pa.Array:
    flat = pa.array(a.astype(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), flat)


def _sketcher(degree: int, seed: int):
    z = gf.points(seed, degree + VERIFY)

    def run(t: pa.Table) -> pa.Table:
        ids, size, ev = _products(t["elem"].to_numpy().astype(np.uint64), t["bucket"].to_numpy(), z)
        k = len(ids)
        return pa.table({"t": pa.array(np.full(k, t["t"][0].as_py(), np.int32)), "bucket": pa.array(ids.astype(np.int32)), "side": pa.array(np.full(k, t["side"][0].as_py(), np.int32)), "n": pa.array(size.astype(np.int32)), "evals": _long_lists(ev)})

    return run


def interpolate(na: np.ndarray, nb: np.ndarray, ea: np.ndarray, eb: np.ndarray, z: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Per bucket the monic polynomials of the elements only in a and only in b, or None.

    ea, eb: values of the characteristic polynomials at z, the last VERIFY of which only verify.
    """
    out: list = [None] * len(na)
    m = len(z) - VERIFY
    ratio = gf.mul(ea, gf.inverse(eb))
    usable = (ea != 0).all(axis=1) & (eb != 0).all(axis=1)
    delta = na - nb
    pw = np.ones((m + 1, len(z)), np.uint64)
    for i in range(1, m + 1):
        pw[i] = gf.mul(pw[i - 1], z)
    todo = np.flatnonzero(usable & (np.abs(delta) <= m))
    for total in range(m + 1):
        here = todo[(np.abs(delta[todo]) <= total) & ((delta[todo] - total) % 2 == 0)]
        done = []
        for d in np.unique(delta[here]):
            idx = here[delta[here] == d]
            a, b = (total + int(d)) // 2, (total - int(d)) // 2
            r = ratio[idx]
            if total:
                zt = slice(0, total)
                left = np.broadcast_to(pw[:a, zt].T[None], (len(idx), total, a))
                right = gf.sub(np.zeros((1, 1, 1), np.uint64), gf.mul(r[:, zt, None], pw[:b, zt].T[None]))
                rhs = gf.sub(gf.mul(r[:, zt], pw[b, zt][None]), pw[a, zt][None])
                x, ok = gf.solve(np.concatenate([left, right, rhs[:, :, None]], axis=2))
            else:
                x, ok = np.zeros((len(idx), 0), np.uint64), np.ones(len(idx), bool)
            one = np.ones((len(idx), 1), np.uint64)
            pc, qc = np.hstack([x[:, :a], one]), np.hstack([x[:, a:], one])
            for j in range(total, len(z)):
                zj = np.full(len(idx), z[j])
                ok &= gf.evaluate(pc, zj) == gf.mul(r[:, j], gf.evaluate(qc, zj))
            for i in np.flatnonzero(ok):
                out[idx[i]] = (pc[i], qc[i])
            done.append(idx[ok])
        if done:
            todo = np.setdiff1d(todo, np.concatenate(done), assume_unique=True)
    return out


def _solver(degree: int, seed: int):
    z = gf.points(seed, degree + VERIFY)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            d = {c: b.column(c) for c in b.schema.names}
            get = lambda c: np.nan_to_num(d[c].to_numpy(zero_copy_only=False)).astype(np.int64)

            def evals(c):
                a = np.ones((n, len(z)), np.uint64)
                have = d[c].is_valid().to_numpy(zero_copy_only=False)
                if have.any():
                    a[have] = d[c].drop_null().flatten().to_numpy().astype(np.uint64).reshape(-1, len(z))
                return a

            polys = interpolate(get("na"), get("nb"), evals("ea"), evals("eb"), z)
            t, bucket = d["t"].to_pylist(), d["bucket"].to_pylist()
            rows = {k: [] for k in ("t", "bucket", "side", "coeffs", "solved")}
            for i, pq in enumerate(polys):
                if pq is not None and len(pq[0]) == 1 and len(pq[1]) == 1:
                    continue  # the same on both sides
                for side in (0, 1):
                    rows["t"].append(t[i])
                    rows["bucket"].append(bucket[i])
                    rows["side"].append(side)
                    rows["coeffs"].append(None if pq is None else pq[side].astype(np.int64).tolist())
                    rows["solved"].append(pq is not None)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("t", pa.int32()), ("bucket", pa.int32()), ("side", pa.int32()), ("coeffs", pa.list_(pa.int64())), ("solved", pa.bool_())]))

    return run


def _roots(rows: pa.Table, polys: pa.Table) -> pa.Table:
    """The rows of a group of buckets that are roots of their bucket's polynomial."""
    out = {"t": pa.int32(), "k1": pa.int64(), "k2": pa.int32()}
    if not rows.num_rows or not polys.num_rows:
        return pa.schema(list(out.items())).empty_table()
    lists = [np.array(c, np.uint64) for c in polys["coeffs"].to_pylist()]
    width = max(map(len, lists))
    grid, degree = np.zeros((len(lists), width), np.uint64), np.array([len(c) - 1 for c in lists])
    for i, c in enumerate(lists):
        grid[i, : len(c)] = c
    ids = polys["bucket"].to_numpy()
    order = np.argsort(ids)
    at = np.searchsorted(ids[order], b := rows["bucket"].to_numpy())
    at = np.minimum(at, len(ids) - 1)
    have = ids[order][at] == b
    row = np.flatnonzero(have)
    which = order[at[row]]
    hit = gf.evaluate(grid[which], rows["elem"].to_numpy()[row].astype(np.uint64)) == 0
    found = np.bincount(which[hit], minlength=len(ids))
    hit |= (found != degree)[which]  # not all roots are here: take the bucket whole
    return rows.take(pa.array(row[hit])).select(list(out)).cast(pa.schema(list(out.items())))


def copy_differences(spark: SparkSession, pairs: list[CopyPair]) -> DataFrame:
    """All differences of all pairs: table_name, record_key, diff_kind, field_name.

    diff_kind is ``missing_in_copy`` or ``missing_in_original`` (field_name is ``''``) or ``value``,
    one row per differing field. Equal keys are one row; if the original has one key with several
    contents, each counts and a field differs if any content differs from the copy. Rows with a null
    key can't be matched and are left out. Fields compare after the normalisation of their kind,
    null equal to empty text and to nothing else. Empty tables give the other side as missing; extra
    columns are ignored.
    """
    scratch = Scratch(spark, "copydiff")
    slim = None
    for i, p in enumerate(pairs):
        rows = max(p.original.count(), p.copy.count())
        buckets = 1 << max(4, (max(1, rows) // BUCKET_ROWS).bit_length())
        for side, df in ((0, p.original), (1, p.copy)):
            part = _slim(p, df, buckets, side == 1).select(F.lit(i).alias("t"), F.lit(side).alias("side"), "bucket", "k1", "k2", "elem")
            slim = part if slim is None else slim.unionByName(part)
    slim = scratch.put(slim, "elements").withColumn("super", F.floor(F.col("bucket") / _SUPER).cast("int"))

    solved, open_, degree, round_ = [], None, FIRST_DEGREE, 0
    while True:
        rows = slim if open_ is None else slim.join(open_, ["t", "bucket"], "left_semi")
        sketches = rows.groupBy("t", "side", "super").applyInArrow(_sketcher(degree, round_), _SKETCH)
        a, b = (sketches.filter(F.col("side") == s).select("t", "bucket", F.col("n").alias(f"n{x}"), F.col("evals").alias(f"e{x}")) for s, x in ((0, "a"), (1, "b")))
        polys = scratch.put(a.join(b, ["t", "bucket"], "full").mapInArrow(_solver(degree, round_), _POLY), f"polynomials-{degree}")
        solved.append(polys.filter("solved").drop("solved"))
        open_ = polys.filter("not solved and side = 0").select("t", "bucket")
        if open_.isEmpty():
            break
        degree, round_ = degree * 2, round_ + 1
    polys = solved[0]
    for s in solved[1:]:
        polys = polys.unionByName(s)
    polys = polys.withColumn("super", F.floor(F.col("bucket") / _SUPER).cast("int"))
    by = ("t", "side", "super")
    hits = scratch.put(slim.groupBy(*by).cogroup(polys.groupBy(*by)).applyInArrow(_roots, "t int, k1 bigint, k2 int").distinct(), "hits")

    out = None
    for i, p in enumerate(pairs):
        found = _compare(p, hits.filter(F.col("t") == i).drop("t"))
        out = found if out is None else out.unionByName(found)
    return out


def _compare(p: CopyPair, hits: DataFrame) -> DataFrame:
    """Fetch the rows whose keys have a differing element, and compare their fields."""
    names = list(p.fields)

    def fetch(df: DataFrame, extra: list[Column]) -> DataFrame:
        keyed = df.filter(F.col(p.key).isNotNull()).select(F.col(p.key).alias("_key"), *[F.col(n) for n in names], *extra, F.xxhash64(p.key).alias("k1"), F.hash(F.col(p.key), F.lit(7)).alias("k2"))
        return keyed.join(hits, ["k1", "k2"], "left_semi")

    texts = F.struct(*[p.text(n).alias(f"f{j}") for j, n in enumerate(names)])
    a = fetch(p.original, []).select("_key", texts.alias("a")).distinct()
    version = F.col(p.version) if p.version else F.lit(0)
    gone = F.coalesce(F.col(p.deleted), F.lit(False)) if p.deleted else F.lit(False)
    elem = F.pmod(F.xxhash64(F.col("_key"), *[F.coalesce(p.text(f), F.lit("\x01")) for f in names]), F.lit(int(gf.P) - 1)) + 1
    b = fetch(p.copy, [version.alias("_v"), gone.alias("_gone")]).select("_key", F.struct("_v", elem.alias("e"), "_gone", texts.alias("b")).alias("s"))
    b = b.groupBy("_key").agg(F.max("s").alias("s")).filter(~F.col("s._gone")).select("_key", F.col("s.b").alias("b"))
    kind = lambda k, f: F.struct(F.lit(k).alias("diff_kind"), F.lit(f).alias("field_name"))
    values = F.filter(F.array(*[F.when(~F.col(f"a.f{j}").eqNullSafe(F.col(f"b.f{j}")), kind("value", n)) for j, n in enumerate(names)]), lambda x: x.isNotNull())
    cases = F.when(F.col("b").isNull(), F.array(kind("missing_in_copy", ""))).when(F.col("a").isNull(), F.array(kind("missing_in_original", ""))).otherwise(values)
    both = a.join(b, "_key", "full")
    return both.select(F.lit(p.name).alias("table_name"), F.col("_key").alias("record_key"), F.explode(cases).alias("c")).select("table_name", "record_key", "c.diff_kind", "c.field_name").distinct()
