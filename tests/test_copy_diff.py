import random

import numpy as np

from tallyweave.functions import field61 as gf
from tallyweave.operators.copy_diff import CopyPair, _products, copy_differences, interpolate


def test_field_arithmetic():
    p = int(gf.P)
    r = random.Random(1)
    a = [r.randrange(p) for _ in range(500)] + [0, 1, p - 1]
    b = [r.randrange(p) for _ in range(500)] + [p - 1, p - 1, p - 1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert gf.mul(x, y).tolist() == [i * j % p for i, j in zip(a, b)]
    assert gf.sub(x, y).tolist() == [(i - j) % p for i, j in zip(a, b)]
    assert gf.mul(x[:-3], gf.inverse(x[:-3])).tolist() == [1] * 500


def test_interpolation_finds_the_differences_or_says_no():
    rng = np.random.default_rng(2)
    common = rng.integers(1, int(gf.P), 60, dtype=np.uint64)
    for extra_a, extra_b in ((0, 0), (1, 0), (2, 2), (0, 5), (3, 4), (9, 9)):
        xa, xb = rng.integers(1, int(gf.P), extra_a, dtype=np.uint64), rng.integers(1, int(gf.P), extra_b, dtype=np.uint64)
        z = gf.points(5, 10)
        ea, eb = (_products(np.r_[common, x], np.zeros(60 + len(x), int), z)[2] for x in (xa, xb))
        out = interpolate(np.array([60 + extra_a]), np.array([60 + extra_b]), ea, eb, z)[0]
        if extra_a + extra_b > 8:
            assert out is None
        else:
            assert (len(out[0]) - 1, len(out[1]) - 1) == (extra_a, extra_b)
            assert (gf.evaluate(np.tile(out[0], (extra_a, 1)), xa) == 0).all() if extra_a else True


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k string, amount string, note string, v int, gone boolean, k1 int, extra string")


def _pair(spark, a, b):
    return [CopyPair("t", _rows(spark, a), _rows(spark, b), "k", {"amount": "decimal", "note": "text"}, "v", "gone")]


def _brute(a, b):
    def norm(r):
        return (str(float(r[1])) if r[1] else None, (r[2] or "").strip() or None)

    left = {r[0]: norm(r) for r in a if r[0] is not None}
    last = {}
    for r in b:
        if r[0] is not None and (r[0] not in last or r[3] > last[r[0]][3]):
            last[r[0]] = r
    right = {k: norm(r) for k, r in last.items() if not r[4]}
    out = {("t", k, "missing_in_copy", "") for k in left.keys() - right.keys()} | {("t", k, "missing_in_original", "") for k in right.keys() - left.keys()}
    for k in left.keys() & right.keys():
        out |= {("t", k, "value", f) for f, x, y in zip(("amount", "note"), left[k], right[k]) if x != y}
    return out


def test_all_kinds_of_difference_and_doubling(spark):
    r = random.Random(3)
    a = [(f"k{i}", f"{i}.50", None if i % 9 == 0 else "note", 0, False, 1, "x") for i in range(900)]
    b = []
    for i in range(30, 960):
        amount = f"+{i}.5" if r.random() < 0.6 else f"{i}.51"  # many values differ, so that the degree bound must double
        b.append((f"k{i}", amount, " note " if i % 9 else "", 1, False, 2, "y"))
        if i % 7 == 0:
            b.append((f"k{i}", f"0{i}.500", "note", 2, i % 2 == 0, 2, "y"))
    b += b[:40] + [(None, "1", "n", 1, False, 0, None)]
    a += a[:25] + [(None, "1", "n", 1, False, 0, None)]
    got = [tuple(x) for x in copy_differences(spark, _pair(spark, a, b)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(a, b)


def test_empty_sides(spark):
    one = [("a", "1", "x", 1, False, 0, None)]
    assert {x[2] for x in copy_differences(spark, _pair(spark, one, [])).collect()} == {"missing_in_copy"}
    assert {x[2] for x in copy_differences(spark, _pair(spark, [], one)).collect()} == {"missing_in_original"}
    assert copy_differences(spark, _pair(spark, [], [])).count() == 0
    assert copy_differences(spark, _pair(spark, one, one)).count() == 0
