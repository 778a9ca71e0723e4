import os

import numpy as np
import pytest

from tallyweave.llm import merge_replay as mr
from tallyweave.llm.mixing import budgets, entropy, exponent_for_entropy, exponent_for_limits, mix_sources, tempered

FILE = os.path.join(mr.TOKENIZER_DIR, "byte_bpe_50k.json")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer file")
TEXTS = [None, "", " ", "\n\n  x ", "Hello world, hello!", "aaaaaaaaaaaaaaaaaaaaa aaa", "naïve café é 日本語テキスト", "don't we'll 12345 ٣٤", "<|endoftext|>   ꟎\U0001f9ff tail   ", "x" * 5000 + " " * 300, "Hello world, hello!", "\x00\x1f\x7f"]


@needs_file
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in mr.encode_corpus(spark, df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in mr.token_counts(spark, df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert mr.encode_corpus(spark, df.limit(0)).count() == 0


def test_the_quick_pattern_is_the_tokenizers():
    import random

    import regex

    # Fixed value: the pattern that splits text before merging.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    settled = [c for c in map(chr, range(0x10000)) if mr._SETTLED.fullmatch(c)]
    r = random.Random(1)
    for c in settled:
        for t in (c, f"a{c}b", f" {c}{c} 1{c}'s", f"{c} {c}  "):
            assert mr._QUICK.findall(t) == pattern.findall(t), repr(t)
    for _ in range(20_000):
        t = "".join(r.choice(settled) if r.random() < 0.5 else r.choice(" \n\t'stab19_.-ß") for _ in range(r.randrange(30)))
        assert mr._QUICK.findall(t) == pattern.findall(t), repr(t)


def test_exponents():
    s = np.array([0.7, 0.2, 0.1])
    x = exponent_for_entropy(s, 1.0)
    assert abs(entropy(tempered(s, None, x)) - 1.0) < 1e-6
    w = np.array([0.2, 0.3, 0.5])
    assert exponent_for_limits(s, w, np.array([1, 1, 1.0])) == 1.0
    x = exponent_for_limits(s, w, np.array([1, 1, 0.25]))
    assert abs(tempered(s, w, x)[2] - 0.25) < 1e-6
    assert tempered(np.zeros(2), None, 0.5).tolist() == [0, 0]


def test_budgets_meet_the_total_within_the_limits():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = r.integers(1, 7)
        s, w, caps = r.random(n) + 0.01, r.random(n) * (r.random(n) < 0.9), (r.random(n) * 3) * (r.random(n) < 0.9)
        s, total = s / s.sum(), r.random() * 3
        w = w / w.sum() if w.sum() else w
        for tempering in (False, True):
            got, x = budgets(s, w, caps, total, tempering)
            room = caps[w > 0].sum()
            assert abs(got.sum() - min(total, room)) < 1e-6 and (got <= caps + 1e-9).all() and (got[w == 0] == 0).all()
            free = (w > 0) & (caps > 0) & (got < caps - 1e-9)
            if not tempering:  # the exact answer: every source min(limit, share of one common level)
                lo, hi = 0.0, 1e9
                for _ in range(200):
                    mid = (lo + hi) / 2
                    lo, hi = (lo, mid) if np.minimum(caps, mid * w).sum() > min(total, room) else (mid, hi)
                assert np.allclose(got, np.minimum(caps, lo * w), atol=1e-5) and (x[free] == 1).all()
            elif free.sum() > 1:
                q = tempered(s * free, None, x[0])
                assert np.allclose(got[free] / got[free].sum(), q[free], atol=1e-6)


def test_mix(spark):
    docs = [(i, "big", 5) for i in range(400)] + [(1000 + i, "small", 10) for i in range(20)] + [(2000, None, 9), (2001, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", 1.0, "big", 3.0, 2), ("m", 1.0, "small", 1.0, 4), ("n", 0.5, "big", 1.0, 1), ("n", 0.5, "gone", 1.0, 9), ("n", 0.5, "small", None, 9)], "mix_name string, corpus_multiple double, source string, target_weight double, max_repeats int")
    draws, shares = mix_sources(spark, sized, targets)
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    total = 400 * 5 + 200
    assert got["m", "big"].actual_tokens == 1650 == total * 3 // 4 and got["m", "small"].actual_tokens == 550 and got["m", "small"].most_repeats == 3
    assert got["n", "big"].actual_tokens == 1100 and got["n", "gone"].limited and got["n", "gone"].actual_tokens == 0 and got["n", "small"].target_tokens == 0
    rows = draws.collect()
    assert len(rows) == len({(r.mix_name, r.doc_id) for r in rows}) and all(r.n_tokens > 0 and r.source for r in rows)
    empty = mix_sources(spark, sized.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 5
