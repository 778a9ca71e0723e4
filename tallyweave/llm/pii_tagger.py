"""Personal information in free text: a linear-chain conditional random field in numpy.

Tokens are tagged O or B-/I- of five types. A tag's score sums weights of features of the token and
its neighbours up to three away: the word if it is one of the frames or a function word, else only
its shape, its ending, and whether public vocabularies hold it as a common word, only with a capital,
or not at all; a coarse class and the classes of three neighbours together; and whether the token
lies in a stretch written like an e-mail address, a number or a street address (patterns only mark
stretches; the field decides). Features of a word are computed once per distinct word and looked up.
The field is trained by maximum likelihood (Adam) on the labelled table of ``pii_examples``, with
words and endings hidden at random; texts are decoded by Viterbi in batches of stretches between
sentence ends. An exact check drops what can't be of its type.
"""

from __future__ import annotations

import base64
import os
import random
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

from tallyweave.llm.pii_examples import COMMON, EN_KINDS, FORMS, LEGAL, ORG_WORDS, PARTICLES, TOWN_HEADS, frame_words, labelled_rows, unmark

TYPES = ("NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS")
TAGS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
L = len(TAGS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
BITS = {0: 14, -1: 13, 1: 13, -2: 12, 2: 12, -3: 12, 3: 12}

_S, _H = r"[    \n]", r"[-‐‑–]"
_AT = rf"{_S}?(?:@|\[at\]|\(at\)){_S}?|{_S}(?:at){_S}"
_DOT = rf"\.|{_S}?(?:\[dot\]|\(dot\)){_S}?|{_S}dot{_S}"
_STREET_END = "|".join(sorted({k.rstrip(".").lower() for k in EN_KINDS} | {"quay", "walk", "hill", "gate", "gardens", "square"}, key=len, reverse=True))
CANDIDATES = [
    re.compile(rf"(?<![\w.+-])[\w.+-]++(?:{_AT})(?:[\w-]+(?:{_DOT}))+[a-z][\w-]*+(?!{_S}?(?:[+@]|\[at\]|\(at\)))", re.I),
    re.compile(
        rf"(?<![\w.,/*-])(?:\+1{_S}?\(?\d{{3}}\)?(?:{_S}|{_H}|\.)?\d{{3}}(?:{_S}|{_H}|\.)?\d{{4}}|(?:\+|00)33{_S}?(?:\(0\){_S}?)?\d(?:{_S}?\d\d){{4}}|(?:\+|00)44{_S}?(?:\(0\){_S}?)?(?:\d\d{_S}?\d{{4}}{_S}?\d{{4}}|\d{{4}}{_S}?\d{{3}}{_S}?\d{{3}})|(?:\+|00)[2-9]\d{{0,2}}{_S}?(?:\(0\){_S}?)?\d(?:(?:{_S}|{_H}|/)?\d){{5,11}}|\(\d{{3}}\){_S}?\d{{3}}{_H}\d{{4}}|\d{{3}}[.]\d{{3}}[.]\d{{4}}|\d{{3}}{_H}\d{{3}}{_H}\d{{4}}|0\d{{2,4}}(?:{_S}|/)\d{{3,6}}(?:(?:{_S}|{_H})\d{{2,4}})?|0\d(?:{_S}\d\d){{4}})(?![\w/]|{_H}\d|[.,]\d)"
    ),
    re.compile(
        rf"(?<![\w.,/*+-])(?:\d{{3}}(?P<q>{_H}|\.|{_S})\d{{2}}(?P=q)\d{{4}}|\d{{9}}|[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]|[12]{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?\d{{3}}{_S}?\d{{3}}(?:{_S}?\d\d)?|\d\d{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}|\d{{8}}(?:{_S}|{_H})?[A-Z]|[A-Z]{{2}}\d{{7}}|[A-Z]{{1,2}}\d{{6,8}})(?![\w/]|{_H}\d)",
        re.I,
    ),
    re.compile(
        rf"(?<![\w-])(?:\d{{1,5}}[a-z]?{_S}(?:[NSEW]\.?{_S}|(?:north|south|east|west){_S})?(?:[^\W\d_][\ẁ-ͯ'’-]*{_S}){{1,3}}?(?:{_STREET_END})\b\.?(?!{_S}(?:{_STREET_END})\b))",
        re.I,
    ),
    re.compile(
        rf"(?<![\w-])(?:\d{{1,5}}(?:{_S}bis|{_S}ter)?,?{_S}(?:rue|avenue|boulevard|chemin|impasse|all[eé][́]?e|place|quai|cours){_S}(?:d[eu]s?|de{_S}la|de{_S}l['’])[^\d\n,.|\"]{{3,34}}?(?=,|\.|$|\n|\||{_S}(?-i:[a-z]{{3,}})|{_S}\d|\"|{_S}#)|(?:calle|c/|avenida|avda\.?|plaza|paseo|camino){_S}d[^\d,|\"]{{3,34}}?(?:,{_S}|{_S}n[ºo]{_S}|{_S})\d{{1,5}}|[^\W\d_][\ẁ-ͯ-]*+(?=\.?{_S}\d)(?:(?<=[\w-]str)\.|(?<=[\w-]straße)|(?<=[\w-]strasse)|(?<=[\w-]weg)|(?<=[\w-]platz)|(?<=[\w-]gasse)|(?<=[\w-]allee)|(?<=[\w-]damm)|(?<=[\w-]ufer)|(?<=[\w-]ring)){_S}\d{{1,4}}(?:{_S}?[a-d]\b)?)",
        re.I,
    ),
]
STRETCH_TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "ADDRESS")
#: Stands between the texts of a batch: no pattern and no token crosses it.
_BETWEEN = "\n\x00\n"

_CLASSES = ["pad", "other", "lower", "org", "form", "initial", "cap", "upper", *(c + k for c in ("lower", "cap", "upper") for k in "cpr"), "digits", "mixed", ",", ".", "-", "&", ":", "(", ")", "'", '"', "|", "/", "@", "street", "road"]
_C = {c: i for i, c in enumerate(_CLASSES)}
NC = len(_CLASSES)
_PARTS = re.compile(r"[^\W\d_]+")
_ORG = {w.casefold() for o in (*ORG_WORDS, *LEGAL) for w in _PARTS.findall(o) if len(w) > 1} | {"bank", "banque", "banco", "banca", "sparkasse", "caixa", "grupo", "trust"}
_FORM = {f.rstrip(".").casefold() for f in FORMS if len(f) > 2}
_STREET_WORD = re.compile(r".{3}(?:stra(?:ß|ss)e|str|weg|platz|gasse|allee|damm|ufer|ring)$")
_ROAD = set(_STREET_END.split("|")) | {"rue", "avenue", "boulevard", "chemin", "impasse", "calle", "avenida", "avda", "plaza", "paseo", "camino", "quai", "weg", "platz", "gasse", "allee", "damm", "ufer", "ring", "straße", "strasse", "str"}


#: Words the field may know by themselves; all others are only known by shape, ending and surroundings.
KNOWN = frozenset(frame_words()) | {w.casefold() for w in COMMON} | set(TOWN_HEADS)
#: Shares of the words that training takes for unknown, and whose ending it hides, anew in every place.
DROPPED, NO_ENDING = 0.3, 0.6
_UNKNOWN, _BLUNT = "\x00", "\x01"
_MARKS = _UNKNOWN + _BLUNT


TOKENIZER_DIR = "/opt/tokenizers"


@lru_cache(maxsize=2)
def _public_words(tokenizer_dir: str) -> frozenset[str]:
    """Whole words, as written, that public vocabularies hold as one token."""
    out = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(os.path.join(tokenizer_dir, name), "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and len(token) > 3:
                    out.add(token[1:].decode("utf-8", "ignore"))
    return frozenset(out)


def _kind(low: str, words: frozenset[str]) -> str:
    """c: a common word; p: only common with a capital, as names are; r: rare."""
    return "c" if low in words else "p" if low.capitalize() in words else "r"


def _word(w: str, words: frozenset[str]) -> tuple[int, list[str], list[str]]:
    """Class, own features and neighbour features of a token."""
    known, blunt = _UNKNOWN not in w, w[-1] == _BLUNT
    w = unicodedata.normalize("NFC", w.rstrip(_MARKS))
    low = w.casefold()
    known = known and low in KNOWN
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", w))
    short = re.sub(r"(.)\1+", r"\1+", shape)
    if w[0].isdigit() and w.isdigit():
        c = "digits"
    elif not w[0].isalnum():
        c = {"’": "'", "‑": "-", "–": "-"}.get(w, w if w in _C else "other")
    elif not w.isalpha():
        c = "mixed"
    elif low in _ORG:
        c = "org"
    elif low in _FORM:
        c = "form"
    elif _STREET_WORD.search(low):
        c = "street"
    elif low in _ROAD:
        c = "road"
    elif len(w) == 1 and w.isupper():
        c = "initial"
    else:
        c = ("upper" if w.isupper() else "cap" if w[0].isupper() else "lower") + ("" if known else _kind(low, words))
    listed = known or c in ("org", "form", "road") or not w[0].isalnum()
    generic = low if listed else shape if not w.isalpha() else short
    near = ["w" + generic, "c" + c, "s" + short]
    own = near + ["e" if blunt else "e" + low[-3:], "f" if blunt else "f" + low[-2:], "S" + shape[:12], f"n{min(len(w), 9)}{c}", "k" + _kind(low, words) + short]
    return _C[c], own, near


def _hash(features: list[str], bits: int, width: int) -> list[int]:
    ids = [zlib.crc32(f.encode()) & ((1 << bits) - 1) for f in features]
    return (ids + [1 << bits] * width)[:width]  # the last weight is kept at zero


OWN, NEAR = 8, 3
_memo: dict[str, tuple] = {}


def _word_ids(w: str, tokenizer_dir: str = TOKENIZER_DIR) -> tuple:
    hit = _memo.get(w)
    if hit is None:
        if len(_memo) > 300_000:
            _memo.clear()
        c, own, near = _word(w, _public_words(tokenizer_dir))
        hit = _memo[w] = (c, _hash(own, BITS[0], OWN), {b: _hash(near, b, NEAR) for b in {BITS[o] for o in OFFSETS if o}})
    return hit


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """For each character below 0x10000: 0 space, 1 part of a word, 2 combining mark, 3 sign of its own."""
    return np.array([2 if 0x300 <= c < 0x370 else 0 if chr(c).isspace() or not c else 1 if chr(c).isalnum() else 3 for c in range(1 << 16)], np.int8)


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, words with their combining marks or single signs, and the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _marks()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        kind[i] = 1 if text[i].isalnum() else 3
    before = np.concatenate([[0], kind[:-1]])
    word = (kind == 1) | ((kind == 2) & ((before == 1) | (before == 2)))  # a mark after a space is a sign, those after it too
    if (kind == 2).any():
        word &= _attached(kind)
    inside = word & np.concatenate([[False], word[:-1]])
    start = np.flatnonzero((kind != 0) & ~inside)
    last = np.concatenate([~inside[1:], [True]]) if len(kind) else inside
    return start, np.flatnonzero((kind != 0) & last) + 1, points


def _attached(kind: np.ndarray) -> np.ndarray:
    """False for marks that follow no letter."""
    base = np.where(kind != 2, np.arange(len(kind)), -1)
    base = np.maximum.accumulate(base)
    return (base >= 0) & (kind[np.maximum(base, 0)] == 1)


class Batch:
    """Tokens of some texts with everything that their scores look up."""

    def __init__(self, texts: list[str], drop: random.Random | None = None, tokenizer_dir: str = TOKENIZER_DIR):
        vocab: dict[str, int] = {_UNKNOWN: 0}
        number = vocab.setdefault
        whole = _BETWEEN.join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(size + len(_BETWEEN)) - size - len(_BETWEEN)
        s, ends, points = tokens(whole)
        self.start, self.end, self.n = s, ends, len(s)
        self.doc = np.searchsorted(self.begin, s, "right") - 1
        words = [whole[i:j] for i, j in zip(s.tolist(), ends.tolist())]
        if drop:
            words = [w + _UNKNOWN * (drop.random() < DROPPED) + _BLUNT * (drop.random() < NO_ENDING) if w[0].isalpha() else w for w in words]
        word = [number(w, len(vocab)) for w in words]
        first = np.ones(self.n, bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        before = np.concatenate([[0], ends[:-1]])[: self.n]
        before[first] = self.begin[self.doc[first]]
        lines = np.flatnonzero(points == 10)
        breaks = np.searchsorted(lines, s) - np.searchsorted(lines, before)
        gap = np.where(s == before, 0, 1 + np.minimum(breaks, 2))
        cand = np.zeros((self.n, 5), np.int8)
        self.stretches: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for k, rx in enumerate(CANDIDATES):
            found = np.array([m.span() for m in rx.finditer(whole)], np.int64).reshape(-1, 2)
            i, j = np.searchsorted(s, found[:, 0]), np.searchsorted(s, found[:, 1])
            step = np.zeros(self.n + 1, np.int64)
            np.add.at(step, i, 1)
            np.add.at(step, j, -1)
            cand[:, k] = np.cumsum(step)[:-1] > 0
            cand[i[i < self.n], k] = 2
            for d, span in zip((np.searchsorted(self.begin, found[:, 0], "right") - 1).tolist(), found.tolist()):
                self.stretches.setdefault((d, STRETCH_TYPES[k]), []).append(tuple(span))
        gaps = 3  # empty places between texts, so that neighbours never cross
        place = np.arange(self.n) + self.doc * gaps + 3
        size = self.n + len(texts) * gaps + 6
        padded = np.zeros(size, np.int64)
        padded[place] = word
        self.words = {o: padded[place + o] for o in OFFSETS}
        known = [_word_ids(w, tokenizer_dir) if i else (0, [1 << BITS[0]] * OWN, {b: [1 << b] * NEAR for b in {BITS[o] for o in OFFSETS if o}}) for w, i in vocab.items()]
        self.own = np.array([k[1] for k in known], np.int64)
        self.near = {b: np.array([k[2][b] for k in known], np.int64) for b in {BITS[o] for o in OFFSETS if o}}
        cls = np.array([k[0] for k in known])[padded]
        at = lambda o: cls[place + o]
        self.triples = [at(a) * NC * NC + at(b) * NC + at(c) for a, b, c in ((-1, 0, 1), (0, 1, 2), (-2, -1, 0), (1, 2, 3))]
        code = cand @ np.array([1, 3, 9, 27, 81])
        pc = np.zeros(size, np.int64)
        pc[place] = code
        gp = np.zeros(size, np.int64)
        gp[place] = gap
        self.codes = [pc[place + o] for o in (-1, 0, 1)] + [pc[place] * 4 + gp[place]]
        self.gaps = gp[place] * 4 + gp[place + 1]
        self.gap, self.cls, self.code = gap, at(0), code

    def sequences(self) -> np.ndarray:
        """For each token whether a stretch begins there: a new text, a blank line, or a new sentence."""
        first = np.ones(self.n, bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        if self.n < 3:
            return first
        low = (self.cls[:-2] == _C["lower"]) & (self.cls[1:-1] == _C["."])
        sentence = low & (self.gap[2:] > 0) & (self.code[:-2] == 0) & (self.code[2:] == 0) & (self.end[:-2] - self.start[:-2] > 3)
        first[2:] |= sentence
        first |= (self.gap == 3)
        return first


def _tables(rng=None) -> dict[str, np.ndarray]:
    t = {f"o{o}": np.zeros(((1 << BITS[o]) + 1, L), np.float32) for o in OFFSETS}
    t |= {f"t{i}": np.zeros((NC**3, L), np.float32) for i in range(4)}
    t |= {f"k{i}": np.zeros((243, L), np.float32) for i in range(3)} | {"k3": np.zeros((972, L), np.float32), "g": np.zeros((16, L), np.float32)}
    t["bias"] = np.zeros((1, L), np.float32)
    t["trans"] = np.zeros((L, L), np.float32)
    return t


def _lookups(b: Batch) -> list[tuple[str, np.ndarray]]:
    return [(f"t{i}", x) for i, x in enumerate(b.triples)] + [(f"k{i}", x) for i, x in enumerate(b.codes)] + [("g", b.gaps)]


def emissions(w: dict[str, np.ndarray], b: Batch) -> np.ndarray:
    e = np.zeros((b.n, L), np.float32)
    for o in OFFSETS:
        ids = b.own if o == 0 else b.near[BITS[o]]
        e += w[f"o{o}"][ids].sum(axis=1)[b.words[o]]
    for k, x in _lookups(b):
        e += w[k][x]
    return e + w["bias"]


def _allowed() -> np.ndarray:
    ok = np.ones((L, L), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [t[2:] == tag[2:] and t != "O" for t in TAGS]
    return ok


ALLOWED = _allowed()
START = np.array([t[0] != "I" for t in TAGS])


def _grid(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    row = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    col = np.arange(len(first)) - begin[row]
    return row, col, len(begin), int(col.max()) + 1 if len(col) else 0


def _scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], axis=1).astype(np.float32)


def _expected(e: np.ndarray, col: np.ndarray, row: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences side by side: tag probabilities of the tokens, expected transitions."""
    t_max, n = int(length.max()), len(length)
    mask = np.arange(t_max)[:, None] < length[None]
    grid = np.ones((t_max, n, L), np.float32)
    grid[col, row] = e
    fw, bw = np.empty_like(grid), np.empty_like(grid)
    fw[0] = grid[0] * START
    fw[0] /= fw[0].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        x = (fw[t - 1] @ trans) * grid[t]
        x /= x.sum(axis=1, keepdims=True)
        fw[t] = np.where(mask[t][:, None], x, fw[t - 1])
    bw[-1] = 1
    for t in range(t_max - 2, -1, -1):
        x = (bw[t + 1] * grid[t + 1]) @ trans.T
        x /= x.sum(axis=1, keepdims=True)
        bw[t] = np.where(mask[t + 1][:, None], x, 1)
    post = fw[col, row] * bw[col, row]
    post /= post.sum(axis=1, keepdims=True)
    pair = np.zeros((L, L))
    for t in range(1, t_max):
        keep = mask[t]
        right = (grid[t] * bw[t])[keep]
        left = fw[t - 1][keep]
        z = ((left @ trans) * right).sum(axis=1, keepdims=True)
        pair += (left / z).T @ right * trans
    return post, pair


class _Part:
    """A share of the labelled rows, ready for gradients of the likelihood."""

    def __init__(self, rows: list[str], drop: random.Random):
        texts, spans = zip(*map(unmark, rows))
        b = self.b = Batch(list(texts), drop)
        gold = np.zeros(b.n, np.int64)
        for d, s in enumerate(spans):
            at = b.begin[d]
            for kind, i, j in s:
                x, y = np.searchsorted(b.start, at + i), np.searchsorted(b.start, at + j)
                k = 1 + 2 * TYPES.index(kind)
                gold[x:y] = k + 1
                gold[x] = k
        row, col, n, _ = _grid(b.sequences())
        size = np.bincount(row, minlength=n)
        self.n, self.groups = n, []  # sequences of like length, so that little of each grid is empty
        for lo, hi in zip((0, 6, 12, 24, 48, 96), (6, 12, 24, 48, 96, 1 << 30)):
            mine = np.flatnonzero((size > lo) & (size <= hi))
            if len(mine):
                rank = np.full(n, -1)
                rank[mine] = np.arange(len(mine))
                tokens = np.flatnonzero(rank[row] >= 0)
                self.groups.append((tokens, col[tokens], rank[row[tokens]], size[mine]))
        self.one = np.eye(L, dtype=np.float32)[gold]
        prev = np.flatnonzero(col > 0)
        self.trans = np.bincount(gold[prev - 1] * L + gold[prev], minlength=L * L).reshape(L, L)

    def gradient(self, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        b = self.b
        e = emissions(w, b)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        trans = np.exp(w["trans"]) * ALLOWED
        g, pair = -self.one, np.zeros((L, L))
        for tokens, c, r, length in self.groups:
            post, p = _expected(e[tokens], c, r, length, trans)
            g[tokens] += post
            pair += p
        grads = {"trans": (pair - self.trans).astype(np.float32), "bias": g.sum(axis=0, keepdims=True)}
        for k, x in _lookups(b):
            grads[k] = _scatter(x, g, len(w[k]))
        for o in OFFSETS:
            ids = b.own if o == 0 else b.near[BITS[o]]
            per = _scatter(b.words[o], g, len(ids))
            grads[f"o{o}"] = _scatter(ids.ravel(), np.repeat(per, ids.shape[1], axis=0), len(w[f"o{o}"]))
            grads[f"o{o}"][-1] = 0
        return grads


def train(rows: list[str], steps: int = 240, parts: int = 4, rate: float = 0.04, l2: float = 1e-5) -> dict[str, np.ndarray]:
    """Maximum likelihood of the marked rows, by Adam over parts of them; each part stands in two
    drafts, from which other words are hidden."""
    batches = [_Part(rows[i::parts], random.Random(seed * parts + i)) for seed in range(2) for i in range(parts)]
    w, m1, m2 = _tables(), _tables(), _tables()
    seen = sum(p.one.sum(axis=0) for p in batches)
    w["bias"][0] = np.log((seen + 1) / seen.sum())  # so that frequent features needn't learn it
    mean, last = _tables(), 2 * len(batches)
    for step in range(1, steps + 1):
        part = batches[step % len(batches)]
        grads = part.gradient(w)
        lr = rate * (1 if step < steps * 0.6 else 0.4)
        for k in w:
            d = grads[k] / part.n + (l2 if k[0] == "o" else l2 / 6 if k[0] == "t" else l2 / 60) * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d * d
            w[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
            if k in {f"o{o}" for o in OFFSETS}:
                w[k][-1] = 0
            if step > steps - last:
                mean[k] += w[k] / last
    return mean


#: Added to the score of every token to begin a name: a name missed is worse than a word replaced.
NAME_LEAN = 1.0


@lru_cache(maxsize=2)
def default_weights(rows: int = 6000, seed: int = 11) -> dict[str, np.ndarray]:
    w = train(labelled_rows(rows, seed))
    w["bias"][0, TAGS.index("B-NAME")] += NAME_LEAN
    return w


def _open(e: np.ndarray, trans: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each stretch whether its best path may have another tag than O.

    It can't if no entity that begins at any of its tokens and goes on as far as it pays scores as much
    as O there, even if every transition it has were the best of all.
    """
    d = max(0.0, float(trans[ALLOWED].max() - trans[0, 0]))
    some = np.zeros(len(e), bool)
    for k in range(1, L, 2):
        on = np.cumsum(e[:, k + 1].astype(np.float64) - e[:, 0] + d)
        # the greatest sum of going on from the next token to any later one of the stretch: each stretch lies below the one before it
        low = on - row * (2 * float(np.abs(on).max()) + 1)
        best = np.maximum.accumulate(low[::-1])[::-1]
        more = np.zeros(len(e))
        same = row[1:] == row[:-1]
        more[:-1][same] = np.maximum(0, best[1:][same] - low[:-1][same])
        some |= e[:, k] - e[:, 0] + 2 * d + more >= -1e-3
    return np.logical_or.reduceat(some, begin)


def viterbi(w: dict[str, np.ndarray], b: Batch, width: int = 400_000) -> np.ndarray:
    """Best tag of each token; stretches that aren't certainly O are decoded, those of like length together."""
    tags = np.zeros(b.n, np.int8)
    if not b.n:
        return tags
    e = emissions(w, b)
    first = b.sequences()
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, b.n))
    trans = np.where(ALLOWED, w["trans"], np.float32(-1e4)).astype(np.float32)
    keep = np.flatnonzero(_open(e, w["trans"], begin, np.cumsum(first) - 1))
    begin, size = begin[keep], size[keep]
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and (j - i + 1) * int(size[order[j]]) <= max(width, int(size[order[i]])) and size[order[j]] <= 2 * size[order[i]] + 4:
            j += 1
        pick = order[i:j]
        i = j
        t_max, s, st = int(size[pick].max()), size[pick], begin[pick]
        score = np.where(START, e[st], np.float32(-1e4))
        back = np.zeros((t_max, len(pick), L), np.int8)
        for t in range(1, t_max):
            live = np.flatnonzero(t < s)
            x = score[live][:, :, None] + trans[None]
            best = x.argmax(axis=1)
            back[t, live] = best
            score[live] = np.take_along_axis(x, best[:, None, :], 1)[:, 0] + e[st[live] + t]
        tag = score.argmax(axis=1)
        for t in range(t_max - 1, -1, -1):
            live = np.flatnonzero(t < s)
            tags[st[live] + t] = tag[live]
            tag[live] = back[t, live, tag[live]]
    return tags


_KINDS_DOT = re.compile(r"\b(?:st|rd|ave|ln|dr|ct|blvd|pl|ter)$", re.I)


_LAST_INITIAL = re.compile(r"^\w.*\s[A-ZÀ-Þ]\.$", re.S)


def _exact(kind: str, text: str, i: int, j: int) -> tuple[int, int]:
    """The exact end of a found span: an abbreviated street keeps its full stop, other marks go."""
    if kind == "NAME" and _LAST_INITIAL.search(text[i:j]):
        return i, j
    while j > i and (text[j - 1].isspace() or text[j - 1] in ".,;:-'’\"|/&<>" or text[j - 1] == ")" and "(" not in text[i:j]):
        j -= 1
    while i < j and (text[i].isspace() or text[i] in ".,;:-'’\"|/&<>)" or text[i] == "(" and ")" not in text[i:j]):
        i += 1
    if kind == "ADDRESS" and j < len(text) and text[j] == "." and _KINDS_DOT.search(text[i:j]):
        rest = text[j + 1 : j + 4]
        if rest[:1] in {".", ",", '"', "|", "#"} or rest[:1].isalnum() or (rest[:1] in {" ", "\n"} and rest[1:2] and not rest[1:2].isupper() and rest[1:2] not in "[|"):
            j += 1
    return i, j


def _names(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """A family name and a given name may stand around a comma; with more behind it, it parts two names.
    Before a colon a name is a label, which begins with its line."""
    line = text.rfind("\n", i, j)
    if line > 0 and text[j : j + 1] == ":":
        i = line + 1
    comma = text.find(",", i, j)
    if comma > 0 and sum(len(w.rstrip(".")) > 1 for w in text[comma + 1 : j].split()) > 1:
        return [(i, comma), (comma + 1, j)]
    return [(i, j)]


_BEFORE = re.compile(r"(?:^|[^\w])(" + "|".join(sorted({re.escape(f.rstrip(".")) for f in FORMS}, key=len, reverse=True)) + r")\.?\s$", re.I)


_AFTER = re.compile(r"(?:\s(?:&\s)?[^\W\d_a-z][\w-]+){0,2}?\s?(?:,\s)?(?:" + "|".join(map(re.escape, sorted(LEGAL, key=len, reverse=True))) + r")(?!\w)")
_ELIDED = re.compile(r"(?:qu|[ljnmtsc])['’][a-zà-ÿ]", re.I)
_SMALL = {w for p in PARTICLES for w in p.casefold().split()} | {"del", "dos", "das", "do", "du", "y", "e", "zu", "den", "ten", "ter", "bin", "ibn", "los", "las"}


def _possible(kind: str, text: str, i: int, j: int, written: bool) -> bool:
    """Whether a found span can be of its type: numbers and addresses of mail need their writing, a
    name two words with capitals (particles aside) or all in small letters, or one after a form of
    address, and no legal form of a company behind it."""
    if kind in ("EMAIL", "PHONE", "ID_NUMBER"):
        return written
    span = text[i:j]
    if kind == "ADDRESS":
        return written or any(ch.isdigit() for ch in span)
    if text[i - 1 : i] == "_" or any(ch.isdigit() or ch in "_@/|:;()[]{}<>=&\"" for ch in span) or _AFTER.match(text, j):
        return False
    words = span.split()
    if len(words[-1]) == 1 and text[j : j + 1] in {"'", "’"}:  # an elided article
        return False
    capital = [w for w in words if w[0].isupper() and not _ELIDED.match(w)]
    if capital and any(w[0].islower() and w.casefold() not in _SMALL and not w.startswith(("al-", "d'", "d’")) for w in words):
        return False
    return len(capital or words) > 1 or bool(_BEFORE.search(text[max(0, i - 12) : i]))


def find_spans(w: dict[str, np.ndarray], texts: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> list[list[tuple[str, int, int]]]:
    """(type, start, end) of each text, in order and without overlap.

    Where a found span meets stretches written like its type, their exact limits are taken.
    """
    b = Batch(texts, tokenizer_dir=tokenizer_dir)
    tags = viterbi(w, b)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    hit = np.flatnonzero(tags)
    if not len(hit):
        return out
    new = (tags[hit] % 2 == 1) | np.r_[True, (np.diff(hit) > 1) | (b.doc[hit[1:]] != b.doc[hit[:-1]])]
    starts = np.flatnonzero(new)
    for x, y in zip(starts, np.append(starts[1:], len(hit))):
        first, last = hit[x], hit[y - 1]
        d, kind = int(b.doc[first]), TYPES[(tags[first] - 1) // 2]
        at = int(b.begin[d])
        i, j = int(b.start[first]), int(b.end[last])
        written = [(c[0] - at, c[1] - at) for c in b.stretches.get((d, kind), ()) if c[0] < j and c[1] > i]
        i, j = i - at, j - at
        for i, j in written or (_names(texts[d], i, j) if kind == "NAME" else [(i, j)]):
            i, j = _exact(kind, texts[d], i, j)
            if j > i and _possible(kind, texts[d], i, j, bool(written)) and not (out[d] and out[d][-1][2] > i):
                out[d].append((kind, i, j))
    return out
