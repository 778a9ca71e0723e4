"""Encoding a corpus with a byte-level BPE by replaying its merges over all distinct words at once.

Texts are split once, in blocks of bounded size as the files hold them: a block is stored as its
distinct pre-tokens (words) and, for each document, the list of their numbers. The distinct words of
the corpus are encoded once: all words of a task lie in one array, an inverted index holds for each
merge the positions where its pair stands, and the merges are applied in rank order, each to all its
positions at once; only the neighbours of merged positions get new index entries. The encoded words go
back to the blocks that have them by a lookup that spreads frequent words over many tasks, and the
lists of numbers become lists of ids.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweave.sources.tables import Scratch, salted_lookup

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a block; words that a task replays at once.
BLOCK_CHARS, REPLAY_WORDS = 1_000_000, 250_000
#: Characters on which Unicode versions agree; texts with others are split by the tokenizer library.
_SETTLED = re.compile(r"[\x00-ʯ̀-Ͱ-ͷΑ-ΡА-я–-•…‰′″€−、-。ぁ-ゖァ-ヺー一-鿋︀-️！-～​-‍﻿½¼¾☎✓✔→←↑↓]*+")
# The splitting pattern of the tokenizer in terms of the standard library, which agrees with it on settled characters: there the
# only numbers beside digits are these.
_S, _N = r"\t-\r \x85\xa0\u3000", "\\d²³¹¼½¾"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{_N}]+| ?[{_N}]+| ?(?:[^\w{_S}{_N}]|_)+|[{_S}]+(?![^{_S}])|[{_S}]+")


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def split_words(text: str, path: str) -> list[str]:
    """The pre-tokens of a text, in order; joined they are the text."""
    if _SETTLED.fullmatch(text):
        return _QUICK.findall(text)
    return [text[i:j] for _, (i, j) in _library(path).pre_tokenize_str(text)]


class MergeTable:
    """Byte ids and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # printable bytes stand for themselves, the others for the characters from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_id = np.array([vocab[char[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.second = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.first << 20 | self.second
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        k = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words after another, and the offsets of the words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    tok = table.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tok)
    ends = np.cumsum(size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[size > 0] - 1] = -1
    before[(ends - size)[size > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(pos: np.ndarray) -> None:
        r = table.ranks(tok[pos], tok[after[pos]])
        pos, r = pos[r >= 0], r[r >= 0]
        if not len(pos):
            return
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for rank, part in zip(r[np.r_[0, cuts]].tolist(), np.split(pos, cuts)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    enter(np.flatnonzero(after >= 0))
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        pos = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        a, b = table.first[rank], table.second[rank]
        nxt = after[pos]
        pos = pos[alive[pos] & (nxt >= 0) & (tok[pos] == a) & (tok[nxt] == b)]
        if a == b and len(pos) > 1:  # of overlapping places in a run every other one, from the left
            head = np.r_[True, after[pos[:-1]] != pos[1:]]
            start = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
        if not len(pos):
            continue
        gone = after[pos]
        tok[pos], alive[gone] = table.merged[rank], False
        beyond = after[gone]
        after[pos] = beyond
        before[beyond[beyond >= 0]] = pos[beyond >= 0]
        left = before[pos]
        enter(np.unique(np.concatenate([left[left >= 0], pos[beyond >= 0]])))
    kept = np.cumsum(np.r_[0, alive])
    return tok[alive], kept[np.r_[0, ends]]


def _encoder(path: str):
    def flush(words: list[str], blocks: list[int]) -> pa.RecordBatch:
        ids, offsets = replay([w.encode() for w in words], merge_table(path))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["word", "blocks", "ids"])

    def run(batches):
        held, blocks = [], []
        for b in batches:
            held += b.column(0).to_pylist()
            blocks += b.column(1).to_pylist()
            if len(held) >= REPLAY_WORDS:
                yield flush(held, blocks)
                held, blocks = [], []
        if held:
            yield flush(held, blocks)

    return run


def _splitter(path: str, keys: pa.Schema):
    """Blocks of documents: their keys, their words, and the numbers of the words of each document."""

    def block(rows: list[pa.RecordBatch], texts: list[str | None]) -> pa.RecordBatch:
        number: dict[str, int] = {}
        seen: dict[str, np.ndarray] = {}
        codes, size = [], []
        for text in texts:
            if not text:
                size.append(0)
                continue
            mine = seen.get(text)
            if mine is None:
                words = split_words(text, path)
                mine = seen[text] = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words))
            codes.append(mine)
            size.append(len(mine))
        whole = pa.Table.from_batches(rows).combine_chunks()
        own = pa.StructArray.from_arrays([whole.column(i).combine_chunks() if whole.num_rows else pa.array([], keys.field(i).type) for i in range(len(keys))], fields=list(keys))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), one(own), one(pa.array(size, pa.int32())), one(pa.array(flat, pa.int32())), one(pa.array(list(number), pa.string()))], ["block", "docs", "size", "codes", "words"])

    def run(batches):
        rows, texts, chars = [], [], 0
        for b in batches:
            own = pa.RecordBatch.from_arrays([b.column(i).cast(f.type) for i, f in enumerate(keys)], schema=keys)
            column, begin = b.column(len(keys)).to_pylist(), 0
            for at, text in enumerate(column):
                texts.append(text)
                chars += len(text or "") + 1
                if chars >= BLOCK_CHARS:
                    rows.append(own.slice(begin, at + 1 - begin))
                    yield block(rows, texts)
                    rows, texts, chars, begin = [], [], 0, at + 1
            rows.append(own.slice(begin))
        if texts:
            yield block(rows, texts)

    return run


def _assembler(counts: bool, schema: pa.Schema):
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        docs = block["docs"].combine_chunks().flatten()
        size = block["size"].combine_chunks().flatten().to_numpy()
        codes = block["codes"].combine_chunks().flatten().to_numpy()
        lists = words["ids"].combine_chunks()
        order = np.argsort(words["pos"].to_numpy())
        length = np.diff(lists.offsets.to_numpy())[order]
        start = (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py() if len(lists) else np.zeros(0, np.int64))[order]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        own = length[codes] if len(codes) else np.zeros(0, np.int64)
        after = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        total = after[ends]
        if counts:
            out = pa.array(np.diff(total), pa.int64())
        else:
            place = np.repeat(start[codes] - after[:-1], own) + np.arange(after[-1]) if len(codes) else np.zeros(0, np.int64)
            flat = lists.flatten().to_numpy()
            out = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(flat[place] if len(place) else np.zeros(0, np.int32), pa.int32()))
        return pa.Table.from_arrays([*docs.flatten(), out], schema=schema)

    return run


def _run(spark: SparkSession, documents: DataFrame, key: str, text: str, path: str, counts: bool, keep: list[str]) -> DataFrame:
    kept = [key, *keep]
    docs = documents.select(*kept, F.col(text).alias("_text"))
    types = [to_arrow_type(docs.schema[k].dataType) for k in kept]
    keys = pa.schema(list(zip(kept, types)))
    ddl = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    inner = ", ".join(f"`{k}`: {docs.schema[k].dataType.simpleString()}" for k in kept)
    cores = spark.sparkContext.defaultParallelism
    if docs.select(F.spark_partition_id().alias("p")).distinct().count() < cores:  # reads no column
        docs = docs.repartition(cores * 2)
    scratch = Scratch(spark, "words")
    blocks = scratch.put(docs.mapInArrow(_splitter(path, keys), f"block string, docs array<struct<{inner}>>, size array<int>, codes array<int>, words array<string>"), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    encoded, seen = scratch.put_counted(words.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).mapInArrow(_encoder(path), "word string, _n bigint, ids array<int>"), "encoded", rows=F.sum("_n"))
    mine = salted_lookup(words, encoded.drop("_n"), ["word"], F.col("block"), seen["rows"] or 0).select("block", "pos", "ids")
    schema = pa.schema([*keys, ("n_tokens", pa.int64()) if counts else ("ids", pa.list_(pa.int32()))])
    return blocks.select(F.col("block").alias("of"), "docs", "size", "codes").groupBy("of").cogroup(mine.groupBy("block")).applyInArrow(_assembler(counts, schema), f"{ddl}, " + ("n_tokens bigint" if counts else "ids array<int>"))


def _file(name: str, tokenizer_dir: str) -> str:
    return os.path.join(tokenizer_dir, f"{name}.json")


def encode_corpus(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """key, ids: every row of documents with the ids of its text, without special tokens.

    A null text and an empty text give an empty list; repeated rows give repeated rows; an empty
    table gives none. The tokenizer file must be at the same path on every executor. Other columns,
    whatever their names, are not read.
    """
    return _run(spark, documents, key, text, _file(name, tokenizer_dir), False, [])


def token_counts(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, keep: list[str] | None = None) -> DataFrame:
    """key, columns to keep, n_tokens: as :func:`encode_corpus`, only the number of ids (0 for null and empty texts)."""
    return _run(spark, documents, key, text, _file(name, tokenizer_dir), True, keep or [])
