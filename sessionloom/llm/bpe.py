"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each distinct word is merged once per worker with a contiguous rank array: part boundaries and the
rank of every adjacent pair are kept, the smallest rank is found by scanning, its boundary deleted
and the two neighbouring ranks refreshed. Words above ``SHORT`` bytes use a heap over the same pairs,
because repeated scans are quadratic.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_WS

SHORT = 160
CACHED_WORDS = 400_000
VOCABULARIES = "/opt/tokenizers"
_S = PY_WS
# Fixed value: the vocabulary's published pre-tokenisation pattern, white space spelled out.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NONE = 1 << 60


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the contiguous rank array."""
    cuts = list(range(len(word) + 1))
    near = [ranks.get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        low = min(near)
        if low == _NONE:
            break
        i = near.index(low)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[cuts[i]:cuts[i + 2]], _NONE)
        if i:
            near[i - 1] = ranks.get(word[cuts[i - 1]:cuts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order from a heap of (rank, start); stale entries are skipped."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> int:
        j = after[i]
        return ranks.get(word[i:after[j]], _NONE) if j < n else _NONE

    heap = [(r, i) for i in range(n - 1) if (r := pair(i)) != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != r:
            continue
        j = after[i]
        alive[j], after[i] = False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (q := pair(k)) != _NONE:
                heapq.heappush(heap, (q, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """A vocabulary with a bounded cache of encoded words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}

    def word(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        if len(raw) <= SHORT:
            self.cache[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null one. Nothing in it is a special token."""
        out: list[int] = []
        if text:
            get, new = self.cache.get, self.word
            for w in WORDS.findall(text):
                out += get(w) or new(w)
        return out


_encoders: dict[int, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """The worker's encoder for a vocabulary file's content, built once per process."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(raw))
    return _encoders[key]


def encode_corpus(spark: SparkSession, docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``docs`` with a column of token ids: one narrow Arrow pass, no shuffle.

    The vocabulary (under one megabyte, whatever the corpus) is read on the driver and broadcast. Null
    and empty texts give an empty list; every other column and every repeated row passes unchanged.
    """
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_of(shared.value).encode
        for texts in batches:
            yield pd.Series([np.array(encode(t), np.int32) for t in texts.tolist()], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))
