"""Splitting oversized items at natural boundaries by pointer doubling.

For every token position the table of successors holds the farthest legal end of the piece that would
start there (after stepping back by the overlap). Squaring that table while marking what the start
reaches yields all greedy cuts of all texts of an Arrow batch in log2(pieces) vectorised rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WS

_TOKEN = re.compile(f"[^{PY_WS}]+")
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE_END = re.compile(f"[.!?…。！？][\"'’”)\\]»」』]*(?=[{PY_WS}])")
_HEADING = re.compile("#{1,6}$")
_FENCE = re.compile("(```|~~~)")
#: Kinds of cuts, the most natural first.
KINDS = ["heading", "paragraph", "fence", "line", "sentence", "token"]
PIECES = "item long, piece_no int, n_pieces int, token_start int, token_end int, overlap int, char_start int, char_end int, cut string, piece string"


def boundary_kinds(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index into KINDS for each position between two tokens; position p lies before token p."""
    n = len(starts)
    kinds = np.full(n + 1, KINDS.index("token"), np.int8)
    if n < 2:
        return kinds
    breaks = np.array([m.start() for m in _BREAK.finditer(text)], np.int64)
    lines = np.searchsorted(breaks, starts[1:]) - np.searchsorted(breaks, ends[:-1])
    stops = np.array([m.end() for m in _SENTENCE_END.finditer(text)], np.int64)
    kinds[1:n][np.isin(ends[:-1], stops)] = KINDS.index("sentence")
    kinds[1:n][lines >= 1] = KINDS.index("line")
    heads = np.concatenate([[0], np.flatnonzero(lines >= 1) + 1])
    inside = False
    for at, nxt in zip(heads.tolist(), [*heads[1:].tolist(), n]):
        if _FENCE.match(text, starts[at]):
            edge = at if not inside else nxt
            inside = not inside
            if 0 < edge < n:
                kinds[edge] = KINDS.index("fence")
    kinds[1:n][lines >= 2] = KINDS.index("paragraph")
    for at in heads[1:].tolist():
        if at + 1 < n and lines[at] == 0 and ends[at] - starts[at] <= 6 and _HEADING.match(text[starts[at]:ends[at]]):
            kinds[at] = KINDS.index("heading")
    return kinds


def successors(kinds: np.ndarray, most: int, overlap: int) -> np.ndarray:
    """Farthest legal end for the piece that follows a cut at each position; the end leads to itself.

    A piece starts ``overlap`` tokens before the cut and holds at most ``most`` tokens. Of the cuts in
    the second half of that reach the last one of the most natural kind is taken, else the hard limit.
    """
    n = len(kinds) - 1
    at = np.arange(n + 1)
    start = np.maximum(at - overlap, 0)
    hard = np.minimum(start + most, n)
    low = np.maximum(start + (hard - start) // 2, start + overlap)
    out = np.where(hard >= n, n, -1)
    for k in range(len(KINDS) - 1):
        last = np.maximum.accumulate(np.where(kinds == k, at, -1))[hard]
        out = np.where((out < 0) & (last > low), last, out)
    return np.where(out < 0, hard, out)


def reached(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Positions on the orbits of the seeds: mark, square the table, repeat until nothing is added."""
    mark = np.zeros(len(table), bool)
    mark[seeds] = True
    while True:
        before = int(mark.sum())
        mark[table[mark]] = True
        if int(mark.sum()) == before:
            return mark
        table = table[table]


def _frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, tables, offset = [], [], 0
        for item, text, most, overlap in zip(frame["item"].tolist(), frame["text"].tolist(), frame["most"].tolist(), frame["overlap"].tolist()):
            spans = [m.span() for m in _TOKEN.finditer(text)]
            if len(spans) <= most:
                continue
            starts, ends = (np.array(x, np.int64) for x in zip(*spans))
            kinds = boundary_kinds(text, starts, ends)
            tables.append(successors(kinds, most, overlap) + offset)
            texts.append((item, text, starts, kinds, overlap, offset))
            offset += len(kinds)
        rows = []
        if tables:
            mark = reached(np.concatenate(tables), np.array([t[5] for t in texts]))
            for item, text, starts, kinds, overlap, base in texts:
                n = len(starts)
                cuts = np.flatnonzero(mark[base:base + n + 1])[1:].tolist()
                prev = 0
                for i, cut in enumerate(cuts):
                    first = max(prev - overlap, 0) if i else 0
                    a = int(starts[first]) if i else 0
                    b = int(starts[cut]) if cut < n else len(text)
                    rows.append((item, i, len(cuts), first, cut, prev - first if i else 0, a, b, "end" if cut == n else KINDS[kinds[cut]], text[a:b]))
                    prev = cut
        yield pd.DataFrame(rows, columns=["item", "piece_no", "n_pieces", "token_start", "token_end", "overlap", "char_start", "char_end", "cut", "piece"])


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of the items that exceed their limit; ``items`` has item, text, max_tokens, overlap_tokens.

    Tokens are runs between white space. Pieces follow each other without gaps (a piece ends where the
    next token starts), hold at most max_tokens tokens, and share ``overlap`` tokens with the piece
    before. Items within their limit, null and blank texts and null or non-positive limits give no
    pieces; a null or negative overlap is 0 and one of max_tokens or more is max_tokens - 1. Repeated
    items are split each for itself, other columns are ignored. A text below 2 * max_tokens + 1
    characters cannot hold more than max_tokens tokens and never leaves the JVM.
    """
    most = F.col("max_tokens").cast("int")
    overlap = F.greatest(F.least(F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)), most - 1), F.lit(0))
    long = items.where((most > 0) & (F.length("text") > 2 * most.cast("long"))).select(F.col("item").cast("long").alias("item"), "text", most.alias("most"), overlap.alias("overlap"))
    return long.mapInPandas(_frames, PIECES)
