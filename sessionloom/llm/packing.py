"""Filling fixed-capacity containers with texts by bounded-space online packing.

Each task keeps a fixed number of open windows per budget, places every text best-fit, and emits the
fullest window when none fits. What is left in open windows is bounded by tasks x windows; those items
are regrouped into bounded merge tasks and packed best-fit decreasing.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from .bpe import VOCABULARIES, WORDS, parse_ranks

WINDOWS = 64
MERGE_ITEMS = 100_000
ITEM = "budget_id int, capacity int, container string, position int, doc_id long, piece_no int, token_start int, n_tokens int, open boolean"

_counters: dict[tuple[str, str], Callable[[list[str]], list[int]]] = {}


def counter(name: str, folder: str = VOCABULARIES) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts by a public tokenizer; loaded once per worker."""
    if (name, folder) in _counters:
        return _counters[name, folder]
    base = os.path.join(folder, name)
    if os.path.exists(base + ".tiktoken"):
        import tiktoken

        with open(base + ".tiktoken", "rb") as f:
            enc = tiktoken.Encoding(name, pat_str=WORDS.pattern, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
        count = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    elif os.path.exists(base + ".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=base + ".model")
        count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    elif os.path.exists(base + ".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(base + ".json")
        tok.encode_special_tokens = True
        count = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    else:
        raise ValueError(f"no tokenizer {name} in {folder}")
    _counters[name, folder] = count
    return count


class Windows:
    """Open windows of one budget: best-fit placement among at most ``most`` of them."""

    def __init__(self, capacity: int, most: int | None):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, size: int, item) -> tuple[int, list] | None:
        """Put an item of at most the capacity somewhere; returns the window it forced out, if any."""
        out, at = None, bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if self.most and len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                out = fullest, self.held.pop(fullest)
            room, window = self.capacity, self.opened
            self.held[window], self.opened = [], self.opened + 1
        self.held[window].append(item)
        bisect.insort(self.free, (room - size, window))
        return out


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of an item: one piece, or capacity-sized ones and a rest if it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(capacity, size - a)) for a in range(0, size, capacity)]


def _pack(budgets: list[tuple[int, str, int]], windows: int, folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        state = {b: Windows(cap, windows) for b, _, cap in budgets}
        caps = {b: cap for b, _, cap in budgets}

        def rows(b: int, window: int, items: list, is_open: bool) -> list[tuple]:
            return [(b, caps[b], f"{b}-{task}-{window}", i, *item, is_open) for i, item in enumerate(items)]

        for frame in frames:
            texts = [t or "" for t in frame["text"].tolist()]
            sizes = {name: counter(name, folder)(texts) for name in {n for _, n, _ in budgets}}
            out: list[tuple] = []
            for b, name, cap in budgets:
                for doc, size in zip(frame["doc_id"].tolist(), sizes[name]):
                    for no, (start, length) in enumerate(pieces(size, cap)):
                        item = (doc, no, start, length)
                        if length == cap:
                            out.extend(rows(b, state[b].opened, [item], False))
                            state[b].opened += 1
                        elif forced := state[b].place(length, item):
                            out.extend(rows(b, *forced, False))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")])
        left = [r for b in state for w, items in state[b].held.items() for r in rows(b, w, items, True)]
        yield pd.DataFrame(left, columns=[c.split()[0] for c in ITEM.split(", ")])

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    budget, cap, part = int(group["budget_id"].iloc[0]), int(group["capacity"].iloc[0]), int(group["part"].iloc[0])
    bins = Windows(cap, None)
    g = group.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
    for i, size in enumerate(g["n_tokens"].tolist()):
        bins.place(size, i)
    where = {i: (w, k) for w, items in bins.held.items() for k, i in enumerate(items)}
    g["container"] = [f"{budget}-m{part}-{where[i][0]}" for i in range(len(g))]
    g["position"] = [where[i][1] for i in range(len(g))]
    return g.drop(columns=["part"])


def pack(spark: SparkSession, docs: DataFrame, budgets: DataFrame, windows: int = WINDOWS, folder: str = VOCABULARIES) -> DataFrame:
    """Assign every document to containers, for each budget (budget_id, tokenizer_name, capacity_tokens).

    Columns: budget_id, container, position (order in the container), doc_id, piece_no, token_start,
    n_tokens. Null and empty texts are items of size 0. Only texts above the capacity are split, into
    full containers and a rest. Budgets with a null or non-positive capacity, a null name or a null id
    are left out; an unknown tokenizer raises ValueError. Repeated documents are packed each time,
    other columns are ignored. ``budgets`` is a small configuration table read on the driver.
    """
    wanted = [(int(r[0]), r[1], int(r[2])) for r in budgets.select("budget_id", "tokenizer_name", "capacity_tokens").dropna().distinct().collect() if r[2] > 0]
    for _, name, _ in wanted:
        counter(name, folder)
    first, _ = materialize(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_pack(sorted(wanted), windows, folder), ITEM), "packing")
    left = first.where("open").drop("open")
    parts = max(1, -(-left.count() // MERGE_ITEMS))
    schema = ITEM.removesuffix(", open boolean")
    merged = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int")).groupBy("budget_id", "capacity", "part").applyInPandas(_merge, schema)
    return first.where("not open").drop("open").unionByName(merged).drop("capacity")
