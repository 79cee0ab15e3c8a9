"""Embedding providers behind one interface, and embedding of a table in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """What embeds texts: a width and a function from texts to as many vectors. It is shipped to the workers."""

    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedding:
    """A deterministic provider without a model: signed hashes of words and word pairs, scaled to unit length."""

    width: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v, words = np.zeros(self.width), text.lower().split()
            for item in [*words, *(" ".join(p) for p in zip(words, words[1:]))] or [""]:
                h = int.from_bytes(hashlib.blake2b(item.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                v[(h >> 1) % self.width] += 1.0 if h & 1 else -1.0
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else np.eye(1, self.width)[0]).tolist())
        return out


@dataclass(frozen=True)
class HttpEmbedding:
    """A service that answers POST {model, input} at <base_url>/embeddings with {data: [{index, embedding}]}.

    Texts go in batches; a failed connection is tried twice, an answer never; order follows ``index``.
    """

    base_url: str
    model: str
    width: int
    batch: int = 16
    timeout_seconds: float = 60.0

    def _post(self, texts: list[str]) -> dict:
        url = f"{self.base_url.removesuffix('/')}/embeddings"
        body = json.dumps({"model": self.model, "input": texts}).encode()
        for attempt in (1, 2):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"content-type": "application/json"}), timeout=self.timeout_seconds) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                raise RuntimeError(f"embedding request failed ({e.code}): {e.read()[:500]!r}") from None
            except TimeoutError:
                raise RuntimeError(f"embedding request timed out at {url}") from None
            except OSError as e:
                if attempt == 2:
                    raise RuntimeError(f"embedding request failed at {url}: {e}") from None
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            part = texts[k:k + self.batch]
            data = sorted(self._post(part).get("data", []), key=lambda d: d.get("index", 0))
            if len(data) != len(part):
                raise RuntimeError(f"{len(part)} texts gave {len(data)} vectors")
            if any(len(d.get("embedding") or []) != self.width for d in data):
                raise RuntimeError(f"a vector has not {self.width} components")
            out += [d["embedding"] for d in data]
        return out


def embed_texts(rows: DataFrame, provider: EmbeddingProvider, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, vector) of every row; a null text is embedded as an empty one. One provider call per Arrow batch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vector": provider.embed([t or "" for t in f["text"]])})

    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, vector array<double>")
