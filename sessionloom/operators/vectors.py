"""Stored-vector transform and exact cosine nearest neighbours, single-query and in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

BUCKETS = 16
BLOCK = 2048
#: Query blocks up to this number of bytes are broadcast; more are spread over this number of replicas of the other side.
BROADCAST_BYTES, REPLICAS = 64 << 20, 32


def stored_vector(vector: Column, width: int) -> Column:
    """First ``width`` components as FP32, scaled to unit length; an error for short or zero vectors."""
    head = F.transform(F.slice(vector, 1, width), lambda x: x.cast("float").cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.transform(head, lambda x: (x / norm).cast("float"))
    return F.when((F.size(vector) < width) | (norm == 0), F.raise_error(F.lit("vector too short or without length"))).otherwise(scaled)


def bucket(project_key: Column) -> Column:
    """Partition bucket of a project: its key modulo 16."""
    return F.pmod(project_key, F.lit(BUCKETS))


def ip_distance(inner_product: Column) -> Column:
    """Distance of an inner product of unit vectors, clamped to [0, 2]."""
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b), accumulated in double; null if either side has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.lit(1.0) - F.try_divide(dot, norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, distance) of the k nearest rows to one query, ordered by (distance, id); the scope lies below the limit.

    Each Arrow batch is one product and sends on its k best. Vectors of another width, without length, or
    with null or not-a-number parts have no distance and are left out, as is everything for such a query.
    """
    if not 1 <= k <= 200:
        raise ValueError("k must lie in 1..200")
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))
    scoped = vectors if where is None else vectors.where(where)
    rows = scoped.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == len(query))
    unit = q / norm if norm else np.full(len(q), np.nan)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(unit))
            with np.errstate(all="ignore"):
                d = 1.0 - (m @ unit) / np.sqrt(np.einsum("ij,ij->i", m, m))
            fine = np.flatnonzero(~np.isnan(d))
            if len(fine) > k:  # ties of the k-th stay in
                fine = fine[d[fine] <= np.partition(d[fine], k - 1)[k - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(fine)), pa.array(d[fine])], [id_col, "distance"])

    kind = scoped.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(best, f"`{id_col}` {kind}, distance double").orderBy("distance", id_col).limit(k)


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[int, np.ndarray]] = []

    def block() -> pd.DataFrame:
        m = np.stack([v for _, v in held])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)
        return pd.DataFrame({"ids": [np.array([i for i, _ in held])], "width": [m.shape[1]], "data": [m.tobytes()]})

    for frame in frames:
        for i, v in zip(frame["id"].tolist(), frame["v"].tolist()):
            row = np.asarray(v, np.float64)
            if np.isfinite(row).all() and row.any():
                held.append((i, row))
            if len(held) == BLOCK:
                yield block()
                held.clear()
    if held:
        yield block()


def nearest_batch(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of all rows for every query row, in blocks.

    Both sides are packed into matrices of 2048 vectors; every pair of blocks is one product whose k
    best per query survive, so the exchange carries k rows per query and block, not all pairs. Vectors
    without length or with non-finite parts, and null ids, are left out; ties go to the smaller id.
    """
    if not 1 <= k <= 200:
        raise ValueError("k must lie in 1..200")

    def packed(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
        return rows.mapInPandas(_pack, "ids array<long>, width int, data binary")

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                q = np.frombuffer(r.q_data).reshape(-1, r.width)
                c = np.frombuffer(r.data).reshape(-1, r.width)
                d, ids, own = 1.0 - q @ c.T, np.asarray(r.ids), np.asarray(r.q_ids)
                top = min(k, len(ids))
                cut = np.partition(d, top - 1, axis=1)[:, top - 1]
                row, col = np.nonzero(d <= cut[:, None] + 1e-9)
                yield pd.DataFrame({"query_id": own[row], "id": ids[col], "distance": d[row, col]})

    spark = queries.sparkSession
    q, _ = materialize(spark, packed(queries).select(F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data")), "query-blocks")
    size = q.agg(F.coalesce(F.sum(F.length("q_data")), F.lit(0))).first()[0]
    # blocks of a stated query set against blocks of all rows
    if size <= BROADCAST_BYTES:
        pairs = packed(vectors).join(F.broadcast(q), F.col("width") == F.col("q_width")).drop("q_width")
    else:  # every query block goes once to each replica, every other block to one of them, so no key holds a side
        spread = packed(vectors).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(REPLICAS)))
        copies = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(REPLICAS - 1).cast("long"))))
        pairs = spread.join(copies, (F.col("width") == F.col("q_width")) & (spread["part"] == copies["part"])).select("ids", "width", "data", "q_ids", "q_data")
    near = pairs.mapInPandas(products, "query_id long, id long, distance double")
    w = W.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
