"""Reciprocal-rank fusion of candidate channels and the policy that mixes two result kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def channel_ranks(candidates: DataFrame, channel: str, score: str, ascending: bool) -> DataFrame:
    """(query_id, id, channel, score, rank): best rank of each id in one channel; ties go to the smaller id."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "id")))
    return ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.min_by(score, "rank").alias("score")).withColumn("channel", F.lit(channel))


def rrf(channels: dict[str, tuple[DataFrame, str, bool]], limit: int, constant: int = RANK_CONSTANT) -> DataFrame:
    """Fused (query_id, id, fused_score, position), the sum over channels of 1 / (constant + rank).

    ``channels`` maps a name to (candidates, score column, smaller is better). An id found by several
    channels comes out once. Order: score falling, then id. Empty channels are fine.
    """
    if not 1 <= limit <= 600:
        raise ValueError("limit must lie in 1..600")
    ranked = None
    for name, (df, score, ascending) in channels.items():
        part = channel_ranks(df, name, score, ascending).select("query_id", "id", "channel", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("fused_score"))
    w = W.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "id")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def mix(conversations: DataFrame, invocations: DataFrame, limit: int) -> DataFrame:
    """One list of at most ``limit`` rows per query from two ranked ones (query_id, id, position).

    With both kinds present and limit > 1, max(1, limit // 3) places are reserved for invocations,
    conversations fill the rest, left-over places go to invocations; the two alternate, tails follow.
    Result: query_id, kind, id, place.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1..200")
    both = conversations.select("query_id", "id", "position", F.lit("conversation").alias("kind")).unionByName(invocations.select("query_id", "id", "position", F.lit("invocation").alias("kind")))
    q = W.partitionBy("query_id")
    is_c = F.col("kind") == "conversation"
    n = both.withColumn("n_c", F.sum(is_c.cast("int")).over(q)).withColumn("n_i", F.sum((~is_c).cast("int")).over(q))
    alone = (F.col("n_i") == 0) | (F.lit(limit) == 1)
    reserve = max(1, limit // 3)
    take_c = F.when(F.col("n_c") == 0, 0).when(alone, limit).otherwise(F.least(F.col("n_c"), F.lit(limit - reserve)))
    take_i = F.when(F.col("n_c") == 0, F.lit(limit)).when(alone, 0).otherwise(F.least(F.col("n_i"), F.lit(limit) - take_c))
    kept = n.withColumn("take_c", take_c).withColumn("take_i", take_i).where(F.col("position") <= F.when(is_c, F.col("take_c")).otherwise(F.col("take_i")))
    pairs = F.least(F.least("take_c", "n_c"), F.least("take_i", "n_i"))
    order = W.partitionBy("query_id").orderBy(F.when(F.col("position") <= pairs, 0).otherwise(1), F.when(F.col("position") <= pairs, F.col("position") * 2 + (~is_c).cast("int")), (~is_c).cast("int"), "position")
    return kept.withColumn("place", F.row_number().over(order)).select("query_id", "kind", "id", "place")
