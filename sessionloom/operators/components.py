"""Connected components of an undirected edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the (a, b) long pairs; the component is its smallest node.

    Each round is two joins on node ids with pre-aggregated minima, so no node's neighbours meet in one
    task; rounds grow with the logarithm of the diameter. Lineage is cut every round. Self links count
    as nodes, null ends are dropped, empty input gives an empty result.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    cur, path = materialize(spark, clean.where("a <> b").distinct(), "stars")
    before = None
    for _ in range(max_rounds):
        now = cur.agg(F.count("*"), mark).first()
        if now == before or now[0] == 0:
            break
        before = now
        nxt, nxt_path = materialize(spark, _small_star(_large_star(cur)).where("a <> b").distinct(), "stars")
        release(spark, path)
        cur, path = nxt, nxt_path
    return nodes.join(cur.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
