"""Structured-streaming extension: session lines that arrive in new files, append-only.

The file source neither sees changed nor deleted files, so index maintenance stays a batch job over a
snapshot diff (operators.maintenance); this stream serves append-only landing folders. Orphan state that is
made over a folder outlives a restart like the stream's own checkpoint, and a batch that is delivered
again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import OrphanState


def session_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, record_type, entry_id, parent_id, text) from .jsonl files landing in ``folder``; bad lines are dropped."""
    raw = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder)
    json = F.try_parse_json("value")
    field = lambda p: F.try_variant_get(json, p, "string")
    out = raw.select(F.col("_metadata.file_path").alias("path"), field("$.type").alias("record_type"), field("$.id").alias("entry_id"), field("$.parentId").alias("parent_id"), F.col("value").alias("text"))
    return out.where("record_type is not null")


def counts_by_type(lines: DataFrame) -> DataFrame:
    return lines.groupBy("record_type").agg(F.count("*").alias("n"))


def feed_orphans(deliveries: DataFrame, state: OrphanState, checkpoint: str):
    """Advance the orphan state by every micro-batch of a stream of deliveries; returns the query."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            state.advance(batch)

    return deliveries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
