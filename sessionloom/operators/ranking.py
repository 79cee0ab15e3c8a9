"""Ranking of fused candidates: eligibility, duplicate groups, active-branch prior, neighbours.

Candidates are (query_id, id, fused_score, distance, lexical_rank, identifier_rank) beside the columns
of their dense document. Groups are the connected components of overlapping siblings and exact copies
among the candidates of one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components

ACTIVE_PRIOR = 0.01
MAX_DISTANCE = 0.5
# Columns in which the chunks of one text run agree.
RUN_COLUMNS = [
    "schema_version", "session_id", "session_path", "entry_id", "contributing_entry_ids", "document_kind", "summary_kind", "evidence_kind",
    "evidence_part", "is_dense_searchable", "role", "text_run_id", "text_run_index", "chunk_count", "line_start", "line_end", "block_start", "block_end",
]
COPY_COLUMNS = ["checksum", "content", "document_kind", "summary_kind", "evidence_kind", "evidence_part", "role"]


def eligible(distance: Column, lexical: Column, identifier: Column) -> Column:
    """Keep what a lexical or identifier channel found, what has no dense distance, or what is near."""
    return lexical.isNotNull() | identifier.isNotNull() | distance.isNull() | (distance <= MAX_DISTANCE)


def is_atomic(df_prefix: str = "") -> Column:
    """Plain conversation content of a user, assistant or custom message without tool provenance."""
    c = lambda n: F.col(df_prefix + n)
    tools = ["tool_call_id", "tool_name", "tool_call_entry_id", "tool_result_entry_id", "tool_error"]
    out = (c("document_kind") == "conversation") & c("summary_kind").isNull() & (c("evidence_kind") == "conversation") & (c("evidence_part") == "content") & c("role").isin("user", "assistant", "custom")
    for t in tools:
        out &= c(t).isNull()
    return out


def _same(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def sibling_overlap() -> Column:
    """Shared characters of chunk a and its next sibling b; null if they are no contiguous siblings of one run."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    linked = (
        _same(RUN_COLUMNS) & (a("next_sibling_id") == b("id")) & (b("previous_sibling_id") == a("id")) & F.array_contains(a("sibling_ids"), b("id"))
        & F.array_contains(b("sibling_ids"), a("id")) & (b("chunk_index") == a("chunk_index") + 1) & (b("token_start") == a("token_end") - b("overlap_tokens"))
        & (a("char_start") < b("char_start")) & (a("char_end") <= b("char_end"))
    )
    shared = a("char_end") - b("char_start")
    text = (shared <= F.length(a("content"))) & (shared <= F.length(b("content"))) & (b("overlap_tokens") > 0) & (F.expr("right(a.content, a.char_end - b.char_start)") == F.expr("left(b.content, a.char_end - b.char_start)"))
    return F.when(linked & (shared == 0) & (b("overlap_tokens") == 0), 0).when(linked & (shared > 0) & text, shared)


def duplicate_links(candidates: DataFrame) -> DataFrame:
    """(query_id, a, b): candidates that are overlapping siblings or exact copies in different sessions."""
    left, right = candidates.alias("a"), candidates.alias("b")
    one = F.col("a.query_id") == F.col("b.query_id")
    pick = [F.col("a.query_id").alias("query_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")]
    siblings = left.join(right, one & (F.col("a.text_run_id") == F.col("b.text_run_id")) & (F.col("a.next_sibling_id") == F.col("b.id"))).where(sibling_overlap() > 0).select(*pick)
    copies = left.join(right, one & (F.col("a.checksum") == F.col("b.checksum")) & (F.col("a.session_path") != F.col("b.session_path")) & (F.col("a.id") < F.col("b.id"))).where(_same(COPY_COLUMNS)).select(*pick)
    return siblings.unionByName(copies)


def rank(spark: SparkSession, candidates: DataFrame, limit: int) -> DataFrame:
    """One row per duplicate group: query_id, id (representative), fused_score, active_prior, ranking_score, occurrences, place.

    The representative has the best fused score (ties: smaller id); occurrences lists the others in that
    order. A group with any member on the active branch gets the prior. Order: ranking score, fused
    score, id. Candidates per query are bounded by the fusion limit (600).
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1..200")
    kept = candidates.where(eligible(F.col("distance"), F.col("lexical_rank"), F.col("identifier_rank")))
    code = kept.select("query_id", "id").distinct().withColumn("node", F.xxhash64("query_id", "id"))
    links = duplicate_links(kept).select(F.xxhash64("query_id", "a").alias("a"), F.xxhash64("query_id", "b").alias("b"))
    group = code.join(components(spark, links), "node", "left").select("query_id", "id", F.coalesce("component", "node").alias("grp"))
    best = W.partitionBy("query_id", "grp").orderBy(F.col("fused_score").desc(), "id")
    placed = kept.join(group, ["query_id", "id"]).withColumn("nth", F.row_number().over(best))
    merged = placed.groupBy("query_id", "grp").agg(
        F.min_by("id", "nth").alias("id"), F.max("fused_score").alias("fused_score"), F.bool_or("is_active").alias("active"),
        F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("all"))
    scored = merged.withColumn("active_prior", F.when(F.col("active"), ACTIVE_PRIOR).otherwise(0.0)).withColumn("ranking_score", F.col("fused_score") + F.col("active_prior"))
    w = W.partitionBy("query_id").orderBy(F.col("ranking_score").desc(), F.col("fused_score").desc(), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(
        "query_id", "id", "fused_score", "active_prior", "ranking_score", F.expr("transform(slice(all, 2, size(all)), x -> x.id)").alias("occurrences"), "place")


def neighbour_context(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """``ranked`` with context and context_ids: an atomic result stitched to one contiguous sibling on either side.

    Overlapping characters appear once; a gap on one side leaves that sibling out; other results keep null.
    """
    documents = documents.drop(*[c for c in ranked.columns if c != "id"])
    own = ranked.select("query_id", "id").join(documents, "id").where(is_atomic())
    pairs = []
    for side, link, first in (("before", "previous_sibling_id", False), ("after", "next_sibling_id", True)):
        near = documents.where(is_atomic())
        x, y = (own.alias("a"), near.alias("b")) if first else (near.alias("a"), own.alias("b"))
        on = F.col(f"{'a' if first else 'b'}.{link}") == F.col(f"{'b' if first else 'a'}.id")
        me, other = ("a", "b") if first else ("b", "a")
        cut = (F.expr("substring(b.content, a.char_end - b.char_start + 1)") if first else F.expr("left(a.content, length(a.content) - (a.char_end - b.char_start))"))
        pairs.append(x.join(y, on).where(sibling_overlap().isNotNull()).select(F.col(f"{me}.query_id").alias("query_id"), F.col(f"{me}.id").alias("id"), F.col(f"{other}.id").alias(f"{side}_id"), cut.alias(side)))
    text = own.select("query_id", "id", "content")
    for p in pairs:
        text = text.join(p, ["query_id", "id"], "left")
    stitched = text.where("before is not null or after is not null").select(
        "query_id", "id", F.concat(F.coalesce("before", F.lit("")), "content", F.coalesce("after", F.lit(""))).alias("context"),
        F.array_compact(F.array("before_id", "id", "after_id")).alias("context_ids"))
    return ranked.join(stitched, ["query_id", "id"], "left")
