"""One search: dense candidates, fusion, ranking, neighbours, invocations and the mixed result list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fusion, lexical, ranking, vectors


def search(spark: SparkSession, documents: DataFrame, stored: DataFrame, invocations: DataFrame, query_vector: list[float], query: str, limit: int = 5,
           project: str | None = None, dense_limit: int = 8, invocation_limit: int = 8) -> DataFrame:
    """(place, kind, id, ranking_score, content, context, occurrences) of the mixed results of one query.

    ``documents``: the projected dense documents; ``stored``: id, embedding, project_identity; ``invocations``:
    invocation_id, tool_name, text, project_identity. A project limits both kinds before their limits. A
    blank query is an error; an unknown project gives no rows.
    """
    text = query.strip()
    if not text:
        raise ValueError("the query is blank")
    scope = None if project is None else F.col("project_identity") == project
    near = vectors.nearest(stored, query_vector, dense_limit, "id", "embedding", scope).withColumn("query_id", F.lit(0))
    fused = fusion.rrf({"dense": (near.withColumnRenamed("distance", "score"), "score", True)}, 3 * dense_limit)
    candidates = fused.join(near.select("id", "distance"), "id").join(documents, "id").withColumn("lexical_rank", F.lit(None).cast("int")).withColumn("identifier_rank", F.lit(None).cast("int"))
    ranked = ranking.rank(spark, candidates, limit)
    found = lexical.phrase_search(invocations, "invocation_id", ["tool_name", "text"], text, invocation_limit, scope)
    calls = found.withColumn("query_id", F.lit(0)).withColumn("position", F.row_number().over(ranking.W.partitionBy("query_id").orderBy("rank", "invocation_id"))).withColumn("id", F.col("invocation_id").cast("string"))
    mixed = fusion.mix(ranked.withColumnRenamed("place", "position"), calls, limit)
    shown = ranking.neighbour_context(ranked.drop("place"), documents).join(documents.select("id", "content"), "id").withColumn("kind", F.lit("conversation")).select("kind", "id", "ranking_score", "content", "context", "occurrences")
    call_text = invocations.select(F.lit("invocation").alias("kind"), F.col("invocation_id").cast("string").alias("id"), F.lit(None).cast("double").alias("ranking_score"), F.col("text").alias("content"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("occurrences"))
    return mixed.join(shown.unionByName(call_text), ["kind", "id"], "left").select("place", "kind", "id", "ranking_score", "content", "context", "occurrences").orderBy("place")


def details(found: DataFrame, documents: DataFrame, invocations: DataFrame, project: str | None = None, source: str | None = None) -> DataFrame:
    """``found`` of ``search`` with where each result stands in its file and how its project relates to the search's.

    Adds session_path, entry_id, line_start, line_end, role, document_kind, is_active, is_error and relation; the
    tables need project_identity and identity_source beside them.
    """
    from ..functions.identity import evidence_relation

    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    docs = documents.select(F.lit("conversation").alias("kind"), "id", *text("session_path", "entry_id"), "line_start", "line_end", *text("role", "document_kind"), "is_active", F.lit(None).cast("boolean").alias("is_error"), *text("project_identity", "identity_source"))
    calls = invocations.select(
        F.lit("invocation").alias("kind"), F.col("invocation_id").cast("string").alias("id"), *text("session_path", "entry_id"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.col("tool_name").alias("role"),
        F.lit("invocation").alias("document_kind"), F.lit(None).cast("boolean").alias("is_active"), "is_error", *text("project_identity", "identity_source"))
    relation = evidence_relation(F.lit(project).cast("string"), F.col("project_identity"), F.lit(source).cast("string"), F.col("identity_source"))
    return found.join(docs.unionByName(calls), ["kind", "id"], "left").withColumn("relation", relation).drop("project_identity", "identity_source").orderBy("place")
