"""Validity, parity and uniqueness checks over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    keys = [key] if isinstance(key, str) else key
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def parity(name: str, left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """(check_name, left_rows, right_rows, left_only, right_only), each side counted once."""
    keys = [key] if isinstance(key, str) else key
    side = lambda df, n: df.select(*keys).groupBy(*keys).agg(F.count("*").alias(n))
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    return both.agg(
        F.lit(name).alias("check_name"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def duplicates(df: DataFrame, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def invalid_documents(docs: DataFrame) -> DataFrame:
    """Dense documents that are none of the four legal combinations or carry tool provenance."""
    c = F.col
    legal = (
        ((c("document_kind") == "conversation") & c("summary_kind").isNull() & (c("evidence_kind") == "conversation") & c("role").isin("user", "assistant", "custom"))
        | ((c("document_kind") == "turn_context") & c("summary_kind").isNull() & (c("evidence_kind") == "turn_context") & (c("role") == "turn"))
        | ((c("document_kind") == "summary") & (c("summary_kind") == "compaction") & (c("evidence_kind") == "compaction_summary") & (c("role") == "summary"))
        | ((c("document_kind") == "summary") & (c("summary_kind") == "branch") & (c("evidence_kind") == "branch_summary") & (c("role") == "summary")))
    fine = legal & c("is_dense_searchable") & (c("evidence_part") == "content")
    for tool in ("tool_call_id", "tool_name", "tool_call_entry_id", "tool_result_entry_id", "tool_error"):
        fine &= c(tool).isNull()
    return docs.where(~F.coalesce(fine, F.lit(False)))


def vector_problem(vector: Column, width: int) -> Column:
    """What keeps a vector from being stored (missing, width, not_finite, zero), null for none; FP32 decides."""
    narrow = F.transform(vector, lambda x: x.cast("float"))
    bad = F.exists(narrow, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "missing").when(F.size(vector) != width, "width").when(bad, "not_finite").when(~F.exists(narrow, lambda x: x != 0), "zero")


def write_problems(docs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, problem) of everything that forbids writing: repeated or foreign ids, missing or bad vectors, illegal documents.

    ``docs``: id and the members of a dense document; ``vectors``: id, vector. No rows means that documents and
    vectors match one to one.
    """
    both = docs.select("id").distinct().join(vectors.select("id", "vector"), "id", "left")
    bad = both.select("id", vector_problem(F.col("vector"), width).alias("problem")).where("problem is not null")
    again = lambda df, name: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null or cast(id as string) = ''").select("id", F.lit(name).alias("problem"))
    foreign = missing(vectors.select("id"), docs, "id").select("id", F.lit("no_document").alias("problem"))
    return bad.unionByName(again(docs, "repeated_document")).unionByName(again(vectors, "repeated_vector")).unionByName(foreign).unionByName(invalid_documents(docs).select("id", F.lit("illegal_document").alias("problem")))


def vector_parity(docs: DataFrame, vectors: DataFrame, buckets: int = 16) -> DataFrame:
    """One row: documents, vectors, either side without the other, and project keys or buckets that differ.

    ``docs``: id, project_key; ``vectors``: id, project_key, project_bucket. One full join counts everything.
    """
    d = docs.select(F.col("id").alias("d_id"), F.col("project_key").alias("d_key"))
    v = vectors.select(F.col("id").alias("v_id"), F.col("project_key").alias("v_key"), F.col("project_bucket").alias("v_bucket"))
    both = d.join(v, F.col("d_id") == F.col("v_id"), "full_outer")
    off = F.col("d_id").isNotNull() & F.col("v_id").isNotNull() & ((F.col("v_key") != F.col("d_key")) | (F.col("v_bucket") != F.pmod(F.col("d_key"), F.lit(buckets))))
    return both.agg(
        F.count("d_id").alias("documents"), F.count("v_id").alias("vectors"), F.count_if(F.col("v_id").isNull()).alias("documents_without_vector"),
        F.count_if(F.col("d_id").isNull()).alias("vectors_without_document"), F.count_if(off).alias("project_mismatches"))


def projection_gaps(inputs: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of the projection inputs (session_path, projection_input_id, document_id) whose document the session lacks."""
    held = docs.select("session_path", F.col("id").alias("document_id")).distinct()
    return inputs.join(held, ["session_path", "document_id"], "left_anti")


def integrity_report(docs: DataFrame, vectors: DataFrame, invocations: DataFrame, indexed: DataFrame, inputs: DataFrame, buckets: int = 16) -> DataFrame:
    """The whole report in one row, with healthy; ``indexed``: invocation_id of everything in the inverted index."""
    fts = parity("fts", invocations, indexed, "invocation_id").select(
        F.col("left_rows").alias("invocations"), F.col("right_rows").alias("indexed_invocations"), F.col("right_only").alias("indexed_without_invocation"),
        (F.col("left_rows") - F.col("right_rows") + F.col("right_only")).alias("invocations_without_index"))
    gaps = projection_gaps(inputs, docs).agg(F.count("*").alias("inputs_without_document"))
    one = vector_parity(docs, vectors, buckets).crossJoin(fts).crossJoin(gaps)  # one-row sides
    zero = ["documents_without_vector", "vectors_without_document", "project_mismatches", "indexed_without_invocation", "invocations_without_index", "inputs_without_document"]
    return one.withColumn("healthy", sum((F.col(c) for c in zero), F.lit(0)) == 0)


def invocations_by_session(sessions: DataFrame, invocations: DataFrame, key: str = "session_path") -> DataFrame:
    """(session, invocations) of every session, 0 for those without."""
    n = invocations.groupBy(key).agg(F.count("*").alias("invocations"))
    return sessions.select(key).distinct().join(n, key, "left").select(key, F.coalesce("invocations", F.lit(0).cast("long")).alias("invocations"))


def import_summary(records: DataFrame) -> DataFrame:
    """(format, files, sessions, records) of imported files; rejected ones count under format null."""
    files = records.groupBy("session_path").agg(F.max("format").alias("format"), F.countDistinct("session_no").alias("sessions"), F.count("record_json").alias("records"))
    return files.groupBy("format").agg(F.count("*").alias("files"), F.sum("sessions").alias("sessions"), F.sum("records").alias("records"))
