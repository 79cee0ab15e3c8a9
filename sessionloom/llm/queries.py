"""Queries of the language-model data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import current_rows, keep_live
from . import conversations as conv
from . import packing, split, truncation
from .bpe import encode_corpus
from .neardup import NearDuplicates
from .oracle import ORACLE  # noqa: F401

QUERIES: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    policies = spark.read.parquet(f"{d}/chunk_policies.parquet").select("policy_id", "max_tokens", "overlap_tokens")
    least = policies.agg(F.min("max_tokens")).first()[0] or 0
    limits = current_rows(spark.read.parquet(f"{d}/sessions.parquet").select("session_key", "policy_id", "ingested_at"), "session_key").join(policies, "policy_id").select("session_key", "max_tokens", "overlap_tokens")
    rows = spark.read.parquet(f"{d}/entries.parquet").select("entry_key", "row_id", "session_key", "ingested_at", "deleted_at", F.col("message_content").alias("text"))
    stale_free = keep_live(rows).where(F.length("text") > 2 * least)
    items = stale_free.join(limits, "session_key").select(F.col("entry_key").alias("item"), "text", "max_tokens", "overlap_tokens")
    return split.split_oversized(items)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries that the operator cut: each cut item has exactly one first piece."""
    return _oversized(spark, d).where("piece_no = 0").select(F.col("item").alias("entry_key"))


@query
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).withColumnRenamed("item", "entry_key")


@query
def p1_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of each cut entry: whether its pieces fit, follow each other without gaps, keep to the overlap and spell the whole content."""
    pieces = _oversized(spark, d)
    policies = spark.read.parquet(f"{d}/chunk_policies.parquet").select("policy_id", "max_tokens", "overlap_tokens")
    limits = current_rows(spark.read.parquet(f"{d}/sessions.parquet").select("session_key", "policy_id", "ingested_at"), "session_key").join(policies, "policy_id").select("session_key", "max_tokens", "overlap_tokens")
    rows = spark.read.parquet(f"{d}/entries.parquet").select("entry_key", "row_id", "session_key", "ingested_at", "deleted_at", F.col("message_content").alias("text"))
    whole = keep_live(rows).join(limits, "session_key").select(F.col("entry_key").alias("item"), "text", "max_tokens", "overlap_tokens")
    p = F.transform("all", lambda x: x)
    before = lambda i: F.get(p, i - 1)
    follow = F.forall(F.transform("all", lambda x, i: (x["no"] == i) & F.when(i == 0, x["char_start"] == 0).otherwise(
        (x["char_start"] <= before(i)["char_end"]) & (x["char_end"] > before(i)["char_end"]) & (x["token_start"] >= before(i)["token_end"] - F.col("overlap_tokens")) & (x["token_start"] <= before(i)["token_end"]))), lambda ok: ok)
    one = pieces.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("piece_no").alias("no"), "char_start", "char_end", "token_start", "token_end", "piece"))).alias("all"))
    tested = one.join(whole, "item")
    fits = F.forall("all", lambda x: x["token_end"] - x["token_start"] <= F.col("max_tokens"))
    spelled = F.forall("all", lambda x: x["piece"] == F.substring("text", x["char_start"] + 1, x["char_end"] - x["char_start"]))
    return tested.select(F.col("item").alias("entry_key"), fits.alias("fits"), (follow & spelled & (F.element_at("all", -1)["char_end"] == F.length("text"))).alias("covers"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return conv.verdicts(spark, spark.read.parquet(f"{d}/entries.parquet"), spark.read.parquet(f"{d}/sessions.parquet"))[0]


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where("verdict <> 'ok'").select("session_key")


@query
def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query
def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conv.conversations(spark, spark.read.parquet(f"{d}/entries.parquet"), spark.read.parquet(f"{d}/sessions.parquet"))


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    rows = spark.read.parquet(f"{d}/entries.parquet").select("entry_key", "row_id", "ingested_at", "deleted_at", "record_type", "message_role", "message_content")
    turns = keep_live(rows).where((F.col("record_type") == "message") & F.col("message_role").isin("user", "assistant"))
    return NearDuplicates(spark, turns.select(F.col("entry_key").alias("id"), F.col("message_content").alias("text")), width=3, similarity=(3, 5), least_words=24)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("id_a").alias("entry_key_a"), F.col("id_b").alias("entry_key_b"))


@query
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "entry_key")


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", "ids")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spark, spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/token_budgets.parquet"))


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of used space of each budget."""
    used = _packed(spark, d).groupBy("budget_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    budgets = spark.read.parquet(f"{d}/token_budgets.parquet").select("budget_id", "capacity_tokens")
    return used.join(budgets, "budget_id").withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


@query
def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each budget: documents placed whole or in consecutive pieces, documents with a gap, containers above the capacity."""
    packed = _packed(spark, d)
    budgets = spark.read.parquet(f"{d}/token_budgets.parquet").select("budget_id", "capacity_tokens")
    w = Window.partitionBy("budget_id", "doc_id").orderBy("piece_no")
    gap = (F.col("piece_no") != F.row_number().over(w) - 1) | (F.col("token_start") != F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(w), F.lit(0)))
    docs = packed.withColumn("gap", gap).groupBy("budget_id").agg(F.countDistinct("doc_id").alias("documents"), F.count_if("gap").alias("gaps"))
    used = packed.groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("n")).join(budgets, "budget_id").groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    return docs.join(used, "budget_id").select("budget_id", "documents", "gaps", "overfull")


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(spark, spark.read.parquet(f"{d}/documents.parquet")).where("verdict <> 'whole'").select("doc_id")


@query
def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(spark, spark.read.parquet(f"{d}/documents.parquet"))
