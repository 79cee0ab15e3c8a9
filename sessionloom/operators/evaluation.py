"""Retrieval-quality measurement and policy selection as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first_rank, reciprocal): first rank that holds an expected id; 0 where none does.

    ``results``: query_id, rank_no, id; ``expected``: query_id, id. Every query of ``expected`` comes out.
    """
    hits = results.join(expected.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank_no").alias("first_rank"))
    return expected.select("query_id").distinct().join(hits, "query_id", "left").withColumn("reciprocal", F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)))


def quality(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: queries, mean reciprocal rank, and the share of queries answered within the first k."""
    r = reciprocal_ranks(results, expected)
    return r.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.avg("reciprocal"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg((F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("int")), F.lit(0.0)).alias("recall"))


def nearest_rank_percentile(df: DataFrame, column: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The smallest value with at least share p of the values at or below it, per group."""
    agg = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias("value")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def duplicate_slots(results: DataFrame, signature: list[str]) -> DataFrame:
    """(query_id, slots): results whose signature an earlier result of the query already had."""
    w = W.partitionBy("query_id", *signature).orderBy("rank_no", "result_id")
    return results.withColumn("nth", F.row_number().over(w)).groupBy("query_id").agg(F.sum((F.col("nth") > 1).cast("long")).alias("slots"))


def select_policy(measured: DataFrame, gate: dict[str, float]) -> DataFrame:
    """Configurations ordered by preference, with passed and failures.

    ``measured``: name, candidate_recall, final_recall, context_recall, source_recall, duplicate_rate,
    p95_ms, chunks, index_ms, max_tokens; ``gate`` holds the bounds of the first six. Passing ones come
    first, by recall falling, then latency, chunks, time and window; blocked ones follow, fewest failures first.
    """
    floors = ["candidate_recall", "final_recall", "context_recall", "source_recall"]
    fails = [(F.col(c) < gate[c]).cast("int") for c in floors] + [(F.col(c) > gate[c]).cast("int") for c in ("duplicate_rate", "p95_ms")]
    failures = fails[0]
    for f in fails[1:]:
        failures = failures + f
    order = W.orderBy(F.col("failures"), F.col("candidate_recall").desc(), F.col("final_recall").desc(), "p95_ms", "chunks", "index_ms", "max_tokens", "name")
    # one row per configuration: a handful, so a single ordered window is right
    return measured.withColumn("failures", failures).withColumn("passed", F.col("failures") == 0).withColumn("preference", F.row_number().over(order))


def channel_proof(scoped: DataFrame, unscoped: DataFrame, expected: DataFrame, polluting: DataFrame, required: DataFrame) -> DataFrame:
    """Per query and required channel: whether the scope acts before the channel's limit, not after it.

    ``scoped`` and ``unscoped``: query_id, channel, id of candidates; ``expected`` and ``polluting``: query_id, id;
    ``required``: query_id, channel, least_polluting. A channel passes if it admits every expected id within the
    scope, none without it, and at least ``least_polluting`` polluting candidates take their places there.
    """
    want = required.join(expected.distinct(), "query_id", "left")
    hit = lambda df, name: df.select("query_id", "channel", "id").distinct().withColumn(name, F.lit(True))
    seen = want.join(hit(scoped, "inside"), ["query_id", "channel", "id"], "left").join(hit(unscoped, "outside"), ["query_id", "channel", "id"], "left")
    known = F.col("id").isNotNull()
    per = seen.groupBy("query_id", "channel", "least_polluting").agg(
        (F.count_if(known & F.col("inside").isNull()) == 0).alias("admitted"), (F.count_if(known & F.col("outside").isNotNull()) == 0).alias("displaced"))
    spoilt = unscoped.join(polluting.distinct(), ["query_id", "id"], "left_semi").groupBy("query_id", "channel").agg(F.count("*").alias("polluting"))
    out = per.join(spoilt, ["query_id", "channel"], "left").withColumn("polluting", F.coalesce("polluting", F.lit(0).cast("long")))
    return out.withColumn("passed", F.col("admitted") & F.col("displaced") & (F.col("polluting") >= F.col("least_polluting"))).select("query_id", "channel", "admitted", "displaced", "polluting", "passed")


def matched_sources(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Every pair of a result group's member and an expected source that it satisfies.

    ``members``: query_id, rank_no (of the group), dense_rank, session_path, entry_ids (own and contributing), content,
    evidence_kind, summary_kind, is_active, cwd, relation. ``expected``: query_id, source_no, session_file, entry_id,
    required_text, want_evidence, want_summary, want_branch, want_origin, want_relation, required_entries. Matching
    is an equi-join on query, file name and entry, then all required texts must occur; null wishes are none.
    """
    each = members.select("*", F.explode(F.array_distinct("entry_ids")).alias("entry_id")).withColumn("session_file", F.element_at(F.split("session_path", "/"), -1))
    both = each.join(expected, ["query_id", "session_file", "entry_id"])
    holds = lambda wish, has: F.col(wish).isNull() | F.col(wish).eqNullSafe(F.col(has))
    texts = F.forall(F.coalesce("required_text", F.array().cast("array<string>")), lambda t: F.contains("content", t))
    return both.where(texts & holds("want_evidence", "evidence_kind") & holds("want_summary", "summary_kind"))


def case_quality(members: DataFrame, shown: DataFrame, expected: DataFrame, cases: DataFrame, counts: list[int]) -> DataFrame:
    """One row per case and number k of final results: what the first k groups recall, preserve and verify.

    ``shown``: query_id, rank_no, text (content or stitched context of the group); ``cases``: query_id,
    required_context, least_sources. recalled: some group holds an expected source; preserved: how many sources;
    context: a group with a source shows every required fragment, without regard to case; origins, relations,
    contributing, branches: every source has a match with what it asks for. A case without results fails.
    """
    hits = matched_sources(members, expected)
    branch = F.when(F.col("want_branch") == "active", F.col("is_active")).when(F.col("want_branch") == "abandoned", ~F.col("is_active")).otherwise(True)
    parts = F.forall(F.coalesce("required_entries", F.array().cast("array<string>")), lambda e: F.array_contains("entry_ids", e))
    ks = F.explode(F.array(*[F.lit(k) for k in counts])).alias("k")
    tests = {"origins": F.col("cwd").eqNullSafe(F.col("want_origin")), "relations": F.col("relation").eqNullSafe(F.col("want_relation")), "contributing": parts, "branches": branch}
    flagged = hits.select("query_id", "source_no", "rank_no", *[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()], ks).where("rank_no <= k")
    source = flagged.groupBy("query_id", "k", "source_no").agg(*[F.bool_or(n).alias(n) for n in tests])
    done = source.groupBy("query_id", "k").agg(F.count("*").alias("preserved"), *[F.count_if(n).alias(n) for n in tests])
    asked = expected.groupBy("query_id").agg(F.countDistinct("source_no").alias("asked"))
    wanted = shown.join(hits.select("query_id", "rank_no").distinct(), ["query_id", "rank_no"], "left_semi").join(cases.select("query_id", "required_context"), "query_id")
    useful = wanted.where(F.forall(F.coalesce("required_context", F.array().cast("array<string>")), lambda t: F.contains(F.lower("text"), F.lower(t)))).groupBy("query_id").agg(F.min("rank_no").alias("useful_at"))
    out = cases.select("query_id", "least_sources", ks).join(asked, "query_id", "left").join(done, ["query_id", "k"], "left").join(useful, "query_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(
        "query_id", "k", (n("preserved") > 0).alias("recalled"), n("preserved").alias("preserved"), (n("preserved") >= F.col("least_sources")).alias("preserved_enough"),
        F.coalesce(F.col("useful_at") <= F.col("k"), F.lit(False)).alias("context"), *[(n(t) == n("asked")).alias(t) for t in tests])


def quality_summary(measured: DataFrame) -> DataFrame:
    """(k, cases, and the share of cases that pass each test) of ``case_quality``; no cases give no rows."""
    flags = ["recalled", "preserved_enough", "context", "origins", "relations", "contributing", "branches"]
    return measured.groupBy("k").agg(F.count("*").alias("cases"), *[F.avg(F.col(f).cast("int")).alias(f) for f in flags])


def report(summary: DataFrame) -> str:
    """The summary as a Markdown table; one row per k, so a handful."""
    rows, names = summary.orderBy("k").collect(), [c for c in summary.columns if c not in ("k", "cases")]
    head = ["| results | cases | " + " | ".join(n.replace("_", " ") for n in names) + " |", "|-|-|" + "-|" * len(names)]
    return "\n".join(head + [f"| {r.k} | {r.cases} | " + " | ".join(f"{r[n]:.1%}" for n in names) + " |" for r in rows])
