"""Rebuilding ordered conversations from message rows and judging them with a finite-state automaton.

Rows are partitioned by session with a secondary sort by falling line number, so the automaton meets
the current leaf first, follows links, and then reads the turns in order. Sessions above ``max_group``
rows never meet in one task: their links are squared by joins and the automaton runs over fixed
segments whose summaries compose associatively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import linked_entries, live_rows
from ..functions.text import is_blank
from ..operators.forest import MAX_GROUP, parents_of, resolve_links, split_by_size, trace, whole_groups

USER, ASSISTANT = 1, 2
SEGMENT = 100_000
OUT = "session_key string, verdict string, nodes array<long>"


def judge(roles: list[int]) -> tuple[int, int, int, bool]:
    """Automaton over the roles of non-blank turns: (turns, first, last, reply missed inside).

    States are the last turn's role; a user turn that does not meet an assistant turn next is a missed
    reply. An open user turn at the end is left to the caller, so that summaries compose.
    """
    turns, first, last, missed = 0, 0, 0, False
    for role in roles:
        if role:
            missed |= last == USER and role != ASSISTANT
            first = first or role
            last = role
            turns += 1
    return turns, first, last, missed


def compose(a: tuple[int, int, int, bool], b: tuple[int, int, int, bool]) -> tuple[int, int, int, bool]:
    """The summary of two adjoining segments."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    return a[0] + b[0], a[1], b[2], a[3] or b[3] or (a[2] == USER and b[1] != ASSISTANT)


def verdict(broken: bool, summary: tuple[int, int, int, bool]) -> str:
    if broken:
        return "broken"
    if not summary[0]:
        return "empty"
    return "missing_reply" if summary[3] or summary[2] == USER else "ok"


def _frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in whole_groups(frames, "scope"):
        node, link, leaf, role, scope = (g[c].to_numpy() for c in ("node", "link_id", "leaf", "role", "scope"))
        parent = parents_of(g)
        heads = np.flatnonzero(np.concatenate([[True], scope[1:] != scope[:-1]])).tolist()
        rows = []
        for a, b in zip(heads, [*heads[1:], len(g)]):
            leaves = np.flatnonzero(leaf[a:b])
            at = a + int(leaves[0]) if len(leaves) else a
            path, seen, broken = [], set(), False
            while at >= 0 and not broken:
                if at in seen:
                    broken = True
                    break
                seen.add(at)
                path.append(at)
                broken = parent[at] < 0 and link[at] is not None
                at = int(parent[at])
            path.reverse()
            found = verdict(broken, judge(role[path].tolist()))
            rows.append((scope[a], found, node[path].tolist() if found == "ok" else None))
        yield pd.DataFrame(rows, columns=["session_key", "verdict", "nodes"])


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in whole_groups(frames, "part"):
        rows = []
        for (start, segment), seg in g.groupby(["start", "segment"], sort=False):
            rows.append((start, int(segment), bool(seg["dangling"].any()), *judge(seg["role"].tolist())))
        yield pd.DataFrame(rows, columns=["session_key", "segment", "broken", "turns", "first", "last", "missed"])


def _whole(group: pd.DataFrame) -> pd.DataFrame:
    total = (0, 0, 0, False)
    for r in group.sort_values("segment", ascending=False).itertuples():
        total = compose(total, (int(r.turns), int(r.first), int(r.last), bool(r.missed)))
    return pd.DataFrame({"session_key": [group["session_key"].iloc[0]], "verdict": [verdict(bool(group["broken"].any()), total)]})


def _nodes(entries: DataFrame) -> DataFrame:
    useful = (F.col("record_type") == "message") & ~is_blank(F.col("message_content"))
    role = F.when(useful & (F.col("message_role") == "user"), USER).when(useful & (F.col("message_role") == "assistant"), ASSISTANT).otherwise(0)
    rows = linked_entries(entries, "line_no", role.cast("int").alias("role"), F.coalesce(F.col("record_type") == "leaf", F.lit(False)).alias("leaf"))
    return rows.withColumnRenamed("session_key", "scope").withColumnRenamed("entry_key", "node").where("scope is not null")


def _large(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of oversized sessions and their paths (session_key, node, pos from the leaf)."""
    edges = resolve_links(nodes)
    starts = nodes.groupBy(F.col("scope").alias("start")).agg(F.max_by("node", F.struct("leaf", "line_no", "node")).alias("node"))
    path = trace(spark, edges.select("node", "parent"), starts)
    ring = path.groupBy("start", "node").count().where("count > 1").select("start").distinct().withColumn("ring", F.lit(True))
    flags = edges.join(nodes.select("node", "role"), "node").select("node", "role", (F.col("parent").isNull() & F.col("link_id").isNotNull()).alias("dangling"))
    placed = path.join(flags, "node").withColumn("segment", F.floor(F.col("pos") / SEGMENT)).withColumn("part", F.concat_ws("\0", "start", "segment"))
    summaries = placed.repartition("part").sortWithinPartitions("part", F.col("pos").desc()).mapInPandas(
        _segments, "session_key string, segment long, broken boolean, turns long, first int, last int, missed boolean")
    verdicts = summaries.groupBy("session_key").applyInPandas(_whole, "session_key string, verdict string")
    return verdicts.join(ring.withColumnRenamed("start", "session_key"), "session_key", "left").select("session_key", F.when(F.col("ring"), "broken").otherwise(F.col("verdict")).alias("verdict")), path


def verdicts(spark: SparkSession, entries: DataFrame, sessions: DataFrame, max_group: int = MAX_GROUP) -> tuple[DataFrame, DataFrame]:
    """(verdicts of all live sessions, paths of the kept ones).

    verdicts: session_key and verdict (ok, broken, empty, missing_reply); a live session without live
    entries is empty. paths: session_key, entry_key and turn (0 for the first record). Entries without
    session, without key or of deleted sessions take no part; of equal line numbers the larger key
    counts as later; extra columns are ignored; empty tables give empty results.
    """
    nodes = _nodes(entries)
    small, large = split_by_size(nodes, "scope", max_group, entries.select(F.col("session_key").alias("scope")).where("scope is not null"))
    walked = small.select("scope", "node", "node_id", "link_id", "leaf", "role", "line_no").repartition("scope").sortWithinPartitions(
        "scope", F.col("line_no").desc_nulls_last(), F.col("node").desc()).drop("line_no").mapInPandas(_frames, OUT)
    kept = walked.where("verdict = 'ok'").select("session_key", F.posexplode("nodes").alias("turn", "entry_key")).select("session_key", "entry_key", F.col("turn").cast("long").alias("turn"))
    found = walked.select("session_key", "verdict")
    if large is not None:
        far, path = _large(spark, large)
        found = found.unionByName(far)
        length = path.groupBy("start").agg(F.max("pos").alias("top"))
        good = far.where("verdict = 'ok'").select(F.col("session_key").alias("start"))
        kept = kept.unionByName(path.join(good, "start", "left_semi").join(length, "start").select(F.col("start").alias("session_key"), F.col("node").alias("entry_key"), (F.col("top") - F.col("pos")).alias("turn")))
    live = live_rows(sessions.select("session_key", "ingested_at", "deleted_at"), "session_key").select("session_key")
    judged = live.join(found, "session_key", "left").withColumn("verdict", F.coalesce("verdict", F.lit("empty")))
    return judged, kept.join(live, "session_key", "left_semi")


def conversations(spark: SparkSession, entries: DataFrame, sessions: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Kept conversations, one row per record: session_key, turn, entry_key, speaker, content.

    The speaker is the message role, or the record type of rows that are no message.
    """
    _, kept = verdicts(spark, entries, sessions, max_group)
    body = live_rows(entries.select("entry_key", "row_id", "ingested_at", "deleted_at", F.coalesce("message_role", "record_type").alias("speaker"), F.coalesce("message_content", "summary").alias("content")), "entry_key", tie="row_id")
    return kept.join(body.select("entry_key", "speaker", "content"), "entry_key").select("session_key", "turn", "entry_key", "speaker", "content")
