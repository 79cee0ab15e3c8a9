"""Queries of attribution, validity, parity and index upkeep over the test tables, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import current_rows, live_rows
from ..operators import attribution, embedding, evaluation, integrity, lexical
from ..runtime import shared_folder
from ..sources import jsonl
from .retrieval import BM25_SQL, invocation_rows
from .sessions import ROUTES_SQL, raw_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(BM25_SQL)
def fts_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The phrase search over an index on disk that was built in two segments, the second replacing rows of the first."""
    calls, columns = invocation_rows(spark, d), ["tool_name", "call_arguments"]
    index = lexical.PhraseIndex(spark, f"{shared_folder(spark)}/sessionloom/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", columns)
    stale = calls.where("call_key % 3 <> 0").withColumn("call_arguments", F.when(F.col("call_key") % 3 == 1, F.concat("call_arguments", F.lit(' command: "rg'))).otherwise(F.col("call_arguments")))
    index.add(stale, "call_key")
    index.add(calls.where("call_key % 3 <> 2"), "call_key")
    return index.search('command: "rg', 50).select(F.col("doc").alias("call_key"), F.round("rank", 6).alias("score"))


_PLAIN_SQL = "(regexp_matches({p}, '^/([^/]+/)*[^/]*$') AND NOT regexp_matches({p}, '(^|/)\\.{{1,2}}(/|$)'))"
_OWN_SQL = "regexp_extract(rtrim(cwd, '/'), '([^/]+)$', 1)"


@query(f"""WITH cur AS (SELECT * FROM sessions WHERE session_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) = 1),
env AS (SELECT DISTINCT cwd, length(cwd) % 4 AS k FROM cur WHERE cwd <> ''),
res AS (SELECT cwd, CASE WHEN length(cwd) % 5 = 0 AND starts_with(cwd, '/work/') THEN 'git-origin:host/old/work' WHEN k = 0 AND {_OWN_SQL} <> '' THEN 'git-origin:host.org/team/' || {_OWN_SQL} WHEN k = 1 AND {_PLAIN_SQL.format(p="(cwd || '/.git')")} THEN 'git-common-directory:' || cwd || '/.git'
    WHEN k = 2 AND {_PLAIN_SQL.format(p='cwd')} THEN 'non-git-session-origin:' || cwd END AS project_identity FROM env)
SELECT c.session_key, r.project_identity, CASE WHEN r.project_identity = 'git-origin:host/old/work' THEN 'configured_project_lineage' WHEN starts_with(r.project_identity, 'git-origin:') THEN 'git_origin' WHEN starts_with(r.project_identity, 'git-common') THEN 'git_common_directory'
  WHEN r.project_identity IS NOT NULL THEN 'non_git_session_origin' END AS identity_source FROM cur c LEFT JOIN res r ON r.cwd = c.cwd""")
def project_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the project of their working directory: hosted remotes, shared git directories, plain directories, lineages."""
    s = current_rows(_t(spark, d, "sessions").select("session_key", "cwd", "ingested_at"), "session_key")
    k, own = F.length("origin") % 4, F.regexp_extract(F.rtrim("origin", F.lit("/")), "([^/]+)$", 1)
    origins = s.select(F.col("cwd").alias("origin")).where("origin <> ''").distinct()
    env = origins.select("origin", F.when(k == 0, F.concat(F.lit("git@Host.ORG:team/"), own, F.lit(".git"))).alias("remote"), F.when(k == 1, F.concat("origin", F.lit("/.git"))).alias("common_dir"), (k == 2).alias("is_directory"))
    roots = origins.where((F.length("origin") % 5 == 0) & F.col("origin").startswith("/work/")).select(F.col("origin").alias("root"), F.lit("git-origin:host/old/work").alias("project_identity"))
    exact = attribution.resolve_identities(origins.where(F.length("origin") % 5 == 0), env, roots).unionByName(attribution.resolve_identities(origins.where(F.length("origin") % 5 != 0), env))
    return attribution.attribute(s, exact).select("session_key", "project_identity", "identity_source")


@query(f"""SELECT session_key, ingested_at, coalesce({_PLAIN_SQL.format(p='cwd')}, false) AS own_origin, coalesce({_PLAIN_SQL.format(p='session_path')}, false) AS shared_directory,
  coalesce(len(string_split(trim(cwd, '/'), '/')) > 1 AND NOT list_has_any(string_split(trim(cwd, '/'), '/'), ['', '.', '..']) AND NOT regexp_matches(cwd, '(^/?/|/$|(?i)\\.git$)'), false) AS repository FROM
  (SELECT session_key, ingested_at, session_path, cwd FROM sessions)""".replace("NOT regexp_matches(cwd, '(^/?/|/$|(?i)\\.git$)')", "regexp_replace(cwd, '^/+', '') = trim(cwd, '/') AND NOT regexp_matches(cwd, '(?i)\\.git$')"))
def identity_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether identities made from paths are in normal form: own origin, shared git directory, repository."""
    made = lambda head, c: F.concat(F.lit(head), c)
    inner = F.regexp_replace("cwd", "^/+", "")
    return _t(spark, d, "sessions").select(
        "session_key", "ingested_at", attribution.is_project_identity(made("non-git-session-origin:", F.col("cwd"))).alias("own_origin"),
        attribution.is_repository_identity(made("git-common-directory:", F.col("session_path"))).alias("shared_directory"), attribution.is_repository_identity(made("git-origin:host:22/", inner)).alias("repository"))


_ROOTS_SQL = """r AS (SELECT DISTINCT regexp_replace(cwd, '/+$', '') AS root, 'git-origin:h/' || policy_id AS project_identity FROM sessions WHERE starts_with(cwd, '/') AND policy_id IS NOT NULL
  UNION SELECT DISTINCT regexp_extract(cwd, '^(/[^/]+/[^/]+)', 1), 'git-origin:h/1' FROM sessions WHERE starts_with(cwd, '/'))"""


@query(f"""WITH {_ROOTS_SQL} SELECT DISTINCT a.root, a.project_identity, b.root AS other_root, b.project_identity AS other_identity FROM r a JOIN r b
  ON a.project_identity <> b.project_identity AND (a.root = b.root OR starts_with(a.root, b.root || '/')) WHERE a.root <> '' AND b.root <> ''""")
def lineage_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Lineage roots of different projects of which one contains the other."""
    s = _t(spark, d, "sessions").where(F.col("cwd").startswith("/"))
    own = s.where("policy_id is not null").select(F.regexp_replace("cwd", "/+$", "").alias("root"), F.concat(F.lit("git-origin:h/"), F.col("policy_id").cast("string")).alias("project_identity"))
    above = s.select(F.regexp_extract("cwd", "^(/[^/]+/[^/]+)", 1).alias("root"), F.lit("git-origin:h/1").alias("project_identity"))
    return attribution.lineage_conflicts(own.union(above).distinct().where("root <> ''"))


@query("""SELECT row_id FROM entries WHERE NOT coalesce((record_type = 'message' AND message_role IN ('user', 'assistant', 'custom') OR record_type IN ('compaction', 'branch_summary') AND line_no % 2 = 0) AND message_tool_call_id IS NULL, false)""")
def document_validity(spark: SparkSession, d: str) -> DataFrame:
    """Entries taken as dense documents that are none of the legal combinations; every odd summary has the wrong kind."""
    c, none = F.col, F.lit(None)
    summary = c("record_type").isin("compaction", "branch_summary")
    kind = F.when(c("record_type") == "compaction", "compaction").when(c("record_type") == "branch_summary", "branch")
    docs = _t(spark, d, "entries").select(
        "row_id", F.when(summary, "summary").when(c("record_type") == "message", "conversation").otherwise(c("record_type")).alias("document_kind"),
        F.when(c("line_no") % 2 == 0, kind).when(summary, "other").alias("summary_kind"), F.when(summary, F.concat(kind, F.lit("_summary"))).otherwise("conversation").alias("evidence_kind"),
        F.when(summary, "summary").otherwise(c("message_role")).alias("role"), F.lit(True).alias("is_dense_searchable"), F.lit("content").alias("evidence_part"), c("message_tool_call_id").alias("tool_call_id"),
        *[none.cast("string").alias(x) for x in ("tool_name", "tool_call_entry_id", "tool_result_entry_id", "tool_error")])
    return integrity.invalid_documents(docs).select("row_id")


_FAULTY_SQL = "CASE vec_id % 9 WHEN 0 THEN list_slice(embedding, 1, 3) WHEN 1 THEN list_transform(embedding, lambda x: 0.0) WHEN 2 THEN NULL ELSE embedding END"


@query(f"""SELECT vec_id AS id, CASE vec_id % 9 WHEN 0 THEN 'width' WHEN 1 THEN 'zero' WHEN 2 THEN 'missing' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'repeated_vector' END AS problem FROM embeddings WHERE vec_id % 9 < 5
  UNION ALL SELECT vec_id + 10000000, 'no_document' FROM embeddings WHERE vec_id % 9 = 5""")
def write_problems(spark: SparkSession, d: str) -> DataFrame:
    """What forbids writing vectors: of nine kinds of rows six are faulty."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("id") % 9
    bad = e.withColumn("vector", F.when(k == 0, F.slice("v", 1, 3)).when(k == 1, F.transform("v", lambda x: F.lit(0.0))).when(k == 3, F.transform("v", lambda x, i: F.when(i == 1, F.lit(1e300)).otherwise(x))).when(k != 2, F.col("v"))).select("id", "vector")
    vectors = bad.unionByName(bad.where("id % 9 = 4")).unionByName(bad.where("id % 9 = 5").withColumn("id", F.col("id") + 10_000_000))
    docs = e.select("id", *[F.lit(v).alias(c) for c, v in {"document_kind": "conversation", "evidence_kind": "conversation", "role": "user", "evidence_part": "content", "is_dense_searchable": True}.items()],
                    *[F.lit(None).cast("string").alias(c) for c in ("summary_kind", "tool_call_id", "tool_name", "tool_call_entry_id", "tool_result_entry_id", "tool_error")])
    return integrity.write_problems(docs, vectors, _t(spark, d, "embeddings").select(F.size("embedding")).first()[0])


_SIDES = """docs AS (SELECT doc_id AS id, doc_id % 7 AS project_key FROM documents WHERE doc_id % 3 <> 0), vecs AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN 99 ELSE vec_id % 7 END AS project_key, CASE WHEN vec_id % 13 = 0 THEN 15 ELSE vec_id % 7 END AS project_bucket FROM embeddings)"""
_PARITY = """(SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM vecs) AS vectors, (SELECT count(*) FROM docs WHERE id NOT IN (SELECT id FROM vecs)) AS documents_without_vector, (SELECT count(*) FROM vecs WHERE id NOT IN (SELECT id FROM docs)) AS vectors_without_document,
  (SELECT count(*) FROM docs d JOIN vecs v USING (id) WHERE v.project_key <> d.project_key OR v.project_bucket <> d.project_key % 16) AS project_mismatches"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").where("doc_id % 3 <> 0").selectExpr("doc_id AS id", "doc_id % 7 AS project_key", "coalesce(session_key, '') AS session_path")
    vecs = _t(spark, d, "embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id % 11 = 0 THEN 99 ELSE vec_id % 7 END AS project_key", "CASE WHEN vec_id % 13 = 0 THEN 15 ELSE vec_id % 7 END AS project_bucket")
    return docs, vecs


@query(f"WITH {_SIDES} SELECT {_PARITY}")
def vector_parity(spark: SparkSession, d: str) -> DataFrame:
    return integrity.vector_parity(*_sides(spark, d))


@query(f"""WITH {_SIDES}, inv AS (SELECT DISTINCT call_key AS id FROM tool_calls WHERE call_key IS NOT NULL), idx AS (SELECT id + CASE WHEN id % 50 = 0 THEN 100000000 ELSE 0 END AS id FROM inv WHERE id % 20 <> 7),
one AS (SELECT {_PARITY}, (SELECT count(*) FROM inv) AS invocations, (SELECT count(*) FROM idx) AS indexed_invocations, (SELECT count(*) FROM idx WHERE id NOT IN (SELECT id FROM inv)) AS indexed_without_invocation,
  (SELECT count(*) FROM inv WHERE id NOT IN (SELECT id FROM idx)) AS invocations_without_index, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS inputs_without_document)
SELECT *, documents_without_vector + vectors_without_document + project_mismatches + indexed_without_invocation + invocations_without_index + inputs_without_document = 0 AS healthy FROM one""")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, inverted index and projection inputs against documents and invocations, in one row."""
    docs, vecs = _sides(spark, d)
    inv = _t(spark, d, "tool_calls").where("call_key is not null").select(F.col("call_key").alias("invocation_id")).distinct()
    idx = inv.where("invocation_id % 20 <> 7").select((F.col("invocation_id") + F.when(F.col("invocation_id") % 50 == 0, 100_000_000).otherwise(0)).alias("invocation_id"))
    inputs = _t(spark, d, "documents").selectExpr("coalesce(session_key, '') AS session_path", "doc_id AS projection_input_id", "doc_id AS document_id")
    return integrity.integrity_report(docs, vecs, inv, idx, inputs)


@query(f"SELECT format, count(*) AS files, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(records) AS BIGINT) AS records FROM ({ROUTES_SQL}) GROUP BY 1")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files, sessions and records of each import format."""
    return integrity.import_summary(jsonl.import_sessions(raw_files(spark, d)))


@query("""SELECT s.session_key, count(t.call_key) AS invocations FROM (SELECT DISTINCT session_key FROM sessions WHERE session_key IS NOT NULL) s
  LEFT JOIN (SELECT DISTINCT call_key, session_key FROM (SELECT * FROM tool_calls WHERE call_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) = 1)) t ON t.session_key = s.session_key GROUP BY 1""")
def session_invocations(spark: SparkSession, d: str) -> DataFrame:
    calls = current_rows(_t(spark, d, "tool_calls").select("call_key", "session_key", "ingested_at"), "call_key")
    return integrity.invocations_by_session(_t(spark, d, "sessions").where("session_key is not null"), calls, "session_key")


@query("""WITH r AS (SELECT DISTINCT query_id, entry_key AS id, rank_no, rank_no % 2 AS channel FROM recall_results WHERE query_id IS NOT NULL AND rank_no IS NOT NULL),
exp AS (SELECT DISTINCT query_id, id FROM r WHERE rank_no = 3), inn AS (SELECT * FROM r WHERE id % 4 <> 0), outt AS (SELECT * FROM r WHERE rank_no <= 6 AND id % 5 <> 0),
req AS (SELECT DISTINCT query_id, channel FROM r),
a AS (SELECT q.query_id, q.channel, count_if(e.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inn i WHERE i.query_id = q.query_id AND i.channel = q.channel AND i.id = e.id)) = 0 AS admitted,
  count_if(e.id IS NOT NULL AND EXISTS (SELECT 1 FROM outt i WHERE i.query_id = q.query_id AND i.channel = q.channel AND i.id = e.id)) = 0 AS displaced FROM req q LEFT JOIN exp e ON e.query_id = q.query_id GROUP BY 1, 2),
p AS (SELECT o.query_id, o.channel, count(*) AS n FROM outt o WHERE o.id % 3 = 0 GROUP BY 1, 2)
SELECT a.query_id, CAST(a.channel AS VARCHAR) AS channel, admitted, displaced, coalesce(p.n, 0) AS polluting, admitted AND displaced AND coalesce(p.n, 0) >= 1 AS passed FROM a LEFT JOIN p ON p.query_id = a.query_id AND p.channel = a.channel""")
def channel_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether a scope acts before a channel's limit, with ranks standing for channels and ids for scopes."""
    r = _t(spark, d, "recall_results").where("query_id is not null and rank_no is not null").select("query_id", F.col("entry_key").alias("id"), "rank_no", (F.col("rank_no") % 2).cast("string").alias("channel")).distinct()
    required = r.select("query_id", "channel").distinct().withColumn("least_polluting", F.lit(1))
    return evaluation.channel_proof(r.where("id % 4 <> 0"), r.where("rank_no <= 6 and id % 5 <> 0"), r.where("rank_no = 3").select("query_id", "id"), r.where("id % 3 = 0").select("query_id", "id"), required)


@query()
def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every current text embedded by the deterministic provider; tested against its width, length and repetition."""
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return embedding.embed_texts(docs, embedding.HashEmbedding(64), "doc_id", "text").select(F.col("id").alias("doc_id"), "vector")


@query("""SELECT session_key, count(*) AS entries FROM (SELECT * FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1) WHERE deleted_at IS NULL)
  WHERE session_key IN (SELECT session_key FROM sessions WHERE policy_id = 3) GROUP BY 1""")
def selected_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Live entries of a selection of sessions, by a semi join with the listed keys."""
    wanted = _t(spark, d, "sessions").where("policy_id = 3").select("session_key").distinct()
    live = live_rows(_t(spark, d, "entries").select("entry_key", "row_id", "session_key", "ingested_at", "deleted_at"), "entry_key", tie="row_id")
    return live.join(wanted, "session_key", "left_semi").groupBy("session_key").agg(F.count("*").alias("entries"))


_CASES_SQL = """cur AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1),
mem AS (SELECT DISTINCT r.query_id, r.rank_no, e.entry_key, e.session_key, e.entry_id, e.message_content AS content, e.line_no % 2 = 0 AS act FROM recall_results r JOIN cur e USING (entry_key) WHERE r.query_id IS NOT NULL AND r.rank_no IS NOT NULL AND e.entry_id IS NOT NULL AND e.session_key IS NOT NULL),
want AS (SELECT query_id, entry_key AS source_no, session_key, entry_id, left(content, 6) AS word FROM mem WHERE rank_no IN (2, 4)),
ask AS (SELECT query_id, count(DISTINCT source_no) AS asked FROM want GROUP BY 1),
hit AS (SELECT m.query_id, w.source_no, m.rank_no, m.act, m.content FROM mem m JOIN want w ON w.query_id = m.query_id AND w.session_key = m.session_key AND w.entry_id = m.entry_id AND (w.word IS NULL OR contains(m.content, w.word)))"""


@query(f"""WITH {_CASES_SQL}, c AS (SELECT query_id, k FROM (SELECT DISTINCT query_id FROM mem), (SELECT unnest([2, 5]) AS k)),
s AS (SELECT c.query_id, c.k, h.source_no, bool_or(h.act) AS act FROM c JOIN hit h ON h.query_id = c.query_id AND h.rank_no <= c.k GROUP BY 1, 2, 3),
d AS (SELECT query_id, k, count(*) AS preserved, count_if(act) AS act FROM s GROUP BY 1, 2)
SELECT c.query_id, CAST(c.k AS INTEGER) AS k, coalesce(d.preserved, 0) > 0 AS recalled, coalesce(d.preserved, 0) AS preserved, coalesce(d.preserved, 0) >= 2 AS preserved_enough, coalesce(d.act, 0) = coalesce(a.asked, 0) AS branches,
  EXISTS (SELECT 1 FROM hit h WHERE h.query_id = c.query_id AND h.rank_no <= c.k AND contains(lower(h.content), 'the')) AS context
FROM c LEFT JOIN d ON d.query_id = c.query_id AND d.k = c.k LEFT JOIN ask a ON a.query_id = c.query_id""")
def case_quality(spark: SparkSession, d: str) -> DataFrame:
    """What the first 2 and 5 recorded results of each query hold of the sources at ranks 2 and 4, asked for on the active branch."""
    e = current_rows(_t(spark, d, "entries").select("entry_key", "row_id", "session_key", "entry_id", "line_no", "message_content", "ingested_at"), "entry_key", tie="row_id").where("entry_id is not null and session_key is not null")
    r = _t(spark, d, "recall_results").where("query_id is not null and rank_no is not null").select("query_id", "rank_no", "entry_key").distinct()
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = r.join(e, "entry_key").select("query_id", "rank_no", "entry_key", F.col("session_key").alias("session_path"), F.array("entry_id").alias("entry_ids"), F.col("entry_id").alias("own"), F.col("message_content").alias("content"), (F.col("line_no") % 2 == 0).alias("is_active"))
    members = rows.drop("entry_key", "own").select("*", *none("evidence_kind", "summary_kind", "cwd", "relation"))
    expected = rows.where("rank_no in (2, 4)").select(
        "query_id", F.col("entry_key").alias("source_no"), F.col("session_path").alias("session_file"), F.col("own").alias("entry_id"), F.when(F.col("content").isNotNull(), F.array(F.left("content", F.lit(6)))).alias("required_text"),
        *none("want_evidence", "want_summary", "want_origin", "want_relation"), F.lit("active").alias("want_branch"), F.lit(None).cast("array<string>").alias("required_entries")).distinct()
    cases = rows.select("query_id", F.array(F.lit("The")).alias("required_context"), F.lit(2).alias("least_sources")).distinct()
    got = evaluation.case_quality(members, rows.select("query_id", "rank_no", F.col("content").alias("text")), expected, cases, [2, 5])
    return got.select("query_id", "k", "recalled", "preserved", "preserved_enough", "branches", "context")
