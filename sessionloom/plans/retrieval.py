"""Queries of the retrieval, maintenance and evaluation operators over the test tables, with oracle SQL.

Mapping: embeddings stand for stored vectors (label = project), tool_calls for invocations, documents
and message contents for text runs, sessions for origins, raw_records for source lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity, text
from ..functions.records import live_rows
from ..operators import evaluation, fusion, integrity, lexical, maintenance, ranking, vectors
from ..sources import scan
from .general import norm_sql

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


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return _t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


_KNN = "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings {where} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 8"


@query(_KNN.format(where=""))
def knn_global(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine nearest neighbours of one query over all rows (k = 8)."""
    return vectors.nearest(_t(spark, d, "embeddings"), _vector(spark, d, 0), 8).withColumn("distance", F.round("distance", 6))


@query(_KNN.format(where="WHERE label % 16 = 3 AND label = 3"))
def knn_project(spark: SparkSession, d: str) -> DataFrame:
    """The same within one project: bucket and exact key are filtered below the limit."""
    return vectors.nearest(_t(spark, d, "embeddings"), _vector(spark, d, 0), 8, where=(vectors.bucket(F.col("label")) == 3) & (F.col("label") == 3)).withColumn("distance", F.round("distance", 6))


@query("""SELECT query_id, rank, id FROM (SELECT q.vec_id AS query_id, v.vec_id AS id,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), v.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 8""")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours of every row whose id is divisible by 100 against all rows, in blocks."""
    e = _t(spark, d, "embeddings")
    return vectors.nearest_batch(e.where("vec_id % 100 = 0"), e, 8).select("query_id", "rank", "id")


@query("""SELECT vec_id, list_transform(list_slice(embedding, 1, 16), lambda x: round(x / sqrt(list_sum(list_transform(list_slice(embedding, 1, 16), lambda y: y::DOUBLE * y))), 4)) AS stored
  FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)""")
def stored_prefix_norm(spark: SparkSession, d: str) -> DataFrame:
    """First 16 components as unit vectors."""
    return _t(spark, d, "embeddings").select("vec_id", F.transform(vectors.stored_vector(F.col("embedding"), 16), lambda x: F.round(x.cast("double"), 4)).alias("stored"))


@query("SELECT CAST(label % 16 AS INTEGER) AS bucket, count(*) AS n FROM embeddings GROUP BY 1")
def bucket_route(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").groupBy(vectors.bucket(F.col("label")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


_TOK_SQL = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_CALLS_SQL = "(SELECT call_key, tool_name, call_arguments, session_key FROM tool_calls QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) = 1)"


def invocation_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.records import current_rows

    return current_rows(_t(spark, d, "tool_calls").select("call_key", "tool_name", "call_arguments", "session_key", "tool_call_id", "entry_id", "ingested_at"), "call_key")


@query(f"""SELECT call_key AS doc, col, CAST(pos - 1 AS INTEGER) AS pos, token FROM (
  SELECT call_key, 0 AS col, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT call_key, {_TOK_SQL.format(c='tool_name')} AS t FROM {_CALLS_SQL})
  UNION ALL SELECT call_key, 1, unnest(t), generate_subscripts(t, 1) FROM (SELECT call_key, {_TOK_SQL.format(c='call_arguments')} AS t FROM {_CALLS_SQL}))""")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of all invocations."""
    return lexical.postings(invocation_rows(spark, d), "call_key", ["tool_name", "call_arguments"])


BM25_SQL = f"""WITH c AS {_CALLS_SQL},
a AS (SELECT call_key, ' ' || array_to_string({_TOK_SQL.format(c='tool_name')}, ' ') || ' ' AS s0, ' ' || array_to_string({_TOK_SQL.format(c='call_arguments')}, ' ') || ' ' AS s1,
  len({_TOK_SQL.format(c='tool_name')}) + len({_TOK_SQL.format(c='call_arguments')}) AS n FROM c),
h AS (SELECT *, len(regexp_extract_all(replace(s0, ' ', '  '), ' command  rg ')) + len(regexp_extract_all(replace(s1, ' ', '  '), ' command  rg ')) AS hits FROM a),
s AS (SELECT count(*)::DOUBLE AS nd, sum(n)::DOUBLE AS nt, count_if(hits > 0)::DOUBLE AS nh FROM h)
SELECT call_key, round(-greatest(ln((nd - nh + 0.5) / (nh + 0.5)), 1e-6) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n / (nt / nd))), 6) AS score FROM h, s WHERE hits > 0
ORDER BY -greatest(ln((nd - nh + 0.5) / (nh + 0.5)), 1e-6) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n / (nt / nd))), call_key LIMIT 50"""


@query(BM25_SQL)
def fts_phrase_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of one phrase over tool names and arguments, the 50 best."""
    return lexical.phrase_search(invocation_rows(spark, d), "call_key", ["tool_name", "call_arguments"], 'command: "rg', 50).select("call_key", F.round("rank", 6).alias("score"))


_CHANNELS_SQL = """dense AS (SELECT query_id, entry_key AS id, max(fused_score) AS score FROM recall_results WHERE fused_score IS NOT NULL GROUP BY ALL),
lex AS (SELECT query_id, entry_key AS id, min(rank_no)::DOUBLE AS score FROM recall_results GROUP BY ALL),
rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dense
  UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) FROM lex),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS fused_score FROM rk GROUP BY ALL),
placed AS (SELECT query_id, id, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, id) AS position FROM fused)"""


def _fused(spark: SparkSession, d: str, limit: int = 600) -> DataFrame:
    r = _t(spark, d, "recall_results")
    dense = r.where("fused_score is not null").groupBy("query_id", F.col("entry_key").alias("id")).agg(F.max("fused_score").alias("score"))
    lex = r.groupBy("query_id", F.col("entry_key").alias("id")).agg(F.min("rank_no").cast("double").alias("score"))
    return fusion.rrf({"dense": (dense, "score", False), "lexical": (lex, "score", True)}, limit)


@query(f"WITH {_CHANNELS_SQL} SELECT query_id, id, round(fused_score, 9) AS fused_score, CAST(position AS INTEGER) AS position FROM placed")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of two channels of recorded results."""
    return _fused(spark, d).withColumn("fused_score", F.round("fused_score", 9))


@query(f"""WITH {_CHANNELS_SQL}, inv AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS position FROM (SELECT DISTINCT query_id, entry_key + 1000000 AS id FROM recall_results WHERE query_id % 3 <> 0)),
both_ AS (SELECT query_id, id, position, 'conversation' AS kind FROM placed UNION ALL SELECT query_id, id, position, 'invocation' FROM inv),
n AS (SELECT *, count_if(kind = 'conversation') OVER q AS nc, count_if(kind = 'invocation') OVER q AS ni FROM both_ WINDOW q AS (PARTITION BY query_id)),
k AS (SELECT *, CASE WHEN nc = 0 THEN 0 WHEN ni = 0 THEN least(nc, 5) ELSE least(nc, 4) END AS tc FROM n),
k2 AS (SELECT *, least(ni, 5 - tc) AS ti FROM k),
k3 AS (SELECT * FROM k2 WHERE position <= CASE WHEN kind = 'conversation' THEN tc ELSE ti END)
SELECT query_id, kind, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position > least(tc, ti), CASE WHEN position <= least(tc, ti) THEN position END, kind, position) AS INTEGER) AS place FROM k3""")
def mixed_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Conversations and invocations mixed into five places per query."""
    inv = _t(spark, d, "recall_results").where("query_id % 3 <> 0").select("query_id", (F.col("entry_key") + 1000000).alias("id")).distinct()
    inv = inv.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("id")))
    return fusion.mix(_fused(spark, d), inv, 5)


@query("SELECT result_id, query_id FROM recall_results WHERE rank_no <= 2 OR fused_score IS NULL OR 1 - fused_score * 20 <= 0.5")
def eligibility_filter(spark: SparkSession, d: str) -> DataFrame:
    lexical_rank = F.when(F.col("rank_no") <= 2, F.col("rank_no"))
    return _t(spark, d, "recall_results").where(ranking.eligible(1 - F.col("fused_score") * 20, lexical_rank, F.lit(None).cast("int"))).select("result_id", "query_id")


@query("""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s + CASE WHEN a THEN 0.01 ELSE 0 END, 12) DESC, s DESC, entry_key) AS INTEGER) AS place, entry_key AS id,
  round(s + CASE WHEN a THEN 0.01 ELSE 0 END, 9) AS ranking_score
  FROM (SELECT query_id, entry_key, max(fused_score) AS s, bool_or(duplicate_occurrences IS NOT NULL) AS a FROM recall_results WHERE fused_score IS NOT NULL GROUP BY ALL)""")
def active_prior_rank(spark: SparkSession, d: str) -> DataFrame:
    """Order by fused score plus the prior of active groups."""
    g = _t(spark, d, "recall_results").where("fused_score is not null").groupBy("query_id", F.col("entry_key").alias("id")).agg(F.max("fused_score").alias("s"), F.bool_or(F.col("duplicate_occurrences").isNotNull()).alias("a"))
    scored = g.withColumn("score", F.col("s") + F.when(F.col("a"), ranking.ACTIVE_PRIOR).otherwise(0.0))
    w = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("s").desc(), "id")
    return scored.select("query_id", F.row_number().over(w).alias("place"), "id", F.round("score", 9).alias("ranking_score"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), text) AS copy_class, count(*) OVER (PARTITION BY sha256(text), text) AS copies FROM documents WHERE text IS NOT NULL""")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each text's class of exact copies, as class id and size; pre-aggregated on the checksum."""
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("c"))
    classes = docs.groupBy("c").agg(F.min("doc_id").alias("copy_class"), F.count("*").alias("copies"))
    return docs.join(classes, "c").select("doc_id", "copy_class", "copies")


@query("SELECT session_key, text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def distinct_inputs(spark: SparkSession, d: str) -> DataFrame:
    """One embedding input per distinct text of a session: the first document."""
    return _t(spark, d, "documents").where("text is not null").groupBy("session_key", "text").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT row_id, CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(substring(flat, 1, 79)) || '…' END AS excerpt FROM (
  SELECT row_id, trim(regexp_replace(message_content, '[\\s\\x{b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')) AS flat FROM entries WHERE message_content IS NOT NULL)""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "entries").where("message_content is not null").select("row_id", scan.short_excerpt(F.col("message_content"), 80).alias("excerpt"))


_SCAN_SQL = """l AS (SELECT printf('%012d', file_id) AS path, line_no AS line, raw_json AS text, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM (
  SELECT * FROM raw_records WHERE raw_json IS NOT NULL AND file_id IS NOT NULL AND line_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY read_at DESC, md5(raw_json) DESC) = 1)),
p AS (SELECT *, contains(lower(text), '{word}') AS hit FROM l WHERE contains(lower(text), '{word}') OR contains(text, '"session"')),
o AS (SELECT *, coalesce(last_value(CASE WHEN json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'session' THEN CASE WHEN json_type(j, '$.cwd') = 'VARCHAR' THEN json_extract_string(j, '$.cwd') ELSE '' END END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS origin FROM p),
bad AS (SELECT path, min(line) AS line FROM o WHERE j IS NULL GROUP BY 1)"""


def _source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Current lines of raw_records: the latest delivery is found by narrow keys, so no text is shuffled for it."""
    raw = _t(spark, d, "raw_records").where("raw_json is not null and file_id is not null and line_no is not null").withColumn("mark", F.struct("read_at", F.md5("raw_json")))
    last = raw.groupBy("file_id", "line_no").agg(F.max("mark").alias("mark"))
    kept = raw.join(last, ["file_id", "line_no", "mark"], "left_semi").select(F.format_string("%012d", "file_id").alias("path"), F.col("line_no").alias("line"), F.col("raw_json").alias("text"))
    return kept.dropDuplicates(["path", "line"])


@query(f"""WITH {_SCAN_SQL.format(word='estalegen')} SELECT path, line, CASE WHEN json_type(j, '$.id') = 'VARCHAR' THEN json_extract_string(j, '$.id') END AS entry_id, origin,
  CASE WHEN length(text) <= 2000 THEN text ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END) || substring(text, s + 1, 1998) || CASE WHEN s + 1998 < length(text) THEN '…' ELSE '' END END AS excerpt
  FROM (SELECT *, greatest(0, strpos(lower(text), 'estalegen') - 1 - 999) AS s FROM o WHERE hit AND path NOT IN (SELECT path FROM bad)) ORDER BY path, line LIMIT 200""")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Literal search over raw lines with the session origin in force at each match and an excerpt."""
    return scan.source_search(_source_lines(spark, d), "ESTALEGEN", 200)


@query(f"WITH {_SCAN_SQL.format(word='estalegen')} SELECT path, line FROM bad")
def source_failures(spark: SparkSession, d: str) -> DataFrame:
    """Files that the search reports as unreadable."""
    return scan.source_failures(_source_lines(spark, d), "ESTALEGEN").select("path", "line")


@query(f"""WITH s AS (SELECT DISTINCT rtrim(cwd, '/') AS origin FROM sessions WHERE cwd IS NOT NULL),
l AS (SELECT DISTINCT regexp_extract(rtrim(cwd, '/'), '^(/[^/]+/[^/]+/[^/]+)', 1) AS root FROM sessions WHERE cwd IS NOT NULL UNION SELECT '/work/checkout')
SELECT s.origin, arg_max(l.root, length(l.root)) AS root FROM s LEFT JOIN l ON l.root <> '' AND (s.origin = l.root OR starts_with(s.origin, l.root || '/')) GROUP BY 1""")
def lineage_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Each session origin with the longest lineage root that contains it."""
    origins = _t(spark, d, "sessions").where("cwd is not null").select(F.regexp_replace("cwd", "/+$", "").alias("origin")).distinct()
    roots = origins.select(F.regexp_extract("origin", "^(/[^/]+/[^/]+/[^/]+)", 1).alias("root")).where("root <> ''").union(spark.sql("SELECT '/work/checkout' AS root")).distinct()
    return identity.apply_lineage(origins, roots.withColumn("project_identity", F.col("root"))).select("origin", "root")


@query("""SELECT session_key, ingested_at, CASE WHEN len(string_split(p, '/')) > 1 AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) THEN p END AS repository
  FROM (SELECT session_key, ingested_at, regexp_replace(regexp_replace(session_path, '^/+|/+$', '', 'g'), '(?i)\\.git$', '') AS p FROM sessions WHERE session_path IS NOT NULL)""")
def repo_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sessions").where("session_path is not null").select("session_key", "ingested_at", identity.repository_path_column(F.col("session_path")).alias("repository"))


@query("""SELECT doc_id, CASE WHEN d.project_identity IS NULL OR s.project_identity IS NULL OR d.project_identity <> s.project_identity THEN 'unrestricted_global_evidence'
  WHEN s.parent_session IS NOT NULL THEN 'configured_project_lineage' WHEN starts_with(d.project_identity, 'non-git-session-origin:') THEN 'same_session_origin' ELSE 'same_repository' END AS relation
  FROM documents d LEFT JOIN (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) = 1) s USING (session_key)""")
def evidence_relation(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.records import current_rows

    s = current_rows(_t(spark, d, "sessions"), "session_key").select("session_key", F.col("project_identity").alias("other"), F.when(F.col("parent_session").isNotNull(), "configured_project_lineage").otherwise("git_origin").alias("src"))
    return _t(spark, d, "documents").join(s, "session_key", "left").select("doc_id", identity.evidence_relation(F.col("project_identity"), F.col("other"), F.lit("git"), F.col("src")).alias("relation"))


_STATE_SQL = "(SELECT session_path AS path, count(*) AS size, max(epoch_ms(ingested_at)) AS mtime_ms, min(session_id) AS sha256 FROM sessions WHERE ingested_at {op} TIMESTAMP '2026-01-01' GROUP BY 1)"


@query(f"""SELECT coalesce(f.path, s.path) AS path, CASE WHEN coalesce(f.path, s.path) LIKE '%oversized%' THEN 'ignored' WHEN s.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'missing'
  WHEN f.size = s.size AND f.mtime_ms = s.mtime_ms THEN 'unchanged' WHEN f.size = s.size AND f.sha256 = s.sha256 THEN 'touched' ELSE 'changed' END AS status
  FROM (SELECT session_path AS path, count(*) AS size, max(epoch_ms(ingested_at)) AS mtime_ms, min(session_id) AS sha256 FROM sessions WHERE policy_id <> 1 GROUP BY 1) f
  FULL JOIN {_STATE_SQL.format(op='<')} s ON f.path = s.path""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, changed, touched, unchanged, missing and ignored files between a listing and the stored state."""
    s = _t(spark, d, "sessions")
    state = lambda df: df.groupBy(F.col("session_path").alias("path")).agg(F.count("*").alias("size"), F.max(F.unix_millis(F.col("ingested_at").cast("timestamp"))).alias("mtime_ms"), F.min("session_id").alias("sha256"))
    ignored = s.where("session_path like '%oversized%'").select(F.col("session_path").alias("path"))
    return maintenance.snapshot_diff(state(s.where("policy_id <> 1")), state(s.where("ingested_at < '2026-01-01'")), ignored)


@query("SELECT DISTINCT e.session_key FROM entries e WHERE NOT EXISTS (SELECT 1 FROM tool_calls t WHERE t.session_key = e.session_key)")
def missing_sessions(spark: SparkSession, d: str) -> DataFrame:
    return integrity.missing(_t(spark, d, "entries"), _t(spark, d, "tool_calls"), "session_key")


@query("""SELECT 'sessions-documents' AS check_name, (SELECT count(*) FROM sessions) AS left_rows, (SELECT count(*) FROM documents WHERE session_key IS NOT NULL) AS right_rows,
  (SELECT count(DISTINCT session_key) FROM sessions WHERE session_key NOT IN (SELECT session_key FROM documents WHERE session_key IS NOT NULL)) AS left_only,
  (SELECT count(DISTINCT session_key) FROM documents WHERE session_key IS NOT NULL AND session_key NOT IN (SELECT session_key FROM sessions)) AS right_only""")
def parity_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.parity("sessions-documents", _t(spark, d, "sessions"), _t(spark, d, "documents").where("session_key is not null"), "session_key")


@query("SELECT DISTINCT project_identity FROM documents WHERE project_identity IS NOT NULL AND project_identity NOT IN (SELECT project_identity FROM sessions WHERE project_identity IS NOT NULL AND deleted_at IS NULL)")
def orphan_projects(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "sessions").where("deleted_at is null")
    return integrity.missing(_t(spark, d, "documents").where("project_identity is not null"), known.where("project_identity is not null"), "project_identity")


_EXPECTED_SQL = "(SELECT DISTINCT query_id, entry_key AS id FROM recall_results WHERE duplicate_occurrences IS NOT NULL)"


@query(f"""SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr, round(avg((coalesce(r, 99) <= 3)::INT), 9) AS recall FROM (
  SELECT q.query_id, min(r.rank_no) AS r FROM (SELECT DISTINCT query_id FROM {_EXPECTED_SQL}) q LEFT JOIN {_EXPECTED_SQL} e USING (query_id)
  LEFT JOIN recall_results r ON r.query_id = e.query_id AND r.entry_key = e.id AND r.fused_score IS NOT NULL GROUP BY 1)""")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "recall_results").withColumnRenamed("entry_key", "id")
    expected = r.where("duplicate_occurrences is not null").select("query_id", "id")
    q = evaluation.quality(r.where("fused_score is not null"), expected, 3)
    return q.select("n_queries", F.round("mrr", 9).alias("mrr"), F.round("recall", 9).alias("recall"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def percentile_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank_percentile(_t(spark, d, "events"), "value", 0.95, ["event_type"])


@query("""SELECT query_id, CAST(sum((n > 1)::INT) AS BIGINT) AS slots FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id, entry_key ORDER BY rank_no, result_id) AS n FROM recall_results) GROUP BY 1""")
def dup_slots(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.duplicate_slots(_t(spark, d, "recall_results"), ["entry_key"])


@query("""SELECT entry_key, session_key, line_no, lag(entry_key) OVER w AS parent_key, lead(entry_key) OVER w AS next_key,
  sha256(session_key || chr(0) || line_no) AS entry_hash FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1) WHERE deleted_at IS NULL
  WINDOW w AS (PARTITION BY session_key ORDER BY line_no, entry_key)""")
def parent_lag(spark: SparkSession, d: str) -> DataFrame:
    """Linear files: each entry's predecessor as parent, and ids hashed over NUL-joined parts."""
    live = live_rows(_t(spark, d, "entries").select("entry_key", "row_id", "session_key", "line_no", "ingested_at", "deleted_at"), "entry_key", tie="row_id")
    w = W.partitionBy("session_key").orderBy("line_no", "entry_key")
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return live.select("entry_key", "session_key", "line_no", F.lag("entry_key").over(w).alias("parent_key"), F.lead("entry_key").over(w).alias("next_key"), F.sha2(F.concat("session_key", nul, F.col("line_no").cast("string")), 256).alias("entry_hash"))


@query("""SELECT session_key, entry_key, CAST(sum((message_role = 'user')::INT) OVER (PARTITION BY session_key ORDER BY line_no, entry_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
  FROM (SELECT * FROM entries WHERE message_role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1)""")
def session_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments that start at every user message, as a running sum."""
    from ..functions.records import current_rows

    rows = current_rows(_t(spark, d, "entries").where("message_role is not null").select("session_key", "entry_key", "row_id", "line_no", "message_role", "ingested_at"), "entry_key", tie="row_id")
    w = W.partitionBy("session_key").orderBy("line_no", "entry_key").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("session_key", "entry_key", F.sum((F.col("message_role") == "user").cast("int")).over(w).alias("segment"))


@query(f"""SELECT session_key, {norm_sql('target_id')} AS target FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1)
  WHERE deleted_at IS NULL AND record_type = 'leaf' QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY line_no DESC NULLS LAST, entry_key DESC) = 1""")
def latest_leaf(spark: SparkSession, d: str) -> DataFrame:
    """The target of the last leaf record of each session, also where it is null."""
    e = _t(spark, d, "entries").select("entry_key", "row_id", "session_key", "line_no", "record_type", text.norm_id(F.col("target_id")).alias("t"), "ingested_at", "deleted_at")
    return live_rows(e, "entry_key", tie="row_id").where("record_type = 'leaf'").groupBy("session_key").agg(F.max_by(F.struct("t"), F.struct("line_no", "entry_key")).alias("last")).select("session_key", F.col("last.t").alias("target"))


@query("""SELECT call_key, regexp_matches(k, '(body|content|filebody|filecontent|newtext|oldtext|prompt|replacement|replacementtext|script)$') OR k IN ('code','data','image','images','instructions','output','prompts','scripts','stderr','stdout','task','text') AS omitted, k AS name
  FROM (SELECT call_key, lower(regexp_replace(unnest(json_keys(call_arguments)), '[^A-Za-z0-9]', '', 'g')) AS k FROM (SELECT * FROM tool_calls WHERE json_valid(call_arguments) QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) = 1))""")
def omit_keys(spark: SparkSession, d: str) -> DataFrame:
    """Top-level argument names whose payload the invocation projection leaves out."""
    from ..functions.invocations import PAYLOAD_ENDINGS, PAYLOAD_NAMES
    from ..functions.records import current_rows

    calls = current_rows(_t(spark, d, "tool_calls").where(F.try_parse_json("call_arguments").isNotNull()), "call_key")
    keys = calls.select("call_key", F.explode(F.json_object_keys("call_arguments")).alias("key"))
    names = keys.select("call_key", F.lower(F.regexp_replace("key", "[^A-Za-z0-9]", "")).alias("name"))
    return names.select("call_key", (F.col("name").rlike(f"({'|'.join(PAYLOAD_ENDINGS)})$") | F.col("name").isin(sorted(PAYLOAD_NAMES))).alias("omitted"), "name")


@query("""SELECT c.call_key, e.message_is_error AS is_error FROM (SELECT * FROM tool_calls WHERE call_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) = 1) c
  LEFT JOIN (SELECT *, """ + norm_sql("message_tool_call_id") + """ AS call FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1) WHERE deleted_at IS NULL AND message_role = 'toolResult'
    QUALIFY row_number() OVER (PARTITION BY session_key, """ + norm_sql("message_tool_call_id") + """ ORDER BY line_no DESC NULLS LAST, entry_key DESC) = 1) e
  ON e.session_key = c.session_key AND e.call = """ + norm_sql("c.tool_call_id"))
def call_results(spark: SparkSession, d: str) -> DataFrame:
    """Each tool call with the error flag of its last result, null where the last one has none."""
    e = live_rows(_t(spark, d, "entries").select("entry_key", "row_id", "session_key", "line_no", "message_role", "message_is_error", text.norm_id(F.col("message_tool_call_id")).alias("call"), "ingested_at", "deleted_at"), "entry_key", tie="row_id")
    last = e.where("message_role = 'toolResult'").groupBy("session_key", "call").agg(F.max_by(F.struct("message_is_error"), F.struct("line_no", "entry_key")).alias("last")).select("session_key", "call", F.col("last.message_is_error").alias("is_error"))
    c = invocation_rows(spark, d).withColumn("call", text.norm_id(F.col("tool_call_id")))
    return c.join(last, ["session_key", "call"], "left").select("call_key", "is_error")
