"""Queries that run whole session files through import, graph and projection, with oracle SQL.

Two sources: the lines of raw_records are joined to files as they are, which shows framing and routing on
drifting and damaged input; live entries and sessions are written as canonical files, which shows graphs,
documents and turn contexts. Ids are normalised and missing times become a dash on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions.invocations import PAYLOAD_ENDINGS, PAYLOAD_NAMES, searchable_text
from ..functions.records import current_rows, live_rows
from ..functions.text import norm_id
from ..operators import maintenance, ranking, session_graph
from ..sources import jsonl
from .general import LIVE_ENTRIES_SQL, norm_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
POLICY = ck.ChunkPolicy(1024, 0)
_JS = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build

    return add


def _js_trim(col: str) -> str:
    return f"regexp_replace({col}, '^{_JS}+|{_JS}+$', '', 'g')"


def _files(lines: DataFrame) -> DataFrame:
    """(path, content) of (path, line, text): a file's lines are its unit of import."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("path").agg(F.encode(text, "UTF-8").alias("content"))


def raw_files(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/raw_records.parquet").where("file_id is not null and line_no is not null")
    w = W.partitionBy("file_id", "line_no").orderBy(F.col("read_at").desc_nulls_last(), F.md5("raw_json").desc_nulls_last())
    once = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return _files(once.select(F.format_string("%012d", "file_id").alias("path"), F.col("line_no").alias("line"), F.coalesce("raw_json", F.lit("")).alias("text")))


_RAW_SQL = """raw AS (SELECT printf('%012d', file_id) AS path, line_no, coalesce(raw_json, '') AS raw FROM raw_records WHERE file_id IS NOT NULL AND line_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY read_at DESC NULLS LAST, md5(raw_json) DESC NULLS LAST) = 1),
file AS (SELECT path, string_agg(raw, chr(10) ORDER BY line_no) AS content FROM raw GROUP BY 1),
part AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line, len(string_split(content, chr(10))) AS n FROM file),
lines AS (SELECT path, line, CASE WHEN line < n THEN regexp_replace(text, '\\r$', '') ELSE text END AS text FROM part WHERE line < n OR text <> '')"""


@query(f"WITH {_RAW_SQL} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines")
def framed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files cut into lines at line feeds only."""
    return jsonl.frame_lines(raw_files(spark, d))


@query(f"WITH {_RAW_SQL} SELECT path, octet_length(encode(content)) AS size, sha256(content) AS sha256 FROM file")
def source_identity(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.source_identity(raw_files(spark, d))


_FILLED = "json_type({j}, '$.{k}') = 'VARCHAR' AND json_extract_string({j}, '$.{k}') <> ''"
_NUMBER = "json_type({j}, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'INTEGER')"


def _tests(j: str, **kinds: list[str]) -> str:
    form = {"filled": _FILLED, "number": _NUMBER, "text": "json_type({j}, '$.{k}') = 'VARCHAR'", "flag": "json_type({j}, '$.{k}') = 'BOOLEAN'", "list": "json_type({j}, '$.{k}') = 'ARRAY'", "object": "json_type({j}, '$.{k}') = 'OBJECT'", "there": "json_exists({j}, '$.{k}')"}
    return " AND ".join(f"coalesce({form[kind].format(j=j, k=k)}, false)" for kind, names in kinds.items() for k in names)


_M = "json_extract(j, '$.message')"
_LINEAR_SQL = f"""NOT json_exists(j, '$.id') AND NOT json_exists(j, '$.parentId') AND {_tests('j', filled=['timestamp'])} AND CASE t
  WHEN 'message' THEN {_tests(_M, filled=['role'], number=['timestamp'])} AND CASE json_extract_string({_M}, '$.role') WHEN 'user' THEN {_tests(_M, there=['content'])}
    WHEN 'assistant' THEN {_tests(_M, list=['content'], filled=['api', 'provider', 'model', 'stopReason'], object=['usage'])}
    WHEN 'toolResult' THEN {_tests(_M, list=['content'], filled=['toolCallId', 'toolName'], flag=['isError'])}
    WHEN 'bashExecution' THEN {_tests(_M, text=['command', 'output'], flag=['cancelled', 'truncated'])} ELSE false END
  WHEN 'model_change' THEN {_tests('j', filled=['provider', 'modelId'])} WHEN 'thinking_level_change' THEN {_tests('j', filled=['thinkingLevel'])}
  WHEN 'compaction' THEN {_tests('j', text=['summary'], number=['firstKeptEntryIndex', 'tokensBefore'])} ELSE false END"""


ROUTES_SQL = f"""WITH {_RAW_SQL},
rec AS (SELECT path, line, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM lines WHERE {_js_trim('text')} <> ''),
bad AS (SELECT DISTINCT path FROM rec WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR coalesce(json_type(j, '$.type'), '') <> 'VARCHAR'),
ok AS (SELECT *, json_extract_string(j, '$.type') AS t FROM rec WHERE path NOT IN (SELECT path FROM bad)),
cut AS (SELECT *, t = 'session' AS head, row_number() OVER (PARTITION BY path ORDER BY line) AS k, sum((t = 'session')::INT) OVER (PARTITION BY path ORDER BY line) AS part,
  t = 'session' AND {_tests('j', filled=['id', 'timestamp'], text=['cwd'])} AS complete, {_tests('j', number=['version'])} AND json_extract_string(j, '$.version') IN ('2', '3') AS versioned,
  json_exists(j, '$.version') AS has_version, {_LINEAR_SQL} AS linear FROM ok),
parts AS (SELECT path, part, count(*) AS n, bool_or(head AND complete AND versioned) AS good FROM cut GROUP BY 1, 2),
whole AS (SELECT path, max(part) AS sessions, count(*) AS n, bool_or(k = 1 AND head) AS led, bool_or(k = 1 AND complete) AS complete, bool_or(k = 1 AND versioned) AS versioned, bool_or(k = 1 AND has_version) AS has_version,
  bool_and(k = 1 OR linear) AS linear FROM cut GROUP BY 1),
routed AS (SELECT w.*, CASE WHEN sessions > 1 THEN CASE WHEN led AND (SELECT bool_and(p.n >= 2 AND p.good) FROM parts p WHERE p.path = w.path) THEN 'reuse_history' END
  WHEN complete AND NOT has_version AND n > 1 AND linear THEN 'linear' WHEN complete AND versioned THEN 'canonical' END AS format FROM whole w)
SELECT f.path, r.format, CASE WHEN r.format IS NULL THEN 0 ELSE r.sessions END::BIGINT AS sessions, CASE WHEN r.format IS NULL THEN 0 ELSE r.n END AS records FROM file f LEFT JOIN routed r USING (path)"""


@query(ROUTES_SQL)
def import_routes(spark: SparkSession, d: str) -> DataFrame:
    """Each file's format, logical sessions and records; a rejected file has no format."""
    got = jsonl.import_sessions(raw_files(spark, d))
    return got.groupBy(F.col("session_path").alias("path")).agg(F.max("format").alias("format"), F.countDistinct("session_no").alias("sessions"), F.count("record_json").alias("records"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): live sessions with their live entries as canonical files, one header line and a line per entry."""
    c = F.col
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    heads = live_rows(read("sessions").select("session_key", "session_id", "started_ts", "cwd", "ingested_at", "deleted_at"), "session_key").select("session_key", F.to_json(F.struct(
        F.lit("session").alias("type"), F.lit(3).alias("version"), F.coalesce(F.when(c("session_id") != "", c("session_id")), c("session_key")).alias("id"),
        F.coalesce(F.when(c("started_ts") != "", c("started_ts")), F.lit("-")).alias("timestamp"), F.coalesce("cwd", F.lit("")).alias("cwd"))).alias("text"))
    e = live_rows(read("entries"), "entry_key", tie="row_id").where("session_key is not null")
    message = F.when(c("record_type") == "message", F.struct(c("message_role").alias("role"), c("message_content").alias("content"),
                     F.when(c("message_role") == "toolResult", "").alias("toolCallId"), F.when(c("message_role") == "toolResult", "").alias("toolName")))
    line = F.to_json(F.struct(
        c("record_type").alias("type"), norm_id(c("entry_id")).alias("id"), norm_id(c("parent_id")).alias("parentId"), F.coalesce(F.when(c("entry_ts") != "", c("entry_ts")), F.lit("-")).alias("timestamp"),
        message.alias("message"), F.when(c("record_type") == "custom_message", c("message_content")).alias("content"), c("summary").alias("summary"),
        F.when(c("record_type") == "compaction", norm_id(c("first_kept_entry_id"))).alias("firstKeptEntryId"),
        F.when(c("record_type") == "branch_summary", F.coalesce(norm_id(c("from_id")), F.lit("root"))).alias("fromId"), F.when(c("record_type") == "leaf", norm_id(c("target_id"))).alias("targetId")))
    body = e.join(heads.select("session_key"), "session_key", "left_semi").select(
        c("session_key").alias("path"), F.struct(F.coalesce(c("line_no").cast("long"), F.lit(1 << 40)).alias("n"), c("entry_key").alias("k")).alias("line"), line.alias("text"))
    first = heads.select(c("session_key").alias("path"), F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("k")).alias("line"), "text")
    return _files(first.unionByName(body))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.import_sessions(_canonical(spark, d))


_SESSIONS_SQL = f"""WITH RECURSIVE {LIVE_ENTRIES_SQL},
ls AS (SELECT session_key FROM (SELECT * FROM sessions WHERE session_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) = 1) WHERE deleted_at IS NULL),
rec AS (SELECT l.session_key, row_number() OVER (PARTITION BY l.session_key ORDER BY coalesce(l.line_no, 1::BIGINT << 40), l.entry_key) AS line, record_type, node_id AS id, {norm_sql('parent_id')} AS parent,
  {norm_sql('target_id')} AS target, coalesce({norm_sql('from_id')}, 'root') AS origin, {norm_sql('first_kept_entry_id')} AS kept, message_role AS role, message_content AS content, summary FROM live l JOIN ls USING (session_key)),
ent AS (SELECT * FROM rec WHERE record_type <> 'leaf'),
reach AS (SELECT session_key, id, parent AS up FROM ent WHERE parent IS NOT NULL UNION SELECT r.session_key, r.id, e.parent FROM reach r JOIN ent e ON e.session_key = r.session_key AND e.id = r.up WHERE e.parent IS NOT NULL),
leaf AS (SELECT session_key, target FROM (SELECT * FROM rec WHERE record_type = 'leaf' QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY line DESC) = 1)),
final AS (SELECT session_key, id FROM ent QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY line DESC) = 1),
tip AS (SELECT ls.session_key, CASE WHEN leaf.session_key IS NOT NULL THEN leaf.target ELSE final.id END AS id FROM ls LEFT JOIN leaf USING (session_key) LEFT JOIN final USING (session_key)),
invalid AS (
  SELECT session_key FROM ent WHERE coalesce(id, '') = ''
  UNION SELECT session_key FROM ent GROUP BY session_key, id HAVING count(*) > 1
  UNION SELECT e.session_key FROM ent e WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent p WHERE p.session_key = e.session_key AND p.id = e.parent)
  UNION SELECT session_key FROM reach WHERE id = up
  UNION SELECT t.session_key FROM tip t WHERE coalesce(t.id, '') <> '' AND NOT EXISTS (SELECT 1 FROM ent p WHERE p.session_key = t.session_key AND p.id = t.id)
  UNION SELECT c.session_key FROM ent c WHERE record_type = 'compaction' AND (coalesce(kept, '') = '' OR NOT EXISTS (SELECT 1 FROM reach r WHERE r.session_key = c.session_key AND r.id = c.id AND r.up = c.kept))
  UNION SELECT b.session_key FROM ent b WHERE record_type = 'branch_summary' AND origin <> 'root' AND NOT EXISTS (SELECT 1 FROM ent p WHERE p.session_key = b.session_key AND p.id = b.origin)),
good AS (SELECT * FROM ent WHERE session_key NOT IN (SELECT session_key FROM invalid)),
self AS (SELECT session_key, id, up FROM reach WHERE session_key NOT IN (SELECT session_key FROM invalid) UNION ALL SELECT session_key, id, id FROM good),
deep AS (SELECT session_key, id, count(*) AS depth FROM self GROUP BY 1, 2),
active AS (SELECT s.session_key, s.up AS id FROM self s JOIN tip t ON t.session_key = s.session_key AND t.id = s.id)
"""


@query(_SESSIONS_SQL + "SELECT session_key, session_key NOT IN (SELECT session_key FROM invalid) AS valid FROM ls")
def graph_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each session keeps the rules of the format: ids, parents, cycles, leaf, compactions, branch summaries."""
    rows = session_graph.project_graph(_records(spark, d))
    return rows.groupBy(F.col("session_path").alias("session_key")).agg(F.bool_and(F.col("error").isNull()).alias("valid"))


@query(_SESSIONS_SQL + """, shut AS (SELECT g.session_key, g.id, d.depth, k.depth AS from_depth FROM good g JOIN deep d ON d.session_key = g.session_key AND d.id = g.id JOIN deep k ON k.session_key = g.session_key AND k.id = g.kept WHERE g.record_type = 'compaction'),
nearest AS (SELECT s.* FROM shut s JOIN active a ON a.session_key = s.session_key AND a.id = s.id QUALIFY row_number() OVER (PARTITION BY s.session_key ORDER BY s.depth DESC) = 1),
ends AS (SELECT session_key, id FROM good g WHERE NOT EXISTS (SELECT 1 FROM good c WHERE c.session_key = g.session_key AND c.parent = g.id) UNION SELECT t.session_key, t.id FROM tip t JOIN good g ON g.session_key = t.session_key AND g.id = t.id),
over AS (SELECT s.session_key, s.up AS id, string_agg(s.id, ',' ORDER BY s.id) AS leaf_ids FROM self s JOIN ends e ON e.session_key = s.session_key AND e.id = s.id GROUP BY 1, 2),
closed AS (SELECT s.session_key, s.up AS id, string_agg(s.id, ',' ORDER BY s.id) AS compacted_by FROM self s JOIN shut c ON c.session_key = s.session_key AND c.id = s.id JOIN deep d ON d.session_key = s.session_key AND d.id = s.up WHERE s.up <> s.id AND d.depth < c.from_depth GROUP BY 1, 2)
SELECT g.session_key, g.id AS entry_id, g.parent AS parent_id, CAST(d.depth - 1 AS INTEGER) AS depth, a.id IS NOT NULL AS is_active,
  a.id IS NOT NULL AND (n.id IS NULL OR d.depth >= n.from_depth) AS is_visible, coalesce(o.leaf_ids, '') AS leaf_ids, coalesce(c.compacted_by, '') AS compacted_by,
  (SELECT count(*) FROM good x WHERE x.session_key = g.session_key AND x.parent = g.id) AS children
FROM good g JOIN deep d ON d.session_key = g.session_key AND d.id = g.id LEFT JOIN active a ON a.session_key = g.session_key AND a.id = g.id LEFT JOIN nearest n ON n.session_key = g.session_key
LEFT JOIN over o ON o.session_key = g.session_key AND o.id = g.id LEFT JOIN closed c ON c.session_key = g.session_key AND c.id = g.id""")
def graph_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each entry of a valid session in its graph: depth, branches, current path, context and compactions."""
    rows = session_graph.project_graph(_records(spark, d)).where("error is null and entry_id is not null")
    names = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return rows.select(F.col("session_path").alias("session_key"), "entry_id", "parent_id", "depth", "is_active", "is_visible", names("leaf_ids"), names("compacted_by"), F.size("child_ids").cast("long").alias("children"))


_SPOKEN = f"CASE WHEN record_type = 'message' AND role = '@r' THEN nullif({_js_trim('content')}, '') END"


@query(_SESSIONS_SQL + f""", spoken AS (SELECT *, CASE WHEN record_type = 'message' AND role IN ('user', 'assistant') OR record_type = 'custom_message' THEN content WHEN record_type IN ('compaction', 'branch_summary') THEN summary END AS said FROM good),
doc AS (SELECT session_key, id, CASE WHEN record_type = 'message' THEN role WHEN record_type = 'custom_message' THEN 'custom' ELSE 'summary' END AS role,
  CASE record_type WHEN 'compaction' THEN 'compaction_summary' WHEN 'branch_summary' THEN 'branch_summary' ELSE 'conversation' END AS evidence_kind, {_js_trim('said')} AS content FROM spoken WHERE coalesce({_js_trim('said')}, '') <> '')
SELECT d.session_key, d.id AS entry_id, d.role, d.evidence_kind, d.content, a.id IS NOT NULL AS is_active FROM doc d LEFT JOIN active a ON a.session_key = d.session_key AND a.id = d.id
WHERE len(regexp_extract_all(d.content, '\\S+')) <= 900""")
def entry_documents(spark: SparkSession, d: str) -> DataFrame:
    """The dense document of every entry that speaks, as one chunk; texts above 900 tokens are left to the chunk tests."""
    docs = session_graph.project_sessions(_records(spark, d), POLICY).where("error is null and document_kind <> 'turn_context' and chunk_count = 1")
    short = F.regexp_count("content", F.lit("[^\\t\\n\\f\\r ]+")) <= 900
    return docs.where(short).select(F.col("session_path").alias("session_key"), "entry_id", "role", "evidence_kind", "content", "is_active")


@query(_SESSIONS_SQL + f""", said AS (SELECT session_key, id, parent, {_SPOKEN.replace('@r', 'user')} AS asked, {_SPOKEN.replace('@r', 'assistant')} AS answered, record_type = 'message' AND coalesce(role, '') = 'user' AS asks FROM good),
walk AS (
  SELECT e.session_key, u.id AS entry_id, e.id AS at, u.asked, e.asks AS ended, CASE WHEN NOT e.asks AND e.answered IS NOT NULL THEN [u.id, e.id] ELSE [u.id] END AS who, CASE WHEN NOT e.asks AND e.answered IS NOT NULL THEN e.answered END AS answers
  FROM said u JOIN said e ON e.session_key = u.session_key AND e.parent = u.id WHERE u.asked IS NOT NULL
  UNION ALL SELECT e.session_key, w.entry_id, e.id, w.asked, e.asks, CASE WHEN NOT e.asks AND e.answered IS NOT NULL THEN list_append(w.who, e.id) ELSE w.who END,
    CASE WHEN NOT e.asks AND e.answered IS NOT NULL THEN coalesce(w.answers || chr(10) || chr(10), '') || e.answered ELSE w.answers END
  FROM walk w JOIN said e ON e.session_key = w.session_key AND e.parent = w.at WHERE NOT w.ended),
done AS (SELECT DISTINCT w.session_key, w.entry_id, w.who, w.asked, w.answers FROM walk w LEFT JOIN tip t ON t.session_key = w.session_key AND t.id = w.at
  WHERE w.answers IS NOT NULL AND (w.ended OR t.id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM said c WHERE c.session_key = w.session_key AND c.parent = w.at)))
SELECT session_key, entry_id, array_to_string(who, ',') AS contributing, 'User:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant:' || chr(10) || answers AS content FROM done WHERE len(regexp_extract_all('User:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant:' || chr(10) || answers, '\\S+')) <= 900""")
def turn_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Every user text with the answers that follow it on each path, as one document."""
    docs = session_graph.project_sessions(_records(spark, d), POLICY).where("error is null and document_kind = 'turn_context' and chunk_count = 1")
    one = W.partitionBy("session_path", "entry_id", "contributing_entry_ids")
    short = docs.withColumn("runs", F.count("*").over(one)).where((F.col("runs") == 1) & (F.regexp_count("content", F.lit("[^\\t\\n\\f\\r ]+")) <= 900))
    return short.select(F.col("session_path").alias("session_key"), "entry_id", F.array_join("contributing_entry_ids", ",").alias("contributing"), "content")


def _call_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    for f in frames:
        yield pd.DataFrame({"call_key": f["call_key"], "text": [searchable_text(n or "", json.loads(a)) for n, a in zip(f["tool_name"], f["call_arguments"])]})


_PLAIN = "lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g'))"
_OMITTED = f"({_PLAIN} <> 'querytext' AND ({_PLAIN} IN ({', '.join(repr(n) for n in sorted(PAYLOAD_NAMES))}) OR regexp_matches({_PLAIN}, '({'|'.join(PAYLOAD_ENDINGS)})$')))"


@query(f"""WITH c AS (SELECT call_key, coalesce(tool_name, '') AS tool_name, call_arguments::JSON AS a FROM (SELECT * FROM tool_calls WHERE call_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) = 1)
  WHERE json_valid(call_arguments) AND json_type(call_arguments) = 'OBJECT'),
m AS (SELECT call_key, k, json_extract(a, '/' || k) AS v FROM (SELECT *, unnest(json_keys(a)) AS k FROM c)),
plain AS (SELECT call_key FROM c WHERE call_key NOT IN (SELECT call_key FROM m WHERE json_type(v) IN ('OBJECT', 'ARRAY', 'DOUBLE') OR regexp_matches(k, '[~/]'))),
l AS (SELECT call_key, string_agg(k || '=' || CASE WHEN {_OMITTED} THEN '<omitted>' ELSE v::VARCHAR END, chr(10) ORDER BY NOT {_OMITTED}, k) AS t FROM m GROUP BY 1)
SELECT call_key, 'tool=' || to_json(tool_name)::VARCHAR || coalesce(chr(10) || l.t, '') AS text FROM c JOIN plain USING (call_key) LEFT JOIN l USING (call_key)""")
def invocation_text(spark: SparkSession, d: str) -> DataFrame:
    """The searchable text of every tool call whose arguments are one flat object."""
    calls = current_rows(spark.read.parquet(f"{d}/tool_calls.parquet"), "call_key").select("call_key", "tool_name", "call_arguments", F.try_parse_json("call_arguments").alias("j"))
    flat = calls.where(F.schema_of_variant("j").startswith("OBJECT") & ~F.schema_of_variant("j").rlike("OBJECT<.*(OBJECT<|ARRAY<|DOUBLE|DECIMAL)"))
    return flat.select("call_key", "tool_name", "call_arguments").mapInPandas(_call_text, "call_key long, text string")


_CANDIDATES_SQL = """cand AS (SELECT r.query_id, r.entry_key, max(r.fused_score) AS score FROM recall_results r WHERE r.fused_score IS NOT NULL AND r.query_id IS NOT NULL GROUP BY ALL),
full_ AS (SELECT c.query_id, c.entry_key, c.score, e.session_key, e.message_role AS role, e.message_content AS content, e.record_type = 'message' AND e.line_no % 2 = 0 AS act
  FROM cand c JOIN (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1) e USING (entry_key)),
kin AS (SELECT *, CASE WHEN content IS NOT NULL AND count(DISTINCT session_key) OVER (PARTITION BY query_id, content, role) > 1 THEN md5(content) || coalesce(role, '-') ELSE entry_key::VARCHAR END AS grp FROM full_),
best AS (SELECT query_id, grp, arg_min(entry_key, (-score, entry_key)) AS id, max(score) AS s, bool_or(act) AS a, count(*) - 1 AS copies FROM kin GROUP BY 1, 2)"""


@query(f"""WITH {_CANDIDATES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s + CASE WHEN a THEN 0.01 ELSE 0 END, 12) DESC, s DESC, id) AS place FROM best)
SELECT query_id, printf('%012d', id) AS id, round(s + CASE WHEN a THEN 0.01 ELSE 0 END, 9) AS ranking_score, copies, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 20""")
def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Recorded results ranked by the operator: exact copies of other sessions in one group, prior for active groups, 20 places."""
    e = current_rows(spark.read.parquet(f"{d}/entries.parquet").select("entry_key", "row_id", "session_key", "line_no", "record_type", "message_role", "message_content", "ingested_at"), "entry_key", tie="row_id")
    r = spark.read.parquet(f"{d}/recall_results.parquet").where("fused_score is not null and query_id is not null").groupBy("query_id", "entry_key").agg(F.max("fused_score").alias("fused_score"))
    found = r.join(e, "entry_key").select(
        "query_id", F.format_string("%012d", "entry_key").alias("id"), "fused_score", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("lexical_rank"), F.lit(None).cast("int").alias("identifier_rank"),
        F.col("session_key").alias("session_path"), F.col("session_key").alias("session_id"), F.col("message_role").alias("role"), F.col("message_content").alias("content"), F.sha2("message_content", 256).alias("checksum"),
        ((F.col("record_type") == "message") & (F.col("line_no") % 2 == 0)).alias("is_active"), *[F.lit(None).cast(t).alias(c) for c, t in _ABSENT.items()])
    ranked = ranking.rank(spark, found, 20)
    return ranked.select("query_id", "id", F.round("ranking_score", 9).alias("ranking_score"), F.size("occurrences").cast("long").alias("copies"), "place")


# Members of a dense document that recorded results do not have.
_ABSENT = {c: "string" for c in (*ranking.RUN_COLUMNS, *ranking.COPY_COLUMNS) if c not in ("session_path", "session_id", "role", "content", "checksum")} | {
    "next_sibling_id": "string", "previous_sibling_id": "string", "sibling_ids": "array<string>", "chunk_index": "int", "token_start": "int", "token_end": "int", "overlap_tokens": "int", "char_start": "int", "char_end": "int"}


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND 100000),
k AS (SELECT *, unnest(range(0, greatest((n - 21) // 80, 0) + 1)) AS k, greatest((n - 21) // 80, 0) AS last FROM d)
SELECT doc_id, k AS chunk, substring(text, greatest(k - 1, 0) * 80 + 1, least(n, (k + 1) * 80 + 100) - greatest(k - 1, 0) * 80) AS context, least(k, 1) + 1 + least(last - k, 1) AS pieces FROM k WHERE last > 0""")
def stitched_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of every text stitched to its two siblings; chunks of 100 characters overlap by 20."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text", F.length("text").alias("n")).where("n between 1 and 100000")
    last = F.greatest(F.floor((F.col("n") - 21) / 80), F.lit(0)).cast("int")
    k = t.withColumn("last", last).select("doc_id", "text", "n", "last", F.explode(F.sequence(F.lit(0), "last")).alias("k"))
    name = lambda x: F.concat_ws("-", "doc_id", x)
    fixed = {"schema_version": "1", "document_kind": "conversation", "evidence_kind": "conversation", "evidence_part": "content", "role": "user"}
    none = {c: None for c in (*ranking.RUN_COLUMNS, "tool_call_id", "tool_name", "tool_call_entry_id", "tool_result_entry_id", "tool_error") if c not in fixed and c != "text_run_id"}
    start, end = F.col("k") * 80, F.least("n", F.col("k") * 80 + 100)
    docs = k.select(
        name(F.col("k")).alias("id"), F.col("doc_id").cast("string").alias("text_run_id"), F.expr("substring(text, k * 80 + 1, least(n, k * 80 + 100) - k * 80)").alias("content"), start.alias("char_start"), end.alias("char_end"),
        start.alias("token_start"), end.alias("token_end"), F.when(F.col("k") > 0, 20).otherwise(0).alias("overlap_tokens"), F.col("k").alias("chunk_index"),
        F.when(F.col("k") > 0, name(F.col("k") - 1)).alias("previous_sibling_id"), F.when(F.col("k") < F.col("last"), name(F.col("k") + 1)).alias("next_sibling_id"),
        F.array_compact(F.array(F.when(F.col("k") > 0, name(F.col("k") - 1)), F.when(F.col("k") < F.col("last"), name(F.col("k") + 1)))).alias("sibling_ids"),
        *[F.lit(v).alias(c) for c, v in fixed.items()], *[F.lit(v).cast("string").alias(c) for c, v in none.items()])
    got = ranking.neighbour_context(docs.select(F.lit(0).alias("query_id"), "id"), docs).where("context is not null")
    part = F.split("id", "-")
    return got.select(part[0].cast("long").alias("doc_id"), part[1].cast("long").alias("chunk"), "context", F.size("context_ids").cast("long").alias("pieces"))


_STORED = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings WHERE vec_id % {m} = {r})"


@query(f"""WITH w AS (SELECT doc_id AS id, session_key AS s, sha256(text) AS c FROM documents WHERE text IS NOT NULL),
j AS (SELECT w.*, a.v AS v1, b.v AS v2 FROM w LEFT JOIN {_STORED.format(m=7, r=0)} a USING (id) LEFT JOIN {_STORED.format(m=5, r=0)} b USING (id)),
f AS (SELECT *, min(id) OVER t AS first, first_value(v1 IGNORE NULLS) OVER u AS t1, first_value(v2 IGNORE NULLS) OVER u AS t2 FROM j
  WINDOW t AS (PARTITION BY s, c), u AS (PARTITION BY s, c ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id AS doc_id, CASE WHEN v1 IS NOT NULL THEN 'current' WHEN t1 IS NOT NULL THEN 'copy' WHEN v2 IS NOT NULL THEN 'legacy' WHEN t2 IS NOT NULL OR id <> first THEN 'copy' ELSE 'embed' END AS source, round(coalesce(v1, t1, v2, t2), 6) AS first_component FROM f""")
def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's vector comes from, with every seventh vector current and every fifth legacy."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), F.col("session_key").alias("session"), F.sha2("text", 256).alias("checksum"))
    vec = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(docs.select("id", "checksum"), "id")
    got = maintenance.reuse_vectors(docs, vec.where("id % 7 = 0"), vec.where("id % 5 = 0"))
    return got.select(F.col("id").alias("doc_id"), "source", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_component"))
