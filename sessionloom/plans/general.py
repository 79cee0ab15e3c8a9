"""Queries of the general data-engineering operators (hierarchies, orphans, schema drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import linked_entries
from ..operators import drift, forest, orphans
from ..runtime import materialize

WS_SQL = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def norm_sql(col: str) -> str:
    return f"lower(regexp_replace({col}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g'))"


LIVE_ENTRIES_SQL = f"""
cur AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) = 1),
live AS (SELECT *, {norm_sql('entry_id')} AS node_id,
  {norm_sql("CASE WHEN record_type = 'leaf' THEN target_id WHEN record_type = 'branch_summary' AND parent_id IS NULL THEN from_id ELSE parent_id END")} AS link_id
  FROM cur WHERE deleted_at IS NULL)"""


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entries = spark.read.parquet(f"{d}/entries.parquet")
    nodes = linked_entries(entries).select(F.col("session_key").alias("scope"), F.col("entry_key").alias("node"), "node_id", "link_id")
    return nodes, entries.where("session_key is not null").select(F.col("session_key").alias("scope"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, sizes = _nodes(spark, d)
    return forest.cycles(spark, nodes, sized_by=sizes).select(F.col("node").alias("entry_key"), F.col("cycle").alias("cycle_key"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes, sizes = _nodes(spark, d)
    full = forest.hierarchy(spark, nodes, sized_by=sizes)
    return full.select(
        F.col("node").alias("entry_key"), F.col("root").alias("root_key"), "depth", F.col("cycle").alias("cycle_key"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        F.array_join(F.col("descendants").cast("array<string>"), ",").alias("descendants"),
        F.size("descendants").cast("long").alias("n_descendants"),
    ).withColumn("n_descendants", F.when(F.col("cycle_key").isNull(), F.col("n_descendants")))


_EDGES_SQL = f"""{LIVE_ENTRIES_SQL},
e AS (SELECT a.entry_key, min(b.entry_key) AS parent FROM live a LEFT JOIN live b
  ON a.session_key = b.session_key AND a.link_id = b.node_id GROUP BY a.entry_key)"""

P5_FOUND_SQL = f"""WITH RECURSIVE {_EDGES_SQL},
ok AS (SELECT entry_key FROM e WHERE parent IS NULL UNION ALL SELECT e.entry_key FROM e JOIN ok ON e.parent = ok.entry_key),
bad AS (SELECT entry_key, parent FROM e WHERE entry_key NOT IN (SELECT entry_key FROM ok)),
reach AS (SELECT entry_key, parent AS hit FROM bad UNION SELECT r.entry_key, b.parent FROM reach r JOIN bad b ON b.entry_key = r.hit),
ring AS (SELECT entry_key FROM reach WHERE entry_key = hit)
SELECT r.entry_key, min(r.hit) AS cycle_key FROM reach r JOIN ring ON ring.entry_key = r.hit GROUP BY r.entry_key"""

P5_HIERARCHY_SQL = f"""WITH RECURSIVE {_EDGES_SQL},
down AS (SELECT entry_key, entry_key AS root_key, 0 AS depth, [entry_key] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.entry_key, d.root_key, d.depth + 1, list_append(d.path, e.entry_key) FROM e JOIN down d ON e.parent = d.entry_key),
anc AS (SELECT entry_key, unnest(path) AS a FROM down),
descs AS (SELECT a, string_agg(CAST(entry_key AS VARCHAR), ',' ORDER BY entry_key) AS ds, count(*) AS n FROM anc WHERE a <> entry_key GROUP BY a),
found AS (SELECT * FROM ({P5_FOUND_SQL.replace('WITH RECURSIVE ' + _EDGES_SQL + ',', 'WITH RECURSIVE')}))
SELECT e.entry_key, d.root_key, CAST(d.depth AS INTEGER) AS depth, f.cycle_key, array_to_string(d.path, '/') AS path,
  CASE WHEN d.entry_key IS NULL THEN NULL ELSE coalesce(s.ds, '') END AS descendants,
  CASE WHEN d.entry_key IS NULL THEN NULL ELSE coalesce(s.n, 0) END AS n_descendants
FROM e LEFT JOIN down d USING (entry_key) LEFT JOIN descs s ON s.a = e.entry_key LEFT JOIN found f ON f.entry_key = e.entry_key"""

def p5_nested(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy in linear size: depth-first numbers in place of paths and descendants."""
    nodes, sizes = _nodes(spark, d)
    return forest.nested(spark, nodes, sized_by=sizes).select(
        F.col("node").alias("entry_key"), F.col("parent").alias("parent_key"), F.col("root").alias("root_key"), "depth", "enter", "leave", F.col("cycle").alias("cycle_key"), "on_cycle")


P5_NESTED_SQL = f"""WITH RECURSIVE {_EDGES_SQL},
down AS (SELECT entry_key, entry_key AS root_key, 0 AS depth, [entry_key] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.entry_key, d.root_key, d.depth + 1, list_append(d.path, e.entry_key) FROM e JOIN down d ON e.parent = d.entry_key),
sizes AS (SELECT a, count(*) - 1 AS n FROM (SELECT unnest(path) AS a FROM down) GROUP BY a),
walk AS (SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY path) - 1 AS enter FROM down),
found AS (SELECT * FROM ({P5_FOUND_SQL.replace('WITH RECURSIVE ' + _EDGES_SQL + ',', 'WITH RECURSIVE')}))
SELECT e.entry_key, e.parent AS parent_key, w.root_key, CAST(w.depth AS INTEGER) AS depth, w.enter, w.enter + s.n AS leave, f.cycle_key,
  f.entry_key IS NOT NULL AND e.entry_key IN (SELECT b.hit FROM (SELECT entry_key, hit FROM (
    WITH RECURSIVE r AS (SELECT x.entry_key, x.parent AS hit FROM e x JOIN found y ON y.entry_key = x.entry_key UNION SELECT r.entry_key, x.parent FROM r JOIN e x ON x.entry_key = r.hit)
    SELECT entry_key, hit FROM r)) b WHERE b.entry_key = b.hit) AS on_cycle
FROM e LEFT JOIN walk w USING (entry_key) LEFT JOIN sizes s ON s.a = e.entry_key LEFT JOIN found f ON f.entry_key = e.entry_key"""

QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_nested": p5_nested}
ORACLE = {"p5_found": P5_FOUND_SQL, "p5_hierarchy": P5_HIERARCHY_SQL, "p5_nested": P5_NESTED_SQL}


def _changes(spark: SparkSession, d: str) -> DataFrame:
    prof = drift.profiles(spark.read.parquet(f"{d}/raw_records.parquet"), spark.read.parquet(f"{d}/session_files.parquet"))
    return drift.changes(materialize(spark, prof, "drift-profiles")[0])  # lines are parsed once


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("producer", F.col("file_seq").cast("int").alias("file_seq"), "record_type", "field_path")


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    table = drift.unify(spark.read.parquet(f"{d}/raw_records.parquet"), spark.read.parquet(f"{d}/session_files.parquet"), drift.renames(_changes(spark, d)))
    return table.withColumn("fields", F.to_json("fields"))


P6_FOUND_SQL = """WITH RECURSIVE rec AS (
  SELECT f.producer, f.file_seq, json_extract_string(j, '$.type') AS record_type, j FROM (SELECT DISTINCT file_id, producer, file_seq FROM session_files) f
  JOIN (SELECT file_id, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM raw_records) r ON r.file_id = f.file_id
  WHERE json_type(j) = 'OBJECT' AND f.producer IS NOT NULL AND f.file_seq IS NOT NULL),
member AS (
  SELECT producer, file_seq, record_type, k AS field_path, json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM rec)
  UNION ALL SELECT producer, file_seq, record_type, field_path || '.' || k, json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1')) FROM (SELECT *, unnest(json_keys(v)) AS k FROM member WHERE json_type(v) = 'OBJECT')),
typed AS (SELECT DISTINCT producer, file_seq, record_type, field_path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM member),
prof AS (SELECT producer, file_seq, record_type, field_path, coalesce(string_agg(t, '|' ORDER BY t), '') AS types FROM typed GROUP BY ALL),
ver AS (SELECT *, lag(file_seq) OVER (PARTITION BY producer, record_type ORDER BY file_seq) AS prev FROM (SELECT DISTINCT producer, record_type, file_seq FROM prof)),
old AS (SELECT v.producer, v.record_type, v.file_seq, p.field_path, p.types FROM ver v JOIN prof p ON p.producer = v.producer AND p.record_type IS NOT DISTINCT FROM v.record_type AND p.file_seq = v.prev),
new AS (SELECT v.producer, v.record_type, v.file_seq, p.field_path, p.types FROM ver v JOIN prof p ON p.producer = v.producer AND p.record_type IS NOT DISTINCT FROM v.record_type AND p.file_seq = v.file_seq WHERE v.prev IS NOT NULL)
SELECT coalesce(n.producer, o.producer) AS producer, coalesce(n.file_seq, o.file_seq) AS file_seq, coalesce(n.record_type, o.record_type) AS record_type, coalesce(n.field_path, o.field_path) AS field_path
FROM old o FULL JOIN new n ON o.producer = n.producer AND o.record_type IS NOT DISTINCT FROM n.record_type AND o.file_seq = n.file_seq AND o.field_path = n.field_path
WHERE o.field_path IS NULL OR n.field_path IS NULL OR (o.types <> n.types AND o.types <> '' AND n.types <> '')"""

QUERIES |= {"p6_found": p6_found, "p6_changes": p6_changes, "p6_unified": p6_unified}
ORACLE |= {"p6_found": P6_FOUND_SQL}


def _orphans(spark: SparkSession, d: str) -> orphans.OrphanState:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return orphans.track(spark, orphans.session_log_deliveries(read("entries"), read("sessions"), read("tool_calls")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).pending().select("table_name", "ref_field", "record_key")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per table, field and month of first delivery at the end of the last period."""
    history = _orphans(spark, d).history()
    last = history.agg(F.max("period").alias("period"))
    return history.join(F.broadcast(last), "period").select("table_name", "ref_field", "month", "orphans")


_FIRST = "min(ingested_at) OVER (PARTITION BY {k})::DATE AS first_day"
P3_FOUND_SQL = f"""WITH
e AS (SELECT *, {_FIRST.format(k='entry_key')}, row_number() OVER (PARTITION BY entry_key ORDER BY ingested_at DESC, row_id DESC) AS rn FROM entries),
le AS (SELECT * FROM e WHERE rn = 1 AND deleted_at IS NULL),
s AS (SELECT *, {_FIRST.format(k='session_key')}, row_number() OVER (PARTITION BY session_key ORDER BY ingested_at DESC) AS rn FROM sessions),
ls AS (SELECT * FROM s WHERE rn = 1 AND deleted_at IS NULL),
t AS (SELECT *, {_FIRST.format(k='call_key')}, row_number() OVER (PARTITION BY call_key ORDER BY ingested_at DESC) AS rn FROM tool_calls),
targets AS (
  SELECT kind, scope, id, min(first_day) AS since FROM (
    SELECT 'entry' AS kind, session_key AS scope, {norm_sql('entry_id')} AS id, first_day FROM le
    UNION ALL SELECT 'call', session_key, {norm_sql('tool_call_id')}, first_day FROM t WHERE rn = 1
    UNION ALL SELECT 'session', '', {norm_sql('session_path')}, first_day FROM ls) GROUP BY 1, 2, 3),
refs AS (
  {" UNION ALL ".join(f"SELECT 'entries' AS table_name, '{f}' AS ref_field, CAST(entry_key AS VARCHAR) AS record_key, '{k}' AS kind, session_key AS scope, {norm_sql(f)} AS id, first_day FROM le WHERE {f} IS NOT NULL" for f, k in [("parent_id", "entry"), ("from_id", "entry"), ("target_id", "entry"), ("first_kept_entry_id", "entry"), ("message_tool_call_id", "call")])}
  UNION ALL SELECT 'sessions', 'parent_session', session_key, 'session', '', {norm_sql('parent_session')}, first_day FROM ls WHERE parent_session IS NOT NULL),
orphans AS (SELECT r.* FROM refs r LEFT JOIN targets t ON r.kind = t.kind AND r.scope = t.scope AND r.id = t.id WHERE t.since IS NULL OR t.since > r.first_day)
"""

QUERIES |= {"p3_found": p3_found, "p3_counts": p3_counts}
ORACLE |= {
    "p3_found": P3_FOUND_SQL + "SELECT table_name, ref_field, record_key FROM orphans",
    "p3_counts": P3_FOUND_SQL + "SELECT table_name, ref_field, strftime(first_day, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL",
}
