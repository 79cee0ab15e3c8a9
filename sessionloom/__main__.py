"""Command line: index session files into a new generation, search the active one, scan sources, export, check, keep the ignore list."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.chunking import SCHEMA_VERSION
from .operators import attribution, embedding, integrity, lexical, maintenance, search, session_graph
from .runtime import build_session, clean, ship_package
from .sources import jsonl, scan

NO_PROJECT = "project_identity string, identity_source string"


def _manifest(settings: config.Settings) -> dict:
    return {"schema_version": SCHEMA_VERSION} | settings.manifest()


def _attributed(rows: DataFrame, environment: DataFrame | None, lineage: DataFrame | None) -> DataFrame:
    if environment is None and lineage is None:
        return rows.select("*", *[F.lit(None).cast("string").alias(c.split()[0]) for c in NO_PROJECT.split(", ")])
    known = environment if environment is not None else rows.sparkSession.createDataFrame([], "origin string, remote string, common_dir string, is_directory boolean")
    return attribution.attribute(rows, attribution.resolve_identities(rows.select(F.col("cwd").alias("origin")), known, lineage))


def index(spark: SparkSession, root: str, store: str, settings: config.Settings, select: list[str] | None = None, environment: DataFrame | None = None, lineage: DataFrame | None = None) -> dict:
    """Import everything below root that is not ignored into a new generation; unchanged files keep their rows and vectors.

    ``select`` bounds the run to these paths: other stored files stay as they are, present or not.
    ``environment`` and ``lineage`` name the projects of working directories (see attribution). Nothing becomes
    active unless documents and vectors match one to one and no id has two owners.
    """
    g, ignore = maintenance.Generations(spark, store), maintenance.IgnoreList(spark, store)
    with maintenance.exclusive_lock(spark, store, settings.lock_wait_seconds):
        files = jsonl.list_sessions(spark, root, with_content=True).withColumn("plain", F.regexp_replace("path", "^file:/*", "/"))
        now = files.select(F.col("plain").alias("path"), "size", F.unix_millis("mtime").alias("mtime_ms"), F.sha2("content", 256).alias("sha256"))
        has = g.has_active()
        stored = g.read("files", g.active(_manifest(settings))) if has else now.limit(0)
        chosen = F.lit(True) if select is None else F.col("path").isin(sorted(set(select)))
        diff = maintenance.snapshot_diff(now.where(chosen), stored.where(chosen), ignore.frame()).cache()
        changed = diff.where("status in ('new', 'changed')")
        records = jsonl.import_sessions(files.drop("path").withColumnRenamed("plain", "path").join(changed, "path", "left_semi")).cache()
        before = g.read("documents").join(changed.select(F.col("path").alias("session_path")), "session_path", "left_semi") if has else None
        docs = _attributed(session_graph.project_sessions(records, settings.policy(), earlier=before), environment, lineage)
        calls = _attributed(session_graph.project_invocations(records), environment, lineage)
        calls = calls.withColumn("invocation_id", F.xxhash64("session_path", "session_id", "entry_id", "block"))
        stale = diff.where("status not in ('unchanged', 'touched')").select(F.col("path").alias("session_path"))
        vectors = spark.createDataFrame([], "id string, checksum string, session_path string, vector array<double>")
        if has:
            docs, calls = maintenance.replace_rows(g.read("documents"), docs, stale), maintenance.replace_rows(g.read("invocations"), calls, stale)
            vectors = g.read("vectors")
        candidate = g.create()
        kept = now.where(chosen).join(diff.where("status <> 'ignored'"), "path", "left_semi").unionByName(stored.where(~chosen))
        g.write(candidate, {"files": kept, "documents": docs, "invocations": calls}, _manifest(settings))
        written = g.read("documents", candidate).where("error is null")
        reused = maintenance.reuse_vectors(written.select("id", "checksum", F.col("session_path").alias("session")), vectors.select("id", "checksum", "vector"), vectors.select("id", "checksum", "vector").limit(0)).cache()
        made = embedding.embed_texts(reused.where("source = 'embed'").select("id").join(written.select("id", "content"), "id"), settings.provider())
        full = maintenance.fill_copies(reused, made).select("id", "checksum", F.col("session").alias("session_path"), "vector")
        g.write(candidate, {"vectors": full}, _manifest(settings))
        owners = maintenance.ownership_conflicts(written.withColumnRenamed("id", "document_id")).first()
        bad = integrity.write_problems(written, g.read("vectors", candidate), settings.embedding_width).first()
        if owners or bad:
            raise RuntimeError(f"nothing was activated: {owners or bad}")
        g.activate(g.stage(candidate))
        failed = records.where("error is not null").count() + g.read("documents").where("error is not null").count()
        sources = {f"vectors_{r.source}": r.n for r in reused.groupBy("source").agg(F.count("*").alias("n")).collect()}
        return {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()} | {"failed": failed} | sources


def find(spark: SparkSession, store: str, query: str, limit: int) -> DataFrame:
    """Phrase search over documents and invocations of the active generation."""
    g = maintenance.Generations(spark, store)
    at = g.active()
    docs = g.read("documents", at).where("error is null").select(F.col("id"), F.col("role").alias("tool_name"), F.col("content").alias("text"))
    calls = g.read("invocations", at).select(F.concat_ws(":", "session_path", "entry_id", "block").alias("id"), "tool_name", "text")
    both = docs.unionByName(calls)
    return lexical.phrase_search(both, "id", ["tool_name", "text"], query, limit).join(both, "id").orderBy("rank", "id")


def recall(spark: SparkSession, store: str, query: str, settings: config.Settings, project: str | None = None, source: str | None = None) -> DataFrame:
    """The mixed results of one query with their details; refused while the index is being changed."""
    if maintenance.locked(spark, store):
        raise RuntimeError("the index is being changed")
    g = maintenance.Generations(spark, store)
    at = g.active(_manifest(settings))
    docs, calls = g.read("documents", at).where("error is null"), g.read("invocations", at)
    stored = g.read("vectors", at).select("id", F.col("vector").alias("embedding")).join(docs.select("id", "project_identity"), "id")
    found = search.search(spark, docs, stored, calls, settings.provider().embed([query.strip()])[0], query, settings.limit, project, settings.dense_limit)
    return search.details(found, docs, calls, project, source)


def check(spark: SparkSession, store: str) -> dict:
    """Counts of the active generation: documents, vectors, problems that would forbid writing them, bytes and files."""
    g = maintenance.Generations(spark, store)
    at = g.active()
    docs, vectors = g.read("documents", at).where("error is null"), g.read("vectors", at)
    width = json.loads(g.files.read(f"{at}/manifest.json"))["embedding"]["width"]
    problems = {r.problem: r.n for r in integrity.write_problems(docs, vectors, width).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    return {"documents": docs.count(), "vectors": vectors.count(), "problems": problems, "healthy": not problems} | maintenance.Shared(spark, at).size()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sessionloom")
    p.add_argument("--config", help="JSON file of settings; SESSIONLOOM_* variables override it")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("index")
    a.add_argument("root")
    a.add_argument("store")
    a.add_argument("--only", nargs="*", help="bound the run to these files")
    a.add_argument("--environment", help="Parquet table of origin, remote, common_dir, is_directory")
    a.add_argument("--lineage", help="JSON file of repository identity -> roots")
    for name, first in (("search", "store"), ("phrase", "store"), ("source", "root")):
        a = sub.add_parser(name)
        a.add_argument(first)
        a.add_argument("query")
        a.add_argument("--project")
    a = sub.add_parser("export")
    a.add_argument("store")
    a.add_argument("session")
    a.add_argument("target")
    sub.add_parser("check").add_argument("store")
    a = sub.add_parser("ignore")
    a.add_argument("store")
    a.add_argument("action", choices=["add", "remove", "list"])
    a.add_argument("paths", nargs="*")
    args = p.parse_args(argv)
    settings = config.load(args.config)
    spark = build_session()
    ship_package(spark)
    if args.what == "ignore":
        ignore = maintenance.IgnoreList(spark, args.store)
        change = {"add": {"add": args.paths}, "remove": {"remove": args.paths}, "list": {}}[args.action]
        print("\n".join(ignore.change(**change) if change else ignore.paths()))
    elif args.what == "index":
        environment = spark.read.parquet(args.environment) if args.environment else None
        lineage = None
        if args.lineage:
            with open(args.lineage) as f:
                lineage = attribution.normalize_lineages(spark, json.load(f))
        print(json.dumps(index(spark, args.root, args.store, settings, args.only, environment, lineage), sort_keys=True))
    elif args.what == "search":
        for r in recall(spark, args.store, args.query, settings, args.project).toLocalIterator():
            print(f"{r.place}. {r.kind} {r.session_path}:{r.line_start} {r.relation} {(r.context or r.content or '')[:200]!r}")
    elif args.what == "phrase":
        for r in find(spark, args.store, args.query, settings.limit).toLocalIterator():
            print(f"{r.rank:.4f} {r.id} {r.text[:200]!r}")
    elif args.what == "export":
        for name, df in maintenance.Generations(spark, args.store).export(args.session).items():
            df.write.mode("overwrite").json(f"{args.target}/{name}")
    elif args.what == "check":
        print(json.dumps(check(spark, args.store), sort_keys=True))
    else:
        lines = jsonl.frame_lines(jsonl.list_sessions(spark, args.root, True))
        for r in scan.source_search(lines, args.query, settings.limit).toLocalIterator():
            print(f"{r.path}:{r.line} {r.excerpt}")
        for r in scan.source_failures(lines, args.query).toLocalIterator():
            print(r.error)
    clean(spark)


if __name__ == "__main__":
    main()
