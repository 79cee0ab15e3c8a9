import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import attribution, embedding, evaluation, integrity, lexical, vectors

DOC = "id long, name string, text string, clash string"


def best(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


def test_index_on_disk_equals_direct_search(spark, tmp_path):
    rows = [(i, "bash" if i % 2 else None, " ".join(["rg", "--files"] * (i % 4) + ["x"] * (i % 5)) if i % 7 else None, "c") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    index = lexical.PhraseIndex(spark, str(tmp_path), ["name", "text"], buckets=8)
    assert index.search("rg", 5).collect() == []
    index.add(docs.where("id < 30").withColumn("text", F.lit("rg files stale")), "id")
    index.add(docs.where("id % 2 = 0"), "id")
    index.add(docs.where("id % 2 = 1"), "id", removed=spark.createDataFrame([(999,)], "gone long"))
    again = lexical.PhraseIndex(spark, str(tmp_path), ["name", "text"], buckets=8)
    for query in ("rg", "RG --files!", "files rg files", "nothing", "…"):
        want = best(lexical.phrase_search(docs, "id", ["name", "text"], query, 20))
        assert best(index.search(query, 20)) == want == best(again.search(query, 20))
    scope = docs.where("id > 10").select("id")
    assert best(index.search("rg", 20, scope)) == best(lexical.phrase_search(docs, "id", ["name", "text"], "rg", 20, F.col("id") > 10))
    index.compact()
    assert len(index.segments) == 1 and best(index.search("rg", 20)) == best(again.search("rg", 20))
    plan = index.search("rg", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan


def test_overlapping_matches_count(spark):
    docs = spark.createDataFrame([(1, None, "a a a", "c"), (2, None, "a b", "c"), (3, "a", "b a b a b", "c")], DOC)
    assert {r.id for r in lexical.phrase_search(docs, "id", ["name", "text"], "a b", 9).collect()} == {2, 3}
    post = lexical.phrase_hits(lexical.postings(docs, "id", ["name", "text"]), ["a", "a"])
    direct = lexical.phrase_search(docs, "id", ["name", "text"], "a a", 9).collect()
    assert [(r.doc, r.hits) for r in post.collect()] == [(1, 2)] and [r.id for r in direct] == [1]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_block_neighbours_on_both_join_paths(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", most)
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(6)]) for i in range(60)] + [(100, [0.0] * 6), (101, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest_batch(df.where("vec_id % 20 = 0"), df, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (round(r.distance, 9), r.id)
    for q in (0, 20, 40):
        want = [(round(r.distance, 9), r.vec_id) for r in vectors.nearest(df, rows[q][1], 4).collect()]
        assert [got[q][k] for k in range(1, 5)] == want
    assert vectors.nearest(df, [0.0] * 6, 3).collect() == [] and vectors.nearest(df.limit(0), [1.0] * 6, 3).collect() == []


class Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["content-length"])))
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(sent["input"])][::-1]
        if sent["model"] == "short":
            data = data[1:]
        body = json.dumps({"data": data}).encode()
        self.send_response(500 if sent["model"] == "broken" else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_embedding_service_and_table(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/"
    texts = ["a" * n for n in range(40)]
    assert embedding.HttpEmbedding(url, "m", 2).embed(texts) == [[float(n), 1.0] for n in range(40)]
    for model, width, message in (("m", 3, "components"), ("short", 2, "vectors"), ("broken", 2, "500")):
        with pytest.raises(RuntimeError, match=message):
            embedding.HttpEmbedding(url, model, width).embed(texts[:3])
    server.shutdown()
    with pytest.raises(RuntimeError, match="failed"):
        embedding.HttpEmbedding("http://127.0.0.1:9", "m", 2).embed(["x"])
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "one two"), (4, "two one")], "id long, content string")
    got = {r.id: list(r.vector) for r in embedding.embed_texts(df, embedding.HashEmbedding(16)).collect()}
    assert got[1] == got[3] != got[4] and all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 16 for v in got.values())


def test_identities_lineages_and_attribution(spark):
    c = F.col("i")
    rows = [("git-origin:host/a/b", True), ("git-origin:host:22/a/b", True), ("git-origin:Host/a/b", False), ("git-origin:host/a", False), ("git-origin:host/a/../b", False), ("git-origin:host/a/b.git", False),
            ("git-common-directory:/x/.git", True), ("git-common-directory:x", False), ("git-common-directory:/x/./y", False), ("non-git-session-origin:/x", True), ("non-git-session-origin:/x//y", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "i string, want boolean")
    assert df.where(attribution.is_project_identity(c) != F.col("want")).collect() == []
    assert df.where(attribution.is_repository_identity(c) & c.startswith("non-git")).collect() == []
    lin = attribution.normalize_lineages(spark, {"git-origin:h/a/b": ["/old/x", "/old/x/"], "git-origin:h/c/d": ["/old/y"]})
    assert lin.count() == 2
    for bad in ({"nothing": ["/x"]}, {"git-origin:h/a/b": ["x"]}, {"git-origin:h/a/b": ["/old"], "git-origin:h/c/d": ["/old/y"]}):
        with pytest.raises(ValueError):
            attribution.normalize_lineages(spark, bad)
    env = spark.createDataFrame([("/g", "git@H:a/b.git", "/g/.git", True), ("/w", "nonsense", "/w/.git", True), ("/p", None, None, True), ("/gone", None, None, False), ("/old/x/1", "git@h:q/r", None, True)], "origin string, remote string, common_dir string, is_directory boolean")
    origins = spark.createDataFrame([(o,) for o in ("/g", "/w", "/p", "/gone", "/old/x/1", "/old/xy", "", None, "/g")], "origin string")
    got = attribution.resolve_identities(origins, env, lin)
    assert {r.origin: (r.project_identity, r.identity_source) for r in got.collect()} == {
        "/g": ("git-origin:h/a/b", "git_origin"), "/w": ("git-common-directory:/w/.git", "git_common_directory"), "/p": ("non-git-session-origin:/p", "non_git_session_origin"),
        "/gone": (None, None), "/old/x/1": ("git-origin:h/a/b", "configured_project_lineage"), "/old/xy": (None, None)}
    docs = spark.createDataFrame([(1, "/g"), (2, ""), (3, None)], "id long, cwd string")
    assert {r.id: r.project_identity for r in attribution.attribute(docs, got).collect()} == {1: "git-origin:h/a/b", 2: None, 3: None}


def test_empty_tables_are_healthy(spark):
    docs = spark.createDataFrame([], "id long, project_key long, session_path string")
    vec = spark.createDataFrame([], "id long, project_key long, project_bucket long")
    inv = spark.createDataFrame([], "invocation_id long")
    inputs = spark.createDataFrame([], "session_path string, projection_input_id string, document_id long")
    assert integrity.integrity_report(docs, vec, inv, inv, inputs).first().healthy


def test_cases_over_group_members(spark):
    members = spark.createDataFrame([
        (1, 1, "/s/x.jsonl", ["z"], "noise", "conversation", None, True, "/w", "same_repository"),
        (1, 2, "/s/a.jsonl", ["e", "f"], "the Copper lantern", "turn_context", None, False, "/w", "same_repository"),
        (1, 3, "/s/b.jsonl", ["g"], "lantern only", "conversation", None, True, "/v", "same_repository"),
        (2, 1, "/s/a.jsonl", ["q"], None, "conversation", None, True, None, None)],
        "query_id long, rank_no int, session_path string, entry_ids array<string>, content string, evidence_kind string, summary_kind string, is_active boolean, cwd string, relation string")
    expected = spark.createDataFrame([
        (1, 0, "a.jsonl", "f", ["Copper"], "turn_context", None, "abandoned", "/w", "same_repository", ["e"]), (1, 1, "b.jsonl", "g", ["lantern"], None, None, "abandoned", "/w", "same_repository", None),
        (2, 0, "a.jsonl", "q", ["text"], None, None, None, None, None, None)],
        "query_id long, source_no int, session_file string, entry_id string, required_text array<string>, want_evidence string, want_summary string, want_branch string, want_origin string, want_relation string, required_entries array<string>")
    shown = members.select("query_id", "rank_no", F.col("content").alias("text"))
    cases = spark.createDataFrame([(1, ["COPPER"], 2), (2, [], 1), (3, [], 0)], "query_id long, required_context array<string>, least_sources int")
    got = evaluation.case_quality(members, shown, expected, cases, [1, 2, 3])
    rows = {(r.query_id, r.k): (r.recalled, r.preserved, r.preserved_enough, r.context, r.origins, r.relations, r.contributing, r.branches) for r in got.collect()}
    assert rows[1, 1] == (False, 0, False, False, False, False, False, False) and rows[1, 2] == (True, 1, False, True, False, False, False, False)
    assert rows[1, 3] == (True, 2, True, True, False, True, True, False) and rows[2, 3][:4] == (False, 0, False, False) and rows[3, 1][2] is True
    summary = evaluation.quality_summary(got)
    assert {r.k: round(r.recalled, 3) for r in summary.collect()} == {1: 0.0, 2: 0.333, 3: 0.333}
    text = evaluation.report(summary).split("\n")
    assert len(text) == 5 and text[4].startswith("| 3 | 3 | 33.3% |") and evaluation.report(evaluation.quality_summary(got.limit(0))).count("\n") == 1
