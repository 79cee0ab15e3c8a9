import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import chunking as ck
from sessionloom.functions import identity, invocations
from sessionloom.operators import integrity, search, session_graph
from sessionloom.sources import jsonl, scan

HEAD = {"type": "session", "version": 3, "id": "s1", "timestamp": "t", "cwd": "/w/p"}
# The records whose hashed entry ids are pinned below, with the members that the oldest format asks for.
LINEAR = [
    {"type": "session", "id": "session-v1-fixture", "timestamp": "2025-12-01T10:00:00.000Z", "cwd": "/legacy/project", "parentSession": "/legacy/parent.jsonl"},
    {"type": "message", "timestamp": "2025-12-01T10:00:01.000Z", "message": {"role": "user", "content": "Where is the v1 migration note?", "timestamp": 1764583201000}},
    {"type": "message", "timestamp": "2025-12-01T10:00:02.000Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "The v1 migration note is in docs/v1.md."}, {"type": "toolCall", "id": "v1-call", "name": "read", "arguments": {"path": "docs/v1.md"}}], "api": "test", "provider": "test", "model": "test", "usage": {"input": 1, "output": 1, "cacheRead": 0, "cacheWrite": 0}, "stopReason": "toolUse", "timestamp": 1764583202000}},
    {"type": "message", "timestamp": "2025-12-01T10:00:03.000Z", "message": {"role": "toolResult", "toolCallId": "v1-call", "toolName": "read", "content": [{"type": "text", "text": "v1 source evidence"}], "isError": False, "timestamp": 1764583203000}},
    {"type": "compaction", "timestamp": "2025-12-01T10:00:04.000Z", "summary": "V1 summary evidence.", "firstKeptEntryIndex": 2, "tokensBefore": 100},
]


def file_of(records, end="\n"):
    return (end.join(json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in records) + end).encode()


def msg(i, parent, role, text, **more):
    return {"type": "message", "id": i, "parentId": parent, "timestamp": "t", "message": {"role": role, "content": text} | more}


def project(spark, *files, policy=None):
    df = spark.createDataFrame([(f"/f{k}.jsonl", f) for k, f in enumerate(files)], "path string, content binary")
    return jsonl.import_sessions(df), policy


def test_linear_conversion_ids():
    form, (records,) = jsonl.import_file(file_of(LINEAR))
    ids = [r["id"] for _, r in records[1:]]
    assert form == "linear" and records[0][1]["version"] == 2
    assert ids == ["3365ad4e8d9190b1c7ab35a854eeacaa8984f8a7", "6d35bf551059e2664b2bbefc7b43d63d006b6158", "10d74c0b1c52779ebbbdec04453a1bbfc2747aac", "6a3eac6379d2e6df8c364330052940c8f84ddc43"]
    assert records[4][1]["firstKeptEntryId"] == ids[1] and "firstKeptEntryIndex" not in records[4][1]


def test_framing_and_rejections(spark):
    body = file_of([HEAD, msg("a", None, "user", "x y")], "\r\n")
    assert [n for n, _ in jsonl.parse_lines(body + b"\n\n")] == [1, 2]
    for bad in (b"", b"\n", b"[]\n", b"{}\n", file_of([msg("a", None, "user", "x")]), file_of([HEAD | {"version": 4}])):
        with pytest.raises(jsonl.Rejected):
            jsonl.import_file(bad)
    files = spark.createDataFrame([("/a", body), ("/b", b"x\ry\nz")], "path string, content binary")
    got = {(r.path, r.line): r.text for r in jsonl.frame_lines(files).collect()}
    assert len([k for k in got if k[0] == "/a"]) == 2 and got["/b", 1] == "x\ry" and got["/b", 2] == "z"
    assert [r.error is not None for r in jsonl.import_sessions(files).where("session_path = '/b'").collect()] == [True]


def test_reuse_history_gives_two_sessions(spark):
    part = [HEAD, msg("a", None, "user", "one"), msg("b", "a", "assistant", "two")]
    docs = session_graph.project_sessions(project(spark, file_of(part + part))[0]).collect()
    assert len(docs) == 6 and len({d.id for d in docs}) == 6 and jsonl.import_file(file_of(part + part))[0] == "reuse_history"


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_bytes(file_of([HEAD]))
    (tmp_path / "y.txt").write_text("no")
    assert jsonl.list_sessions(spark, str(tmp_path)).count() == 1 and jsonl.list_sessions(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.source_identity(jsonl.list_sessions(spark, str(tmp_path), True)).first().size == len(file_of([HEAD]))


def test_graph_contexts_and_turns(spark):
    records = [HEAD, msg("u", None, "user", "ask"), msg("a", "u", "assistant", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}, {"type": "image"}, {"type": "text", "text": "z"}]),
               msg("b", "u", "assistant", "other"), {"type": "compaction", "id": "c", "parentId": "a", "timestamp": "t", "summary": " sum ", "firstKeptEntryId": "a"},
               msg("v", "c", "user", "again"), {"type": "session_info", "id": "i", "parentId": "v", "timestamp": "t", "name": " N "}, {"type": "leaf", "targetId": "v"}]
    docs = [d.asDict() for d in session_graph.project_sessions(project(spark, file_of(records))[0]).collect()]
    by = {(d["entry_id"], d["role"], d["content"]): d for d in docs}
    assert by["a", "assistant", "x\ny"]["block_end"] == 1 and by["a", "assistant", "z"]["text_run_index"] == 1
    assert by["u", "turn", "User:\nask\n\nAssistant:\nx\ny\n\nz"]["is_active"] and not by["u", "turn", "User:\nask\n\nAssistant:\nother"]["is_active"]
    assert by["u", "user", "ask"]["compacted_by"] == ["c"] and not by["u", "user", "ask"]["is_visible"] and by["a", "assistant", "z"]["is_visible"]
    assert by["c", "summary", "sum"]["summary_kind"] == "compaction" and {d["session_name"] for d in docs} == {"N"} and by["b", "assistant", "other"]["branch_path_leaf_ids"] == ["b"]
    assert by["u", "user", "ask"]["branch_path_leaf_ids"] == ["b", "i", "v"]


@pytest.mark.parametrize("records", [
    [HEAD, msg("a", "gone", "user", "x")], [HEAD, msg("a", None, "user", "x"), msg("a", None, "user", "x")], [HEAD, msg("a", "b", "user", "x"), msg("b", "a", "user", "x")],
    [HEAD, msg("a", None, "user", "x"), {"type": "leaf", "targetId": "zz"}], [HEAD, msg("a", None, "toolResult", [], toolCallId="k", toolName="read")],
])
def test_invalid_sessions_give_one_error_row(spark, records):
    got = session_graph.project_sessions(project(spark, file_of(records))[0]).collect()
    assert len(got) == 1 and got[0].error


def test_chunk_geometry():
    text = "# H\n" + "word " * 30 + "\n\n# Next\nmore words here. And 😀 more of it"
    spans = ck.chunk_text(text, max_tokens=20, overlap=3)
    wide = text.encode("utf-16-le")
    assert all(wide[2 * s.char_start:2 * s.char_end].decode("utf-16-le") == s.content for s in spans)
    assert all(b.token_start == a.token_end - b.overlap_tokens and b.overlap_tokens <= 3 for a, b in zip(spans, spans[1:]))
    assert all(s.n_tokens <= 20 for s in spans) and ck.chunk_text(" \n") == []
    assert ck.utf16("a😀b") == 4
    for bad in ((0, 0), (10, 10), (1025, 0), (200, 129)):
        with pytest.raises(ValueError):
            ck.ChunkPolicy(*bad)


@pytest.mark.parametrize("text,first", [
    ("one two three\n# four five six", "one two three"), ("one two three\n\nfour five six", "one two three"),
    ("one two three\nfour five six", "one two three"), ("one two three. four five six", "one two three."), ("```\none two\n``` four\nfive six seven", "```\none two\n``` four"),
])
def test_natural_boundaries(text, first):
    assert ck.chunk_text(text, max_tokens=5, overlap=0)[0].content == first


def test_turns_fit_and_fail():
    out = ck.turn_texts("a " * 40, "b " * 10, ck.whitespace_tokens, 20)
    assert len(out) > 1 and all(ck.whitespace_tokens(t) <= 20 for t in out)
    with pytest.raises(ValueError):
        ck.turn_texts("a b c d", "e f g h", ck.whitespace_tokens, 3)


def test_invocation_text_and_bounds(spark):
    args = {"path": "a/b", "newText": "zz", "queryText": "keep", "n": [1.0, 2.5, 1e21, 1e-7], "x": {"script": 1, "b": None}}
    lines = invocations.searchable_text("edit", args).split("\n")
    assert lines == ['tool="edit"', "newText=<omitted>", "x.script=<omitted>", "n[0]=1", "n[1]=2.5", "n[2]=1e+21", "n[3]=1e-7", 'path="a/b"', 'queryText="keep"', "x.b=null"]
    assert invocations.searchable_text("x" * 5000, None) == f'tool="{"x" * 1024}"'
    assert invocations.searchable_text("t", [{"b": 1, "code": 2}, ["q"], "r"]).split("\n") == ['tool="t"', "[0].code=<omitted>", "[0].b=1", '[1][0]="q"', '[2]="r"']
    big = invocations.searchable_text("t", {f"k{i}": "v" * 1500 for i in range(7)})
    assert len(big) <= 4096 and big.count("\n") == 3
    records = [HEAD, msg("a", None, "assistant", [{"type": "toolCall", "id": "k", "name": "read", "arguments": {"path": "p"}}]), msg("r", "a", "toolResult", [], toolCallId="k", toolName="read", isError=True),
               {"type": "message", "id": "b", "parentId": "r", "timestamp": "t", "message": {"role": "bashExecution", "command": "ls", "exitCode": 0}}]
    got = session_graph.project_invocations(project(spark, file_of(records))[0]).collect()
    assert {(r.kind, r.tool_name, r.is_error) for r in got} == {("tool_call", "read", True), ("bash_execution", "bash", False)}


def test_unchanged_texts_are_not_tokenized_again(spark, monkeypatch):
    """Only texts whose input or policy changed are chunked, and the result equals a full projection."""
    note = {"type": "custom_message", "id": "n", "parentId": None, "timestamp": "t", "content": "Alpha words. " * 30}
    old = [HEAD, note, msg("u", "n", "user", "a question"), msg("a", "u", "assistant", "short answer")]
    new = [*old, msg("v", "a", "user", "one more question"), {"type": "leaf", "targetId": "a"}]
    policy, files = ck.ChunkPolicy(16, 4), [project(spark, file_of(r))[0] for r in (old, new)]
    first = session_graph.project_sessions(files[0], policy).cache()
    known, graph = session_graph._known(first.toPandas()), session_graph.Graph(list(enumerate(new)))
    full = session_graph.documents("/f0.jsonl", HEAD["id"], graph, policy, ck.whitespace_tokens)
    seen, chunk = [], ck.chunk_text
    monkeypatch.setattr(ck, "chunk_text", lambda text, *a, **k: seen.append(text) or chunk(text, *a, **k))
    assert session_graph.documents("/f0.jsonl", HEAD["id"], graph, policy, ck.whitespace_tokens, known) == full and seen == ["one more question"]
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(session_graph.project_sessions(files[1], policy))
    assert rows(session_graph.project_sessions(files[1], policy, earlier=first)) == want
    # incomplete or differing earlier chunks are no use, and do no harm
    broken = first.withColumn("input_checksum", F.lit("other")).unionByName(first.where("chunk_index > 0"))
    assert rows(session_graph.project_sessions(files[1], policy, earlier=broken)) == want


V1 = {"message": {"role": "user", "content": "x", "timestamp": 1}}


@pytest.mark.parametrize("entry,fits", [
    ({"type": "message"} | V1, True), ({"type": "custom_message", "content": "x"}, False), ({"type": "session_info", "name": "x"}, False), ({"type": "branch_summary", "summary": "x"}, False),
    ({"type": "message", "message": {"role": "anything", "content": "x", "timestamp": 1}}, False), ({"type": "message", "message": {"role": "user", "content": "x"}}, False),
    ({"type": "message", "message": {"role": "user", "timestamp": 1}}, False), ({"type": "model_change", "provider": "p", "modelId": "m"}, True), ({"type": "model_change", "provider": "p"}, False),
    ({"type": "thinking_level_change", "thinkingLevel": "low"}, True), ({"type": "thinking_level_change"}, False), ({"type": "message", "id": "i"} | V1, False),
    ({"type": "message", "message": {"role": "assistant", "content": [], "api": "a", "provider": "p", "model": "m", "usage": {}, "stopReason": "s", "timestamp": 1}}, True),
    ({"type": "message", "message": {"role": "assistant", "content": "text", "api": "a", "provider": "p", "model": "m", "usage": {}, "stopReason": "s", "timestamp": 1}}, False),
    ({"type": "message", "message": {"role": "toolResult", "content": [], "toolCallId": "c", "toolName": "t", "isError": False, "timestamp": 1}}, True),
    ({"type": "message", "message": {"role": "bashExecution", "command": "c", "output": "", "cancelled": False, "truncated": "no", "timestamp": 1}}, False),
    ({"type": "compaction", "summary": "s", "firstKeptEntryIndex": 1.5, "tokensBefore": 1}, False), ({"type": "compaction", "summary": "s", "firstKeptEntryIndex": 2}, False),
])
def test_what_the_oldest_format_allows(entry, fits):
    assert jsonl._is_linear_entry({"timestamp": "t"} | entry) is fits


def test_graph_rows(spark):
    recs = [HEAD, msg("a", None, "user", "x"), msg("b", "a", "assistant", "y"), msg("c", "b", "user", "z"), {"type": "compaction", "id": "k", "parentId": "c", "timestamp": "t", "summary": "s", "firstKeptEntryId": "b", "tokensBefore": 1},
            msg("d", "b", "user", "w"), {"type": "leaf", "targetId": "k"}]
    got = {r.entry_id: r for r in session_graph.project_graph(project(spark, file_of(recs), file_of([HEAD, msg("q", "gone", "user", "x")]))[0]).collect()}
    assert got[None].error and {i for i, r in got.items() if r.is_visible} == {"b", "c", "k"} and {i for i, r in got.items() if r.is_active} == {"a", "b", "c", "k"}
    assert got["a"].compacted_by == ["k"] and got["b"].compacted_by == [] and got["b"].leaf_ids == ["k", "d"] and got["b"].child_ids == ["c", "d"] and got["k"].depth == 3


def test_long_linear_session_is_walked_once():
    import time

    n = 20_004
    recs = [(0, HEAD)] + [(i, msg(f"e{i}", f"e{i - 1}" if i > 1 else None, "user", "x")) for i in range(1, n)]
    recs += [(n + k, {"type": "compaction", "id": f"c{k}", "parentId": f"e{n - 1}", "timestamp": "t", "summary": "s", "firstKeptEntryId": f"e{n - 5}", "tokensBefore": 1}) for k in range(3)]
    began = time.time()
    g = session_graph.Graph(recs)
    assert g.depth[f"e{n - 1}"] == n - 2 and len(g.compacted["e1"]) == 3 and time.time() - began < 10


@pytest.mark.parametrize("remote,want", [
    ("git@Host.org:a/b.git", "git-origin:host.org/a/b"), ("https://u:p@host/a/B.git/", "git-origin:host/a/B"), ("https://host:443/a/b", "git-origin:host/a/b"), ("ssh://git@host:2222/a/b", "git-origin:host:2222/a/b"),
    ("https://host/a", None), ("ftp://host/a/b", None), ("https://host/a/../b", None), ("https://host/a/b?x=1", None), ("nothing", None), ("https://host:xx/a/b", None),
])
def test_remotes(remote, want):
    assert identity.normalise_remote(remote) == want


def test_source_scan_drops_files_with_bad_matches(spark):
    lines = spark.createDataFrame([
        ("a", 1, '{"type":"session","cwd":"/x"}'), ("a", 2, '{"t":"HIT","id":"e"}'), ("a", 3, '{"type":"session"}'), ("a", 4, '["hit"]'),
        ("b", 1, "hit {"), ("b", 2, '{"t":"hit"}'), ("c", 1, '{"t":"' + "y" * 3000 + ' hit' + "z" * 3000 + '"}'), ("d", 1, '{"t":"hit"}'), ("d", 2, 'no match but "session"'), ("e", 1, "broken {")], "path string, line int, text string")
    got = scan.source_search(lines, " Hit ", 10).collect()
    # a header without cwd resets the origin, a possible header that is no JSON rejects the file
    assert [(r.path, r.line, r.entry_id, r.origin) for r in got] == [("a", 2, "e", "/x"), ("a", 4, None, ""), ("c", 1, None, "")]
    assert got[2].excerpt[0] == got[2].excerpt[-1] == "…" and len(got[2].excerpt) == 2000
    assert {(r.path, r.line) for r in scan.source_failures(lines, "hit").collect()} == {("b", 1), ("d", 2)}
    with pytest.raises(ValueError):
        scan.source_search(lines, " ", 1)


def test_end_to_end_search(spark):
    long = "Alpha words. " * 12
    recs = [HEAD, msg("u", None, "user", long), msg("a", "u", "assistant", [{"type": "text", "text": "the answer"}, {"type": "toolCall", "id": "k", "name": "bash", "arguments": {"command": "rg needle x"}}])]
    records, _ = project(spark, file_of(recs), file_of([HEAD | {"id": "s2"}, *recs[1:]]))
    docs = session_graph.project_sessions(records, ck.ChunkPolicy(16, 4)).cache()
    assert docs.where("error is not null").count() == 0 and integrity.duplicates(docs, "id").count() == 0
    stored = docs.select("id", F.when(F.col("content").contains("Alpha"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.9), F.lit(0.1))).alias("embedding"), F.lit("p").alias("project_identity"))
    calls = session_graph.project_invocations(records).select(F.concat("session_path", "entry_id").alias("invocation_id"), "tool_name", "text", F.lit("p").alias("project_identity"))
    got = search.search(spark, docs, stored, calls, [1.0, 0.0], "rg needle", 4).collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1)) and {r.kind for r in got} == {"conversation", "invocation"}
    assert any(r.occurrences for r in got if r.kind == "conversation") and all(r.content for r in got)
    assert search.search(spark, docs, stored, calls, [1.0, 0.0], "rg needle", 4, project="none").collect() == []
