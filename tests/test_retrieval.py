import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import components, evaluation, fusion, lexical, maintenance, ranking, vectors

CAND = ("query_id int, id string, fused_score double, distance double, lexical_rank int, identifier_rank int, is_active boolean, schema_version int, session_id string, session_path string, entry_id string, "
        "contributing_entry_ids array<string>, document_kind string, summary_kind string, evidence_kind string, evidence_part string, is_dense_searchable boolean, role string, text_run_id string, text_run_index int, "
        "chunk_count int, line_start int, line_end int, block_start int, block_end int, chunk_index int, token_start int, token_end int, overlap_tokens int, char_start int, char_end int, sibling_ids array<string>, "
        "previous_sibling_id string, next_sibling_id string, checksum string, content string, tool_call_id string, tool_name string, tool_call_entry_id string, tool_result_entry_id string, tool_error boolean")


def cand(i, score, **more):
    base = dict(query_id=0, id=i, fused_score=score, distance=0.1, is_active=False, schema_version=8, session_id="s", session_path="/s", entry_id="e", contributing_entry_ids=["e"], document_kind="conversation",
                evidence_kind="conversation", evidence_part="content", is_dense_searchable=True, role="user", text_run_id=f"run-{i}", text_run_index=0, chunk_count=1, line_start=2, line_end=2, chunk_index=0,
                token_start=0, token_end=4, overlap_tokens=0, char_start=0, char_end=10, sibling_ids=[], checksum=f"c{i}", content=f"content {i}")
    return base | more


def chunks():
    run = dict(text_run_id="r", chunk_count=3)
    return [
        cand("a", .010, **run, chunk_index=0, char_start=0, char_end=10, token_start=0, token_end=4, content="0123456789", next_sibling_id="b", sibling_ids=["b"], checksum="1"),
        cand("b", .012, **run, chunk_index=1, char_start=8, char_end=18, token_start=3, token_end=7, overlap_tokens=1, content="89abcdefgh", previous_sibling_id="a", next_sibling_id="c", sibling_ids=["a", "c"], checksum="2", is_active=True),
        cand("c", .011, **run, chunk_index=2, char_start=18, char_end=22, token_start=7, token_end=9, content="ijkl", previous_sibling_id="b", sibling_ids=["b"], checksum="3"),
    ]


def frame(spark, rows):
    names = [c.split()[0] for c in CAND.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CAND)


def test_groups_prior_and_neighbours(spark):
    copy = cand("d", .015, session_path="/other", checksum="3", content="ijkl")
    far, kept = cand("x", .9, distance=.51), cand("y", .5, distance=.9, lexical_rank=3)
    df = frame(spark, [*chunks(), copy, far, kept])
    got = {r.id: r for r in ranking.rank(spark, df, 10).collect()}
    assert set(got) == {"y", "b", "d"} and got["b"].occurrences == ["a"] and got["d"].occurrences == ["c"]
    assert got["b"].active_prior == 0.01 and [r.id for r in sorted(got.values(), key=lambda r: r.place)] == ["y", "b", "d"]
    ctx = {r.id: (r.context, r.context_ids) for r in ranking.neighbour_context(ranking.rank(spark, df, 10), df).collect()}
    assert ctx["b"] == ("0123456789abcdefghijkl", ["a", "b", "c"]) and ctx["y"] == (None, None)


def test_rank_limits_and_empty(spark):
    assert ranking.rank(spark, frame(spark, []), 3).collect() == []
    for bad in (0, 201):
        with pytest.raises(ValueError):
            ranking.rank(spark, frame(spark, []), bad)


def test_fusion_scores(spark):
    one = spark.createDataFrame([(0, "a", 0.1)], "query_id int, id string, score double")
    none = one.limit(0)
    assert fusion.rrf({"dense": (one, "score", True)}, 5).first().fused_score == 0.01639344262295082
    both = fusion.rrf({"dense": (one, "score", True), "lexical": (one, "score", False), "identifier": (one, "score", False), "x": (none, "score", True)}, 5).collect()
    assert len(both) == 1 and both[0].fused_score == 0.04918032786885246


def brute_mix(c, i, n):
    if not c:
        return i[:n]
    if not i or n == 1:
        return c[:n]
    c = c[: n - max(1, n // 3)]
    i = i[: n - len(c)]
    k = min(len(c), len(i))
    return [x for p in zip(c, i) for x in p] + c[k:] + i[k:]


def test_mix_equals_brute_force(spark):
    cases, conv, inv = {}, [], []
    for q, (nc, ni) in enumerate((a, b) for a in (0, 1, 2, 5, 9) for b in (0, 1, 2, 5, 9)):
        c, i = [f"c{k}" for k in range(nc)], [f"i{k}" for k in range(ni)]
        conv += [(q, x, k + 1) for k, x in enumerate(c)]
        inv += [(q, x, k + 1) for k, x in enumerate(i)]
        cases[q] = (c, i)
    schema = "query_id int, id string, position int"
    for n in (1, 2, 5, 10):
        got = {}
        for r in sorted(fusion.mix(spark.createDataFrame(conv, schema), spark.createDataFrame(inv, schema), n).collect(), key=lambda r: r.place):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: m for q, (c, i) in cases.items() if (m := brute_mix(c, i, n))}


def test_phrase_search(spark):
    docs = spark.createDataFrame([(1, "bash", 'rg "ELOCKED" src/lease-owner.ts'), (2, "read", "ELOCKED lease src owner ts"), (3, None, None), (4, "rg", "Elocked SRC lease"), (5, "x", "élocked src lease owner ts " * 3)], "id int, tool string, text string")
    ids = lambda q: [r.id for r in lexical.phrase_search(docs, "id", ["tool", "text"], q, 10).collect()]
    assert ids("ELOCKED src/lease-owner.ts") == [1] and ids("...") == [] and ids("rg elocked") == [1]
    assert ids("a a") == [] and sorted(ids("src lease")) == [1, 4, 5]
    assert [r.id for r in lexical.phrase_search(docs, "id", ["tool", "text"], "src lease", 10, F.col("id") > 4).collect()] == [5]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 0.0]), (4, [0.8, 0.6])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.distance, 6)) for r in vectors.nearest(df, [1.0, 0.0], 3).collect()] == [(1, 0.0), (2, 0.2), (4, 0.2)]
    batch = vectors.nearest_batch(df.where("vec_id = 1"), df, 2).collect()
    assert [(r.rank, r.id) for r in sorted(batch, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert [round(x, 4) for x in df.where("vec_id = 2").select(vectors.stored_vector(F.col("embedding"), 1)).first()[0]] == [1.0]
    with pytest.raises(Exception, match="without length"):
        df.where("vec_id = 3").select(vectors.stored_vector(F.col("embedding"), 2)).collect()
    assert df.select(vectors.ip_distance(F.lit(1.5))).first()[0] == 0.0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(5, None)]
    got = {x.node: x.component for x in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e if None not in e}
    for _ in range(300):
        for a, b in edges:
            if b is not None:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_policy_selection(spark):
    rows = [("a", 1.0, .95, .95, 1.0, 0.0, 900, 10, 5, 512), ("b", 1.0, .95, .95, 1.0, 0.0, 800, 10, 5, 512), ("c", .5, .5, .95, 1.0, 0.0, 100, 1, 1, 256)]
    df = spark.createDataFrame(rows, "name string, candidate_recall double, final_recall double, context_recall double, source_recall double, duplicate_rate double, p95_ms int, chunks int, index_ms int, max_tokens int")
    gate = dict(candidate_recall=1, final_recall=.9, context_recall=.9, source_recall=1, duplicate_rate=0, p95_ms=2000)
    assert [(r.name, r.passed, r.failures) for r in evaluation.select_policy(df, gate).orderBy("preference").collect()] == [("b", True, 0), ("a", True, 0), ("c", False, 2)]
    assert evaluation.nearest_rank_percentile(spark.range(1, 5), "id", 0.95).first().value == 4


def test_generations_locks_and_ignore_list(spark, tmp_path):
    g = maintenance.Generations(spark, str(tmp_path / "index"))
    c = g.create()
    assert g.resume() == c
    g.write(c, {"t": spark.range(3)}, {"v": 1, "n": {"x": 2}, "extra": 1})
    first = g.stage(c)
    g.activate(first)
    assert g.read("t").count() == 3 and g.active({"v": 1}) == first and g.has_active()
    with pytest.raises(RuntimeError, match="n.x"):
        g.active({"v": 1, "n": {"x": 3}})
    with pytest.raises(ValueError):
        g.activate(str(tmp_path))
    assert [r.id for r in g.lookup("t", spark.createDataFrame([(1,), (9,)], "x long")).collect()] == [1]
    root = str(tmp_path / "index")
    with maintenance.exclusive_lock(spark, root):
        assert maintenance.locked(spark, root)
        with pytest.raises(TimeoutError), maintenance.exclusive_lock(spark, root):
            pass
    import socket

    for owner in (f"{socket.gethostname()} 999999999", ""):
        (tmp_path / "index" / ".lock").write_text(owner)
        with maintenance.exclusive_lock(spark, root, poll=0.01):
            pass
    assert not maintenance.locked(spark, root)
    ignore = maintenance.IgnoreList(spark, root)
    assert ignore.change(add=["/b", "/a/../a", "/b"]) == ["/a", "/b"] and ignore.change(remove=["/b"]) == ["/a"] and ignore.frame().count() == 1
    assert maintenance.Shared(spark, root).size()["files"] > 3


def test_vector_reuse_and_replacement(spark):
    rows = [("1", "c", "s"), ("2", "c", "s"), ("3", "d", "s"), ("4", "d", "s"), ("5", "e", "s"), ("6", "e", "s"), ("7", "c", "u"), ("8", "f", None), ("9", "f", None), ("a", "g", "s"), ("b", "g", "s")]
    want = spark.createDataFrame(rows, "id string, checksum string, session string")
    cur = spark.createDataFrame([("1", "c", [1.0]), ("3", "old", [9.0]), ("b", "g", [7.0])], "id string, checksum string, vector array<double>")
    old = spark.createDataFrame([("1", "c", [2.0]), ("4", "d", [3.0]), ("a", "g", [8.0])], "id string, checksum string, vector array<double>")
    reused = maintenance.reuse_vectors(want, cur, old)
    got = {r.id: (r.source, r.vector) for r in reused.collect()}
    # an equal text of the session gives its vector, a current one before a legacy one; another session's does not
    assert got == {"1": ("current", [1.0]), "2": ("copy", [1.0]), "3": ("copy", [3.0]), "4": ("legacy", [3.0]), "5": ("embed", None), "6": ("copy", None),
                   "7": ("embed", None), "8": ("embed", None), "9": ("copy", None), "a": ("copy", [7.0]), "b": ("current", [7.0])}
    made = spark.createDataFrame([(k, [float(i)]) for i, k in enumerate("578")], "id string, vector array<double>")
    assert {r.id: r.vector for r in maintenance.fill_copies(reused, made).collect() if r.id in "56789"} == {"5": [0.0], "6": [0.0], "7": [1.0], "8": [2.0], "9": [2.0]}
    a = spark.createDataFrame([("p", 1), ("q", 2)], "session_path string, v int")
    assert sorted((r.session_path, r.v) for r in maintenance.replace_rows(a, a.where("v = 9"), a.where("session_path = 'p'")).collect()) == [("q", 2)]
