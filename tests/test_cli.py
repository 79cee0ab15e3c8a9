import json

import pytest
from test_sessions import HEAD, file_of, msg

from sessionloom import __main__ as cli
from sessionloom import config
from sessionloom.operators import maintenance


def rows(spark, store, table="documents"):
    return sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in maintenance.Generations(spark, store).read(table).collect())


def test_index_search_and_incremental_equals_full(spark, tmp_path):
    root, store, settings = tmp_path / "logs", str(tmp_path / "store"), config.Settings(embedding_width=32)
    root.mkdir()
    call = [{"type": "text", "text": "it hangs in the hall"}, {"type": "toolCall", "id": "k", "name": "bash", "arguments": {"command": "rg lantern"}}]
    recs = [HEAD, msg("u", None, "user", "find the copper lantern"), msg("a", "u", "assistant", call)]
    a, b = root / "a.jsonl", root / "b.jsonl"
    a.write_bytes(file_of(recs))
    b.write_bytes(file_of([HEAD | {"id": "s2"}, *recs[1:]]))
    (root / "bad.jsonl").write_bytes(b"{\n")
    env = spark.createDataFrame([(HEAD["cwd"], "git@h:a/b", None, True)], "origin string, remote string, common_dir string, is_directory boolean")
    first = cli.index(spark, str(root), store, settings, environment=env)
    assert first == {"new": 3, "failed": 1, "vectors_embed": 6}
    assert cli.find(spark, store, "copper lantern", 10).count() == 4
    for query, kind in (("find the copper lantern", "conversation"), ("rg lantern", "invocation")):
        got = cli.recall(spark, store, query, settings, "git-origin:h/a/b", "git_origin").collect()
        assert {r.kind for r in got} == {kind} and all(r.relation == "same_repository" and r.session_path and r.line_start for r in got)
        assert any(r.occurrences for r in got) == (kind == "conversation")
    assert cli.recall(spark, store, "rg lantern", settings, "git-origin:h/other/c").collect() == []
    with maintenance.exclusive_lock(spark, store), pytest.raises(RuntimeError, match="changed"):
        cli.recall(spark, store, "x", settings)
    a.write_bytes(file_of([*recs, msg("v", "a", "user", "and the brass bell?")]))
    b.unlink()
    # a selection leaves the rest as it was; the whole run then drops the file that is gone
    part = cli.index(spark, str(root), store, settings, select=[str(a)], environment=env)
    assert part == {"changed": 1, "failed": 0, "vectors_current": 6, "vectors_embed": 1}
    assert cli.index(spark, str(root), store, settings, environment=env) == {"missing": 1, "unchanged": 2, "failed": 0, "vectors_current": 4}
    fresh = str(tmp_path / "fresh")
    cli.index(spark, str(root), fresh, settings, environment=env)
    assert rows(spark, store) == rows(spark, fresh) and rows(spark, store, "vectors") == rows(spark, fresh, "vectors")
    report = cli.check(spark, store)
    assert report["healthy"] and report["documents"] == report["vectors"] == 4 and report["bytes"] > 0
    out = maintenance.Generations(spark, store).export(str(a))
    assert out["documents"].count() == 4 and out["files"].count() == 1 and out["vectors"].count() == 4 and out["invocations"].count() == 1
    with pytest.raises(RuntimeError, match="embedding.width"):
        cli.index(spark, str(root), store, config.Settings(embedding_width=16))


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"limit": 7, "max_tokens": 100, "overlap_tokens": 10}')
    got = config.load(str(file), {"SESSIONLOOM_LIMIT": "3", "SESSIONLOOM_EMBEDDING_URL": "http://x"})
    assert (got.limit, got.max_tokens, got.policy().overlap_tokens, got.provider().base_url) == (3, 100, 10, "http://x")
    for text, env in (('{"nothing": 1}', {}), ("{}", {"SESSIONLOOM_LIMIT": "11"}), ("{}", {"SESSIONLOOM_LIMIT": "many"}), ('{"overlap_tokens": 600}', {})):
        file.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(file), env)
