import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.operators import drift

FILES = "file_id long, producer string, file_seq int, note string"
LINES = "file_id long, line_no int, raw_json string, read_at timestamp, producer string"


def tables(spark, lines, files):
    return (spark.createDataFrame([(f, n, t, None, "clash") for f, n, t in lines], LINES), spark.createDataFrame([(*f, "x") for f in files], FILES))


def test_added_removed_type_and_rename(spark):
    rows = [(1, 0, '{"type":"m","parentId":"abc1","n":1,"o":{"x":1}}'), (1, 1, " "), (1, 2, '{"type":"m","parentId":"abc2"'), (1, 3, "[1]"), (1, 4, None),
            (2, 0, '{"type":"k","z":null}'),
            (3, 0, '{"type":"m","parent_id":"abc3","n":"1","o":{"x":null,"y":true}}'), (3, 0, '{"type":"m","parent_id":"abc3","n":"1","o":{"x":null,"y":true}}')]
    files = [(1, "p", 1), (2, "p", 2), (3, "p", 5), (3, "p", 5), (None, "p", 7)]
    got = {(r.file_seq, r.record_type, r.field_path): (r.change, r.renamed) for r in drift.changes(drift.profiles(*tables(spark, rows, files))).collect()}
    assert got == {
        (5, "m", "parentId"): ("removed", "parent_id"), (5, "m", "parent_id"): ("added", "parentId"),
        (5, "m", "n"): ("type_changed", None), (5, "m", "o.y"): ("added", None),
    }


def test_unified_names_and_repeated_lines(spark):
    rows = [(1, 0, '{"type":"m","parentId":"a","v":1.50,"e":{}}'), (2, 0, '{"type":"m","parent_id":"b","v":null}'), (2, 0, '{"type":"m","parent_id":"b","v":null}'), (2, 1, "{}")]
    recs, files = tables(spark, rows, [(1, "p", 1), (2, "p", 2)])
    out = drift.unify(recs, files, drift.renames(drift.changes(drift.profiles(recs, files)))).collect()
    names = [set(r.fields) - {"type", "v", "e"} for r in sorted(out, key=lambda r: r.file_id)]
    assert len(out) == 2 and names[0] == names[1] and len(names[0]) == 1
    first, second = sorted(out, key=lambda r: r.file_id)
    assert tuple(first.fields["v"]) == ("number", "1.50") and tuple(second.fields["v"]) == ("null", None) and tuple(first.fields["e"]) == ("object", "{}")


def test_values_of_both_names_survive(spark):
    """A record that holds the old and the new name keeps both values; another producer's names are its own."""
    rows = [(1, 0, '{"type":"m","parentId":"a"}'), (2, 0, '{"type":"m","parent_id":"b"}'), (3, 0, '{"type":"m","parentId":"LEFT","parent_id":"RIGHT"}'), (4, 0, '{"type":"m","parent_id":"q"}')]
    recs, files = tables(spark, rows, [(1, "p", 1), (2, "p", 2), (3, "p2", 9), (4, "q", 1)])
    mapping = spark.createDataFrame([(p, "m", n, "parentId") for p in ("p", "p2") for n in ("parentId", "parent_id")], "producer string, record_type string, field_path string, canonical string")
    got = {r.file_id: {k: v.value for k, v in r.fields.items() if k != "type"} for r in drift.unify(recs, files, mapping).collect()}
    assert got == {1: {"parentId": "a"}, 2: {"parentId": "b"}, 3: {"parentId": "LEFT", "parent_id": "RIGHT"}, 4: {"parent_id": "q"}}


def test_unrelated_members_are_no_renaming(spark):
    """Same type, parent and count are no evidence; shared values are, and names of one record are none."""
    line = lambda name, values, **more: [json.dumps({"type": "m", name: v, **more}) for v in values]
    versions = {
        "a": [line("cwd", ["/x", "/y"]), line("model", ["m1", "m2"])],
        "b": [line("timestamp", ["2025", "2026"]), line("parentSession", ["p", "q"])],
        "c": [line("provider", ["u", "v"]), line("version", ["1", "2"])],
        "d": [line("cwd", [f"/w{i}" for i in range(9)]), line("folder", [f"/w{i}" for i in range(9)])],
        "e": [line("sessionId", ["1"]), line("session_id", ["2"]), line("sessionId", ["3"], session_id="4")],
    }
    rows, files, k = [], [], 0
    for producer, seqs in versions.items():
        for seq, lines in enumerate(seqs):
            k += 1
            files.append((k, producer, seq))
            rows += [(k, n, t) for n, t in enumerate(lines)]
    found = drift.changes(drift.profiles(*tables(spark, rows, files))).where("renamed is not null and change = 'added'").collect()
    assert {(r.producer, r.renamed, r.field_path) for r in found} == {("d", "cwd", "folder")}


def test_empty_tables(spark):
    recs, files = tables(spark, [], [])
    prof = drift.profiles(recs, files)
    assert drift.changes(prof).collect() == [] and drift.unify(recs, files, drift.renames(drift.changes(prof))).collect() == []


def test_lines_that_are_no_objects():
    deep = '{"a":' * 100_000
    for text in [None, "", " ", "[]", "null", "{", '{"a":1}}', '{"a":NaN}', deep]:
        assert drift.parse_object(text) is None
    assert list(dict(drift.members(drift.parse_object('{"a":{"b":[{"c":1}]},"d":' + "9" * 5000 + "}")))) == ["a", "d", "a.b"]
    assert drift.value_text(drift.parse_object('{"a":"\\ud800"}')["a"]) == "?"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_matching_is_maximal(rows, cols, seed):
    from itertools import permutations

    score = np.random.default_rng(seed).random((rows, cols)).round(2)
    got = sum(score[a, b] for a, b in drift.best_matching(score))
    m = score if rows <= cols else score.T
    best = max(sum(m[i, p[i]] for i in range(m.shape[0])) for p in permutations(range(m.shape[1]), m.shape[0]))
    assert abs(got - best) < 1e-9


def test_value_text_of_nested():
    assert json.loads(drift.value_text({"a": [1, None]})) == {"a": [1, None]}
