import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import conversations as conv

ENTRY = ("entry_key long, row_id long, session_key string, line_no int, record_type string, entry_id string, parent_id string, from_id string, target_id string, "
         "message_role string, message_content string, summary string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, verdict string")
SESSION = "session_key string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, nodes int"
T = datetime(2025, 1, 1)


def entry(key, session, line, kind="message", eid=None, parent=None, target=None, role=None, text="x"):
    return (key, key, session, line, kind, eid or f"e{key}", parent, None, target, role, text, None, T, None, "clash")


def brute(rows, sessions):
    out = {}
    for s in sessions:
        own = [r for r in rows if r[2] == s]
        ids = {}
        for r in sorted(own):
            ids.setdefault(r[5].strip().lower(), r)
        if not own:
            out[s] = ("empty", None)
            continue
        at = max(own, key=lambda r: (r[4] == "leaf", r[3], r[0]))
        path, broken = [], False
        while True:
            if at in path:
                broken = True
                break
            path.append(at)
            link = at[8] if at[4] == "leaf" else at[6]
            if link is None:
                break
            at = ids.get(link.strip().lower())
            if at is None:
                broken = True
                break
        path.reverse()
        roles = [r[9] for r in path if r[4] == "message" and r[9] in ("user", "assistant") and (r[10] or "").strip()]
        bad = any(a == "user" and b != "assistant" for a, b in zip(roles, [*roles[1:], None]))
        kind = "broken" if broken else "empty" if not roles else "missing_reply" if bad else "ok"
        out[s] = (kind, [r[0] for r in path] if kind == "ok" else None)
    return out


def sample(seed):
    r, rows, key = random.Random(seed), [], 0
    for s in range(30):
        last = None
        for line in range(r.randrange(0, 14)):
            key += 1
            role = r.choice(["user", "assistant", "user", "assistant", "toolResult", None])
            rows.append(entry(key, f"s{s}", line, parent=last if r.random() < .9 else r.choice([None, "gone", f"E{key + 1} "]), role=role, text=r.choice(["hi", "hi", "hi", " ", None])))
            last = f" e{key}".upper() if r.random() < .2 else f"e{key}"
        if last and r.random() < .3:
            key += 1
            rows.append(entry(key, f"s{s}", r.randrange(20), "leaf", target=r.choice([last, last, None, "gone"])))
    return rows, [f"s{s}" for s in range(31)]


@pytest.mark.parametrize("max_group", [100_000, 2])
def test_verdicts_and_paths(spark, max_group):
    rows, names = sample(4)
    want = brute(rows, names)
    e = spark.createDataFrame(rows, ENTRY)
    s = spark.createDataFrame([(n, T, None, 1) for n in names] + [("dead", T, T, 1)], SESSION)
    judged, kept = conv.verdicts(spark, e, s, max_group)
    assert {r.session_key: r.verdict for r in judged.collect()} == {k: v[0] for k, v in want.items()}
    got = {}
    for r in sorted(kept.collect(), key=lambda r: (r.session_key, r.turn)):
        got.setdefault(r.session_key, []).append(r.entry_key)
    assert got == {k: v[1] for k, v in want.items() if v[1]}
    assert conv.conversations(spark, e, s, max_group).count() == sum(map(len, got.values()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 30), max_size=5))
def test_segments_compose(roles, cuts):
    cuts = sorted({min(c, len(roles)) for c in cuts} | {0, len(roles)})
    total = (0, 0, 0, False)
    for a, b in zip(cuts, cuts[1:]):
        total = conv.compose(total, conv.judge(roles[a:b]))
    assert total == conv.judge(roles)


def test_empty_tables(spark):
    e, s = spark.createDataFrame([], ENTRY), spark.createDataFrame([], SESSION)
    assert conv.verdicts(spark, e, s)[0].collect() == []
    lone = spark.createDataFrame([("s", T, None, 1), (None, T, None, 1)], SESSION)
    assert [(r.session_key, r.verdict) for r in conv.verdicts(spark, e, lone)[0].collect()] == [("s", "empty")]
