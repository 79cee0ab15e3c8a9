import random
from datetime import datetime, timedelta

import pytest

from sessionloom.operators import orphans

SCHEMA = f"table_name string, record_key string, at timestamp_ntz, tie long, live boolean, kind string, scope string, ref_id string, refs {orphans.REFS}"


def brute(rows):
    first, cur = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        first.setdefault(r[:2], r[2].date())
        cur[r[:2]] = r
    since = {}
    for k, r in cur.items():
        if r[4] and r[7] is not None:
            since.setdefault(r[5:8], []).append(first[k])
    return {(*k, f[0]) for k, r in cur.items() if r[4] for f in r[8] if not any(d <= first[k] for d in since.get(f[1:], []))}


def sample(seed, n=150):
    r = random.Random(seed)
    start, rows = datetime(2025, 1, 1), []
    for i in range(n):
        key = f"k{r.randrange(60)}"
        refs = [(f, "e", "s", f"i{r.randrange(50)}") for f in ("parent_id", "from_id") if r.random() < .6]
        own = f"i{r.randrange(50)}" if r.random() < .9 else None
        rows.append(("entries", key, start + timedelta(hours=r.randrange(24 * 500)), i, r.random() < .85, "e", r.choice(["s", "s", None]), own, refs))
    return rows


@pytest.mark.parametrize("period", ["year", "quarter"])
def test_any_batching_gives_the_final_state(spark, period):
    rows = sample(5)
    state = orphans.track(spark, spark.createDataFrame(rows, SCHEMA), period)
    got = [(r.table_name, r.record_key, r.ref_field) for r in state.pending().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    day = lambda r: r[2].date()
    for p in {h.period for h in state.history().collect()}:
        after = p.replace(year=p.year + 1) if period == "year" else (p.replace(month=p.month + 3) if p.month < 10 else p.replace(year=p.year + 1, month=1))
        want = brute([r for r in rows if day(r) < after])
        assert sum(h.orphans for h in state.history().where(f"period = date'{p}'").collect()) == len(want)


@pytest.mark.parametrize("seed,late", [(6, False), (7, True)])
def test_batches_continue_stored_state(spark, tmp_path, seed, late):
    """Batches, late ones among them, end where one history ends, also after a restart between them."""
    rows = sample(seed)
    if late:
        random.Random(seed).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[2])
    cuts = [rows[:50], rows[50:90], [], rows[90:]]
    for k, part in enumerate(cuts):
        state = orphans.OrphanState(spark, str(tmp_path), buckets=4)
        assert state.seq == k
        state.advance(spark.createDataFrame(part, SCHEMA), "year")
        seen = [r for c in cuts[:k + 1] for r in c]
        got = [(r.table_name, r.record_key, r.ref_field) for r in state.pending().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(seen)
    last = state.history().where("batch = 4").collect()
    assert sum(r.orphans for r in last if r.period == max(x.period for x in last)) == len(got)


def test_a_batch_reads_only_touched_buckets(spark, tmp_path):
    state = orphans.OrphanState(spark, str(tmp_path), buckets=16)
    day = lambda d: datetime(2025, 1, d)
    state.advance(spark.createDataFrame([("entries", f"k{i}", day(1), i, True, "e", "s", f"i{i}", [("parent_id", "e", "s", f"i{i + 1}")]) for i in range(200)], SCHEMA))
    before = {t: dict(at) for t, at in state.at.items()}
    state.advance(spark.createDataFrame([("entries", "k5", day(2), 999, False, "e", "s", "i5", [])], SCHEMA))
    assert [sum(before[t][b] != p for b, p in state.at[t].items()) for t in ("records", "offers", "refs")] <= [1, 2, 2]
    assert {r.record_key for r in state.pending().collect()} == {"k4", "k199"}


def test_open_resolve_reopen(spark):
    ref = [("parent_id", "e", "s", "p")]
    day = lambda d: datetime(2025, 1, d)
    batches = [
        [("entries", "c", day(3), 0, True, "e", "s", "c", ref)],
        [("entries", "p", day(4), 1, True, "e", "s", "p", [])],  # late: the orphan stays
        [("entries", "c2", day(5), 2, True, "e", "s", "c2", ref)],  # resolved at once
        [("entries", "p", day(6), 3, False, "e", "s", "p", [])],  # deletion reopens it
    ]
    state, seen = orphans.OrphanState(spark), []
    for b in batches:
        state.advance(spark.createDataFrame(b, SCHEMA))
        seen.append({(r.record_key, r.since is not None) for r in state.pending().collect()})
    assert seen == [{("c", False)}, {("c", True)}, {("c", True)}, {("c", False), ("c2", False)}]


def test_empty_input(spark):
    state = orphans.track(spark, spark.createDataFrame([], SCHEMA))
    assert state.pending().collect() == [] and state.history().collect() == []


def test_null_keys_blank_references_and_clashing_columns(spark):
    schema = "entry_key long, row_id long, session_key string, entry_id string, parent_id string, from_id string, target_id string, first_kept_entry_id string, message_tool_call_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, kind string, refs string"
    t = datetime(2025, 1, 1)
    rows = [(None, 1, "s", "a", "x", None, None, None, None, t, None, "c", "c"), (1, 2, "s", " A ", "", None, None, None, "call", t, None, "c", "c"), (2, 3, "s", "b", "a\t", None, None, None, None, t, None, "c", "c")]
    e = spark.createDataFrame(rows, schema)
    s = spark.createDataFrame([], "session_key string, session_path string, parent_session string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    c = spark.createDataFrame([(1, "s", "CALL", t), (1, "s", "CALL", t)], "call_key long, session_key string, tool_call_id string, ingested_at timestamp_ntz")
    got = [(r.record_key, r.ref_field) for r in orphans.track(spark, orphans.session_log_deliveries(e, s, c)).pending().collect()]
    assert got == [("1", "parent_id")]
