import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import forest

SCHEMA = "scope string, node long, node_id string, link_id string"


def brute(rows):
    ids = {}
    for s, n, i, _ in sorted(rows, key=lambda r: r[1]):
        if i is not None:
            ids.setdefault((s, i), n)
    up = {n: ids.get((s, link)) if link is not None and s is not None else None for s, n, _, link in rows}
    out = {}
    for n in up:
        trail = [n]
        while up[trail[-1]] is not None and up[trail[-1]] not in trail:
            trail.append(up[trail[-1]])
        if up[trail[-1]] is None:
            out[n] = (trail[-1], len(trail) - 1, None, False, trail[::-1])
        else:
            ring = trail[trail.index(up[trail[-1]]):]
            out[n] = (None, None, min(ring), n in ring, None)
    below = {n: sorted(m for m, v in out.items() if v[4] and n in v[4][:-1]) if out[n][2] is None else None for n in out}
    return {n: (*v, below[n]) for n, v in out.items()}


def forest_rows(seed, n=120):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        scope = r.choice(["a", "a", "a", "b", None])
        rows.append((scope, k, r.choice([f"i{k}", None]) if r.random() < .2 else f"i{k}", r.choice([None, "gone"]) if r.random() < .1 else f"i{r.randrange(n)}"))
    return rows


@pytest.mark.parametrize("max_group,max_component", [(200_000, 1), (3, 1000), (3, 4)])
def test_hierarchy_equals_brute_force(spark, max_group, max_component):
    rows = forest_rows(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("clash"))
    got = {r.node: (r.root, r.depth, r.cycle, r.on_cycle, r.path, r.descendants) for r in forest.hierarchy(spark, df.drop("root"), max_group, max_component=max_component).collect()}
    assert got == brute(rows)
    bad = {r.node: r.cycle for r in forest.cycles(spark, df, max_group, max_component=max_component).collect()}
    want = brute(rows)
    assert bad == {n: v[2] for n, v in want.items() if v[2] is not None}
    flat = {r.node: r for r in forest.nested(spark, df, max_group, max_component=max_component).collect()}
    assert flat.keys() == want.keys()
    trees = {}
    for n, r in flat.items():
        assert (r.root, r.depth, r.cycle, r.on_cycle) == want[n][:4]
        if r.cycle is None:
            trees.setdefault(r.root, []).append(r)
            assert r.parent == (want[n][4][-2] if r.depth else None)
    for members in trees.values():
        assert [r.enter for r in sorted(members, key=lambda r: want[r.node][4])] == list(range(len(members)))
        for r in members:
            assert sorted(m.node for m in members if r.enter < m.enter <= r.leave) == want[r.node][5]


def test_long_chain_and_ring_by_doubling(spark):
    rows = [("s", k, f"n{k}", f"n{k - 1}" if k else None) for k in range(300)] + [("s", 1000 + k, f"r{k}", f"r{(k + 1) % 77}") for k in range(77)]
    got = {r.node: r for r in forest.hierarchy(spark, spark.createDataFrame(rows, SCHEMA), 10, max_component=10).collect()}
    assert got[299].depth == 299 and got[299].root == 0 and got[299].path == list(range(300))
    assert got[0].descendants == list(range(1, 300))
    assert {got[1000 + k].cycle for k in range(77)} == {1000} and all(got[1000 + k].on_cycle for k in range(77))


def test_empty_and_null_rows(spark):
    assert forest.hierarchy(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    got = forest.hierarchy(spark, spark.createDataFrame([(None, 1, None, None), (None, 2, "", "")], SCHEMA)).collect()
    assert {r.node: (r.root, r.cycle) for r in got} == {1: (1, None), 2: (2, None)}


def test_long_chains_stay_linear_in_memory():
    """A chain as long as the longest real session, and the largest co-located one, within stated memory."""
    import tracemalloc

    import numpy as np

    for n, full, most_mb in ((20_004, True, 40), (200_000, False, 150)):
        node, parent = np.arange(n), np.arange(-1, n - 1)
        tracemalloc.start()
        ids = 0
        for f in forest._spread(node, parent) if full else forest._linear(node, parent):
            ids += sum(map(len, f["path"])) + sum(map(len, f["descendants"])) if full else len(f)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert ids == (n * n if full else n) and peak < most_mb


def test_groups_are_never_cut():
    import pandas as pd

    keys = sorted(random.Random(1).choices("abcdef", k=50))
    frames = [pd.DataFrame({"k": keys[i:i + 4], "v": range(i, min(i + 4, 50))}) for i in range(0, 50, 4)]
    out = list(forest.whole_groups(iter(frames), "k"))
    assert [v for f in out for v in f["v"]] == list(range(50))
    seen = set()
    for f in out:
        assert not seen & set(f["k"])
        seen |= set(f["k"])
