import random
import re

import pytest

from sessionloom.llm import neardup
from sessionloom.llm.neardup import NearDuplicates

ITEM = "id long, text string, class_id string"


def shingles(text, width):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}, len(w)


def brute(rows, width, num, den, least):
    sets = {i: shingles(t, width) for i, t, _ in rows if i is not None}
    sets = {i: s for i, (s, n) in sets.items() if n >= max(least, width)}
    return {(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def sample(seed, n=160):
    r = random.Random(seed)
    phrases = [[r.choice("abcdefghij") for _ in range(4)] for _ in range(6)]
    texts = []
    for _ in range(n):
        if texts and r.random() < .6:
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, 6)):
                k = r.randrange(len(w))
                w[k:k + r.randrange(2)] = [f"n{r.randrange(400)}"][: r.randrange(2)]
        else:
            w = [x for _ in range(r.randrange(1, 9)) for x in r.choice(phrases) + [f"w{r.randrange(500)}"]]
        texts.append(" ".join(w) or "a")
    return [(i, t if r.random() < .95 else r.choice([None, "", t.upper() + "!"]), "clash") for i, t in enumerate(texts)] + [(None, "a b c d e f", None)]


@pytest.mark.parametrize("rare,width,num,den,least,hot,known", [(16, 3, 3, 5, 6, 256, 1000), (1, 3, 3, 5, 6, 2, 1000), (2, 5, 4, 5, 1, 256, 0), (0, 2, 1, 2, 1, 1, 0)])
def test_pairs_equal_brute_force(spark, rare, width, num, den, least, hot, known):
    """Also where posting lists are extended (hot) and where frequencies are joined instead of sent (known)."""
    rows = sample(rare + width)
    near = NearDuplicates(spark, spark.createDataFrame(rows, ITEM), width, (num, den), least, rare, hot, known)
    got = [(r.id_a, r.id_b) for r in near.pairs().collect()]
    want = brute(rows, width, num, den, least)
    assert len(got) == len(set(got)) and set(got) == want
    group = {r.id: r.group_id for r in near.groups().collect()}
    for a, b in want:
        assert group[a] == group[b]
    assert len(set(group.values())) == len({min(c) for c in _components(group, want)})


def _components(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return out.values()


def test_empty_and_hot_copies(spark):
    assert NearDuplicates(spark, spark.createDataFrame([], ITEM)).pairs().collect() == []
    rows = [(i, "one two three four five six seven", "x") for i in range(60)] + [(100, "one two three four five six seven eight", "x")]
    near = NearDuplicates(spark, spark.createDataFrame(rows, ITEM), 3, (3, 5))
    assert near.pairs().count() == 61 * 60 // 2 and near.links().count() == 1


def test_texts_of_shared_runs_are_not_candidates(spark, monkeypatch):
    """Runs shared by dozens of texts make few candidates, though more runs are frequent than places are sent."""
    r = random.Random(5)
    half = lambda: " ".join(f"the a{r.randrange(9)} b{r.randrange(9)} keeps c{r.randrange(9)} away" for _ in range(7))
    texts = [half() for _ in range(400)]
    texts += [" ".join(t.split()[:-1] + ["gone"]) for t in texts[:20]]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    written = {}
    kept = neardup.materialize

    def counting(s, df, tag):
        out = kept(s, df, tag)
        written[tag] = written.get(tag, 0) + out[0].count()
        return out

    monkeypatch.setattr(neardup, "materialize", counting)
    near = NearDuplicates(spark, spark.createDataFrame(rows, ITEM), 3, (3, 5), 6, most_known=64)
    want = brute(rows, 3, 3, 5, 6)
    assert {(x.id_a, x.id_b) for x in near.pairs().collect()} == want and len(want) >= 20
    assert written["neardup-candidates"] <= 3 * len(want)


def test_extended_keys_keep_pairs_of_small_sets(spark):
    """Sets of three words that share just two keep meeting where their pair of words is extended."""
    texts = [f"a b x{i}" for i in range(4)] + [f"x{i} p{i}{j} q{i}{j}" for i in range(4) for j in range(5)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    near = NearDuplicates(spark, spark.createDataFrame(rows, ITEM), 1, (1, 2), 1, rare=0, hot=2)
    want = brute(rows, 1, 1, 2, 1)
    assert len(want) == 6 and {(x.id_a, x.id_b) for x in near.pairs().collect()} == want
