import random

from sessionloom.llm import truncation

DOC = "doc_id long, text string, source string, verdict string"
NOUNS = ["harbour", "lantern", "meadow", "quarry", "ribbon", "saddle", "timber", "valley"]
VERBS = ["follows", "carries", "repairs", "watches", "gathers"]


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} before the {r.choice(NOUNS)} near {r.randrange(90)} miles."


def corpus(seed, n=260):
    r = random.Random(seed)
    return r, [(i, " ".join(sentence(r) for _ in range(r.randrange(2, 6))), "whole", "x") for i in range(n)]


def test_cuts_and_whole_texts(spark):
    r, rows = corpus(1)
    cut = {1000: "before the", 1001: "The lantern carr", 1002: "near 12 miles. The quarry follows the", 1003: "The ribbon…", 1004: "x\n```\ncode = 1", 1005: "The saddle watches the mead�"}
    rows += [(k, " ".join(sentence(r) for _ in range(3)) + " " + t, "cut", "x") for k, t in cut.items()]
    rows += [(2000 + k, rows[k][1] + "\n```\ncode = 1\n```", "whole", "x") for k in range(5)]
    rows += [(3000 + k, rows[k][1] + " More on that later…", "whole", "x") for k in range(8)]
    rows += [(4000, rows[260][1], "cut", "x"), (5000, None, "null", "x"), (5001, "", None, "x"), (5002, " \xa0\n", None, "x")]
    df = spark.createDataFrame(rows, DOC)
    got = {x.doc_id: x.verdict for x in truncation.judge(spark, df).collect()}
    assert {k for k, v in got.items() if v != "whole"} == {*cut, 4000}
    assert got[1004] == "fence" and got[1005] == "character" and got[1001] == "word" and not {5000, 5001, 5002} & set(got)
    share = {x.source: (x.documents, x.cut) for x in truncation.by_source(spark, df).collect()}
    assert share["cut"] == (7, 7) and share["null"] == (1, 0) and share[None] == (2, 0) and share["whole"][1] == 0


def test_words_of_any_length_are_found_by_trigrams(spark):
    """A cut inside a word far longer than any field label, and one that other texts are cut at, too."""
    r = random.Random(4)
    long_word = "".join(r.choice("abcdefgh") for _ in range(600))
    rows = [(i, f"{sentence(r)} The reader keeps {long_word} for later use.", "s", "x") for i in range(40)]
    rows += [(100 + k, f"{sentence(r)} The reader keeps {long_word[:n]}", "s", "x") for k, n in enumerate((1, 50, 599))]
    got = {x.doc_id: (x.verdict, x.rule) for x in truncation.judge(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert {k: v for k, v in got.items() if v[0] != "whole"} == {k: ("word", "trigram") for k in (100, 101, 102)}


def test_tables_and_json_lines(spark):
    r, rows = corpus(2, 60)
    table = lambda k: "\n".join(f"| {r.choice(NOUNS)} | {r.randrange(99)} | {r.choice(NOUNS)} {r.choice(NOUNS)} |" for _ in range(k))
    rows += [(100 + k, table(6), "t", "x") for k in range(40)] + [(200, table(4) + "\n| harbour | 12 | timb", "t", "x"), (201, table(4) + "\n| harbour | 12", "t", "x")]
    item = lambda: f'{{"file": "a/{r.choice(NOUNS)}.ts", "note": "{sentence(r)}"}}'
    rows += [(300 + k, f"[{item()}, {item()}, {item()}]", "j", "x") for k in range(40)] + [(400, f'[{item()}, {{"file": "a/x.ts", "note": "The harbour carries the', "j", "x")]
    got = {x.doc_id for x in truncation.judge(spark, spark.createDataFrame(rows, DOC)).collect() if x.verdict != "whole"}
    assert got == {200, 201, 400}


def test_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert truncation.judge(spark, none).collect() == [] and truncation.by_source(spark, none).collect() == []
