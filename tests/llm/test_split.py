import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import split

ITEM = "item long, text string, max_tokens int, overlap_tokens int, piece string"


def spans(text):
    s = [m.span() for m in split._TOKEN.finditer(text)]
    return np.array([a for a, _ in s]), np.array([b for _, b in s])


def greedy(text, most, overlap):
    """The cuts one after another, straight from the rule."""
    starts, ends = spans(text)
    n, kinds, cut, cuts = len(starts), split.boundary_kinds(text, starts, ends), 0, []
    while cut < n:
        start = max(cut - overlap, 0)
        hard = min(start + most, n)
        nxt = hard
        if hard < n:
            low = max(start + (hard - start) // 2, start + overlap)
            for k in range(5):
                fit = [p for p in range(low + 1, hard + 1) if kinds[p] == k]
                if fit:
                    nxt = fit[-1]
                    break
        cuts.append(nxt)
        cut = nxt
    return cuts


words = st.sampled_from(["a", "bc", "done.", "# ", "\n", "\n\n", "```\n", "\n```", "\n## ", " ", " ", "。", "'x?' "])


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=120), st.integers(1, 12), st.integers(0, 11))
def test_doubling_equals_greedy(parts, most, overlap):
    text = " ".join(parts)
    overlap = min(overlap, most - 1)
    starts, ends = spans(text)
    if len(starts) <= most:
        return
    table = split.successors(split.boundary_kinds(text, starts, ends), most, overlap)
    assert np.flatnonzero(split.reached(table, np.array([0])))[1:].tolist() == greedy(text, most, overlap)


def test_natural_boundaries(spark):
    body = "one two three four five. six seven\nline eight nine\n\npara ten eleven\n```\ncode here\n```\nafter it\n# Head\nlast words of it"
    starts, ends = spans(body)
    kinds = split.boundary_kinds(body, starts, ends)
    named = {body[s:e]: split.KINDS[kinds[p]] for p, (s, e) in enumerate(zip(starts, ends))}
    assert named["six"] == "sentence" and named["line"] == "line" and named["para"] == "paragraph"
    assert named["after"] == "fence" and named["#"] == "heading" and named["two"] == "token" and named["code"] == "line"


def test_sentence_ends_behind_any_number_of_closing_marks():
    text = "one two" + "." + "')]" * 40 + " three four."
    starts, ends = spans(text)
    assert [split.KINDS[k] for k in split.boundary_kinds(text, starts, ends)[1:4]] == ["token", "sentence", "token"]


def test_pieces_cover_whole_text(spark):
    long = " ".join(f"w{i}." if i % 7 == 0 else f"w{i}" for i in range(5000)) + "  \n"
    rows = [(1, long, 40, 8, "clash"), (1, long, 40, 8, "clash"), (2, "short text", 40, 8, None), (3, None, 40, 8, None), (4, "  ", 1, 0, None), (5, "a b c", 2, 9, None),
            (6, long, None, 3, None), (7, long, 0, 3, None), (8, "x" * 100_000, 5, 1, None), (9, "p q r s", 2, None, None)]
    got = split.split_oversized(spark.createDataFrame(rows, ITEM)).collect()
    assert {r.item for r in got} == {1, 5, 9}
    one = sorted((r for r in got if r.item == 1), key=lambda r: (r.piece_no, r.char_start))[::2]
    assert len([r for r in got if r.item == 1]) == 2 * one[0].n_pieces
    text, end = "", 0
    for r in one:
        assert r.char_start <= end and r.token_end - r.token_start <= 40 and (r.piece_no == 0 or r.overlap <= 8)
        assert r.piece == long[r.char_start:r.char_end]
        text, end = text + long[end:r.char_end], r.char_end
    assert text == long


def test_empty(spark):
    assert split.split_oversized(spark.createDataFrame([], ITEM)).collect() == []
