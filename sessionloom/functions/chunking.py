"""Chunk geometry of text runs: token limits, natural boundaries, overlap, turn contexts and stable ids.

Character offsets are UTF-16 code units of the trimmed run, lines count from 1, token offsets are
logical: the intersection of neighbouring spans is their overlap.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

SCHEMA_VERSION = 8
# What the session format's own runtime treats as white space when trimming.
TRIM = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_LINE = r"[^\n\r\u2028\u2029]"
_HEADING = re.compile(rf"(?:(?<=[\n\r\u2028\u2029])|\A)#{{1,6}}[ \t]+")
_BLANK = re.compile(r"\n[ \t]*\n+")
_FENCE = re.compile(rf"(?:(?<=[\n\r\u2028\u2029])|\A)(?:```|~~~){_LINE}*")
_NEWLINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?][\"')\]]*(?=[ \t])")

Count = Callable[[str], int]


def whitespace_tokens(text: str) -> int:
    """The default tokenizer: runs between white space."""
    return len(text.split())


@dataclass(frozen=True)
class ChunkPolicy:
    max_tokens: int = 512
    overlap_tokens: int = 64

    def __post_init__(self):
        if not 1 <= self.max_tokens <= 1024 or not 0 <= self.overlap_tokens <= 128 or self.overlap_tokens >= self.max_tokens:
            raise ValueError("chunk policy needs 1 <= max_tokens <= 1024 and 0 <= overlap_tokens <= 128 below max_tokens")


@dataclass(frozen=True)
class Span:
    char_start: int
    char_end: int
    token_start: int
    token_end: int
    n_tokens: int
    overlap_tokens: int
    content: str


def utf16(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "\uffff" for c in text)


def _fits(text: str, start: int, end: int, count: Count, most: int) -> bool:
    return count(text[start:end].strip(TRIM)) <= most


def hard_end(text: str, start: int, count: Count, most: int) -> int:
    """Farthest end of a slice with at most ``most`` tokens: doubling steps, then bisection."""
    n, good, step = len(text), start, 1
    bad = n + 1
    while good < n:
        probe = min(start + step, n)
        if not _fits(text, start, probe, count, most):
            bad = probe
            break
        good, step = probe, step * 2
    while bad - good > 1 and good < n:
        mid = (good + bad) // 2
        if _fits(text, start, mid, count, most):
            good = mid
        else:
            bad = mid
    if good == start:
        raise ValueError(f"one character does not fit within {most} tokens")
    return good


def natural_end(text: str, start: int, hard: int) -> int:
    """The last boundary of the best kind in the second half of a slice, else its hard end."""
    part, low = text[start:hard], (hard - start) // 2
    kinds = [(_HEADING, re.Match.start), (_BLANK, re.Match.end), (_FENCE, re.Match.end), (_NEWLINE, re.Match.end), (_SENTENCE, re.Match.end)]
    for pattern, edge in kinds:
        found = [e for m in pattern.finditer(part) if (e := edge(m)) > low]
        if found:
            return start + found[-1]
    return hard


def overlap_start(text: str, start: int, end: int, count: Count, overlap: int) -> int:
    """Start of the longest suffix of a chunk with at most ``overlap`` tokens, white space skipped."""
    if not overlap:
        return end
    at = start + bisect.bisect_left(range(start, end), True, key=lambda i: _fits(text, i, end, count, overlap))
    return end - len(text[at:end].lstrip(TRIM))


def chunk_text(text: str, count: Count = whitespace_tokens, policy: ChunkPolicy | None = None, max_tokens: int | None = None, overlap: int | None = None) -> list[Span]:
    """Ordered spans of a run; empty for blank text."""
    policy = policy or ChunkPolicy()
    most, share = max_tokens or policy.max_tokens, policy.overlap_tokens if overlap is None else overlap
    spans: list[Span] = []
    at, token_end, shared = 0, 0, 0
    units = None if text.isascii() else utf16
    offset = lambda i: i if units is None else units(text[:i])
    while at < len(text):
        hard = hard_end(text, at, count, most)
        end = hard if hard == len(text) else natural_end(text, at, hard)
        body = text[at:end].strip(TRIM)
        if body:
            first = at + len(text[at:end]) - len(text[at:end].lstrip(TRIM))
            n, token_start = count(body), max(0, token_end - shared)
            spans.append(Span(offset(first), offset(first + len(body)), token_start, token_start + n, n, shared, body))
            token_end = token_start + n
            last = first + len(body)
            nxt = overlap_start(text, first, last, count, share) if end < len(text) else end
            nxt = nxt if nxt > at else end
            shared = count(text[nxt:last].strip(TRIM)) if nxt < last else 0
        else:
            nxt, shared = end, 0
        at = max(nxt, at + 1) if end < len(text) else len(text)
    return spans


def turn_text(user: str, assistant: str) -> str:
    return f"User:\n{user}\n\nAssistant:\n{assistant}"


def turn_texts(user: str, assistant: str, count: Count, most: int) -> list[str]:
    """A turn as one framed text, or as pairs of segments that each fit.

    Both roles share what the frame leaves; a role that needs less gives the rest to the other. While a
    pair is too long the larger budget shrinks by one.
    """
    whole = turn_text(user, assistant)
    if count(whole) <= most:
        return [whole]
    room = most - count(turn_text("", ""))
    if room < 2:
        raise ValueError(f"user and assistant text do not fit within {most} tokens")
    n_user, n_assistant = count(user), count(assistant)
    if n_user < room:
        a = max(1, n_user)
        budget = [a, room - a]
    elif n_assistant < room:
        b = max(1, n_assistant)
        budget = [room - b, b]
    else:
        budget = [room // 2, room - room // 2]
    while True:
        parts = [[s.content for s in chunk_text(t, count, max_tokens=b, overlap=0)] for t, b in zip((user, assistant), budget)]
        if not all(parts):
            raise ValueError("a turn needs text of both roles")
        n = max(map(len, parts))
        texts = [turn_text(*(p[min(len(p) - 1, i * len(p) // n)] for p in parts)) for i in range(n)]
        if all(count(t) <= most for t in texts):
            return texts
        larger = 0 if budget[0] >= budget[1] else 1
        larger = larger if budget[larger] > 1 else 1 - larger
        if budget[larger] <= 1:
            raise ValueError(f"user and assistant text do not fit within {most} tokens")
        budget[larger] -= 1


def _id(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def text_run_id(logical: str, entry: str, contributing: list[str], kind: str, part: str, run: int) -> str:
    return _id(SCHEMA_VERSION, logical, entry, "\0".join(contributing), kind, part, run)[:40]


def chunk_id(run_id: str, char_start: int, char_end: int) -> str:
    return _id(SCHEMA_VERSION, run_id, char_start, char_end)[:40]


def projection_input(logical: str, entry: str, contributing: list[str], document_kind: str, kind: str, part: str, run: int, policy: ChunkPolicy, text: str) -> tuple[str, str]:
    """(id, checksum) under which a run's geometry may be reused."""
    key = _id("conversation-projection-input-v1", SCHEMA_VERSION, logical, entry, "\0".join(contributing), document_kind, kind, part, run)[:40]
    return key, _id("conversation-projection-input-content-v1", policy.max_tokens, policy.overlap_tokens, text)


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def text_runs(content: object) -> list[tuple[str, int, int | None, int | None]]:
    """(text, run, first block, last block): a string's trimmed text, or maximal runs of adjacent text blocks."""
    if isinstance(content, str):
        text = content.strip(TRIM)
        return [(text, 0, None, None)] if text else []
    runs: list[list[tuple[int, str]]] = [[]]
    for i, block in enumerate(content if isinstance(content, list) else []):
        text = block.get("text") if isinstance(block, dict) and block.get("type") == "text" else None
        if isinstance(text, str) and text.strip(TRIM):
            runs[-1].append((i, text))
        elif runs[-1]:
            runs.append([])
    return [("\n".join(t for _, t in r).strip(TRIM), k, r[0][0], r[-1][0]) for k, r in enumerate(r for r in runs if r)]
