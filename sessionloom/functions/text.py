"""White space, tokens, words and id normalisation as JVM-side column expressions.

The character class is the Unicode property White_Space, spelled out so that Java, RE2 and Python
regular expressions agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, as classes for Python and for Java or RE2.
PY_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS_CLASS = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
TOKEN_RE = f"[^{WS_CLASS}]+"
WORD_RE = "[\\p{L}\\p{N}]+"


def token_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space; null for null."""
    return F.regexp_count(text, F.lit(TOKEN_RE))


def is_blank(text: Column) -> Column:
    """True for null and for text without any token."""
    return ~F.coalesce(text.rlike(f"[^{WS_CLASS}]"), F.lit(False))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def norm_id(text: Column) -> Column:
    """Ids and paths compare without outer white space and letter case; null stays null."""
    return F.lower(trim_ws(text))


def words(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)), lambda w: F.lower(w))
