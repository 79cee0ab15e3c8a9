"""Literal search over raw session lines, without any index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def excerpt(text: Column, query: str, whole: int = 2000, side: int = 999) -> Column:
    """Short lines as they are; of long ones the surroundings of the first match, marked with an ellipsis."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(at - side, F.lit(1))
    end = F.least(start + 2 * side, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= whole, text).otherwise(cut)


def short_excerpt(text: Column, most: int) -> Column:
    """White space collapsed; cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def _text_member(json: Column, path: str) -> Column:
    """The member if it is a string; null otherwise."""
    return F.when(F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "STRING", F.try_variant_get(json, path, "string"))


def _placed(lines: DataFrame, query: str, ignored: DataFrame | None) -> DataFrame:
    """(path, line, text, hit, bad, entry_id, origin) of matching lines and possible headers, the only ones that are parsed."""
    if not query.strip():
        raise ValueError("the query is blank")
    files = lines if ignored is None else lines.join(ignored.select("path").distinct(), "path", "left_anti")
    hit = F.contains(F.lower("text"), F.lit(query.strip().lower()))
    useful = files.select("path", "line", "text", hit.alias("hit")).where(F.col("hit") | F.contains("text", F.lit('"session"')))
    parsed = useful.withColumn("json", F.try_parse_json("text"))
    head = F.when(_text_member(F.col("json"), "$.type") == "session", F.coalesce(_text_member(F.col("json"), "$.cwd"), F.lit("")))
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return parsed.select(
        "path", "line", "text", "hit", F.col("json").isNull().alias("bad"), _text_member(F.col("json"), "$.id").alias("entry_id"),
        F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")).alias("origin"))


def source_search(lines: DataFrame, query: str, limit: int, ignored: DataFrame | None = None, origins: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """(path, line, entry_id, origin, excerpt) of the first ``limit`` matching lines by path and line.

    ``lines``: path, line, text. Matching ignores case. The origin is the cwd of the last header at or before
    the line, empty before the first and after a header without one; with ``project``, ``origins`` (origin,
    project_identity) limits matches to it. A file with a matching line or a possible header that is no JSON
    gives no matches and is reported by ``source_failures``. A blank query is an error.
    """
    if limit < 1:
        raise ValueError("a positive limit is needed")
    placed = _placed(lines, query, ignored)
    found = placed.where("hit").join(placed.where("bad").select("path").distinct(), "path", "left_anti")
    if project is not None:
        found = found.join(origins.where(F.col("project_identity") == project).select("origin").distinct(), "origin", "left_semi")
    return found.select("path", "line", "entry_id", "origin", excerpt(F.col("text"), query.strip()).alias("excerpt")).orderBy("path", "line").limit(limit)


def source_failures(lines: DataFrame, query: str, ignored: DataFrame | None = None) -> DataFrame:
    """(path, line, error) of files that a search leaves out: the first line that had to be read and is no JSON."""
    bad = _placed(lines, query, ignored).where("bad").groupBy("path").agg(F.min("line").alias("line"))
    return bad.select("path", "line", F.concat(F.lit("Source session unreadable at "), "path", F.lit(": no JSON")).alias("error"))
