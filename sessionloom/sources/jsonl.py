"""Reading session logs: recursive listing, byte framing, format detection and conversion to canonical records.

A file is the unit of import: one bad line rejects the file, which becomes a row of the failures table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import TRIM
from ..functions.invocations import json_text

RECORDS = "session_path string, format string, session_no int, session_id string, line int, record_json string, error string"


def list_sessions(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, size, mtime) of all .jsonl files below root, contents unread; a missing root is empty."""
    if "://" not in root and not os.path.isdir(root):
        schema = "path string, size long, mtime timestamp" + (", content binary" if with_content else "")
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []))


def source_identity(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files read with content."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def frame_lines(files: DataFrame) -> DataFrame:
    """(path, line, text): records end at LF only; one CR before an LF is dropped; an unterminated rest is a record."""
    text = F.decode("content", "UTF-8")
    parts = files.select("path", F.posexplode(F.split(text, "\n")).alias("p", "text"), F.size(F.split(text, "\n")).alias("n"))
    ended = F.col("p") < F.col("n") - 1
    return parts.where(ended | (F.length("text") > 0)).select(
        "path", (F.col("p") + 1).alias("line"), F.when(ended, F.regexp_replace("text", "\r$", "")).otherwise(F.col("text")).alias("text"))


class Rejected(ValueError):
    """The file is no session log."""


def parse_lines(content: bytes) -> list[tuple[int, dict]]:
    """(line, record) of all non-blank lines; raises on the first that is no object with a string type."""
    out = []
    parts = content.split(b"\n")
    for i, raw in enumerate(parts, 1):
        if i == len(parts) and not raw:
            continue
        raw = raw.removesuffix(b"\r") if i < len(parts) else raw
        try:
            text = raw.decode("utf-8")
            if not text.strip(TRIM):
                continue
            record = json.loads(text)
        except ValueError as e:
            raise Rejected(f"line {i}: {e}") from None
        if not isinstance(record, dict) or not isinstance(record.get("type"), str):
            raise Rejected(f"line {i}: no object with a type")
        out.append((i, record))
    if not out:
        raise Rejected("no records")
    return out


def _filled(record: dict, name: str) -> bool:
    return isinstance(record.get(name), str) and bool(record[name])


def _is_header(record: dict) -> bool:
    return record["type"] == "session" and _filled(record, "id") and _filled(record, "timestamp") and isinstance(record.get("cwd"), str)


def _has_version(record: dict) -> bool:
    return record.get("version") in (2, 3) and not isinstance(record.get("version"), bool)


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_whole(value: object) -> bool:
    return _is_number(value) and float(value).is_integer()


# What a message of each role of the oldest format must hold beside role and numeric timestamp: (test, members).
_LINEAR_MESSAGE = {
    "user": [(lambda m, k: k in m, ["content"])],
    "assistant": [(lambda m, k: isinstance(m.get(k), list), ["content"]), (_filled, ["api", "provider", "model", "stopReason"]), (lambda m, k: isinstance(m.get(k), dict), ["usage"])],
    "toolResult": [(lambda m, k: isinstance(m.get(k), list), ["content"]), (_filled, ["toolCallId", "toolName"]), (lambda m, k: isinstance(m.get(k), bool), ["isError"])],
    "bashExecution": [(lambda m, k: isinstance(m.get(k), str), ["command", "output"]), (lambda m, k: isinstance(m.get(k), bool), ["cancelled", "truncated"])],
}
_LINEAR_ENTRY = {
    "model_change": [(_filled, ["provider", "modelId"])],
    "thinking_level_change": [(_filled, ["thinkingLevel"])],
    "compaction": [(lambda r, k: isinstance(r.get(k), str), ["summary"]), (lambda r, k: _is_whole(r.get(k)), ["firstKeptEntryIndex"]), (lambda r, k: _is_number(r.get(k)), ["tokensBefore"])],
}


def _holds(record: dict, tests: list | None) -> bool:
    return tests is not None and all(test(record, k) for test, names in tests for k in names)


def _is_linear_entry(record: dict) -> bool:
    """An entry of the oldest format: dated, without id or parent, of a type it knows and with what that type needs."""
    if "id" in record or "parentId" in record or not _filled(record, "timestamp"):
        return False
    if record["type"] != "message":
        return _holds(record, _LINEAR_ENTRY.get(record["type"]))
    m = record.get("message")
    return isinstance(m, dict) and _filled(m, "role") and _is_number(m.get("timestamp")) and _holds(m, _LINEAR_MESSAGE.get(m["role"]))


def linear_to_canonical(records: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    """Give entries of a linear file ids from their content, a parent (the entry before), and the header version 2."""
    (line, header), rest = records[0], records[1:]
    ids = [hashlib.sha256(f"pi-v1-entry-v1\0{header['id']}\0{n}\0{json_text(r)}".encode("utf-8", "surrogatepass")).hexdigest()[:40] for n, r in rest]
    if len(set(ids)) < len(ids):
        raise Rejected("two entries with one id")
    out = [(line, header | {"version": 2})]
    for i, (n, r) in enumerate(rest):
        new = dict(r) | {"id": ids[i], "parentId": ids[i - 1] if i else None}
        if r["type"] == "compaction":
            kept = int(new.pop("firstKeptEntryIndex")) - 1
            if not 0 <= kept < len(ids):
                raise Rejected(f"line {n}: kept entry out of range")
            new["firstKeptEntryId"] = ids[kept]
        out.append((n, new))
    return out


def import_file(content: bytes) -> tuple[str, list[list[tuple[int, dict]]]]:
    """(format, logical sessions) of one file, or Rejected."""
    records = parse_lines(content)
    heads = [i for i, (_, r) in enumerate(records) if r["type"] == "session"]
    if len(heads) > 1:
        parts = [records[a:b] for a, b in zip(heads, [*heads[1:], len(records)])]
        if heads[0] or any(len(p) < 2 or not _is_header(p[0][1]) or not _has_version(p[0][1]) for p in parts):
            raise Rejected("several headers, but no reuse history")
        return "reuse_history", parts
    first = records[0][1]
    if _is_header(first) and "version" not in first and len(records) > 1 and all(_is_linear_entry(r) for _, r in records[1:]):
        return "linear", [linear_to_canonical(records)]
    if _is_header(first) and _has_version(first):
        return "canonical", [records]
    raise Rejected("no complete leading header")


def _import_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, content in zip(frame["path"].tolist(), frame["content"].tolist()):
            try:
                form, sessions = import_file(bytes(content))
                out.extend((path, form, k, s[0][1]["id"], n, json_text(r), None) for k, s in enumerate(sessions) for n, r in s)
            except Rejected as e:
                out.append((path, None, None, None, None, None, str(e)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"session_no": "Int32", "line": "Int32"})


def import_sessions(files: DataFrame) -> DataFrame:
    """Canonical records of all files (path, content), and one row with ``error`` for each rejected file."""
    return files.select("path", "content").mapInPandas(_import_frames, RECORDS)
