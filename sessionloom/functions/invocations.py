"""Compact, searchable text of tool calls and shell executions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

# Argument names whose payload is left out of the searchable text.
PAYLOAD_NAMES = {"code", "data", "image", "images", "instructions", "output", "prompts", "scripts", "stderr", "stdout", "task", "text"}
PAYLOAD_ENDINGS = ("body", "content", "filebody", "filecontent", "newtext", "oldtext", "prompt", "replacement", "replacementtext", "script")
SCALAR_LIMIT, TEXT_LIMIT = 1024, 4096


def is_payload(name: str) -> bool:
    """Whether an argument of this name is omitted; compared without case and punctuation."""
    plain = re.sub("[^a-z0-9]", "", name.lower())
    return plain != "querytext" and (plain in PAYLOAD_NAMES or plain.endswith(PAYLOAD_ENDINGS))


def number_text(value: float) -> str:
    """A JSON number as the session format writes it."""
    if isinstance(value, int) and abs(value) < 1 << 53:
        return str(value)
    v = float(value)
    if v != v or v in (float("inf"), float("-inf")):
        return "null"
    sign, digits, point = Decimal(repr(v)).normalize().as_tuple()
    text, e = "".join(map(str, digits)), len(digits) + point - 1
    if not v:
        return "0"
    if 0 <= e < 21:
        whole, rest = text[:e + 1].ljust(e + 1, "0"), text[e + 1:]
        text = whole + ("." + rest if rest else "")
    elif -7 < e < 0:
        text = "0." + "0" * (-e - 1) + text
    else:
        text = text[0] + ("." + text[1:] if text[1:] else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if sign else "") + text


def json_text(value: object) -> str:
    """Compact JSON with members in their given order."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    return "{" + ",".join(f"{json_text(k)}:{json_text(v)}" for k, v in value.items()) + "}"


def flatten(arguments: object) -> Iterator[tuple[str, str | None]]:
    """(path, JSON scalar) in name order; None marks an omitted payload. Array elements go by their array's name, top-level ones by their index."""
    stack: list[tuple[str, str, object]] = []
    if isinstance(arguments, dict):
        stack.append(("", "", arguments))
    elif isinstance(arguments, list):
        stack.extend((f"[{i}]", str(i), arguments[i]) for i in range(len(arguments) - 1, -1, -1))
    while stack:
        path, name, value = stack.pop()
        if name and is_payload(name):
            yield path, None
        elif isinstance(value, dict):
            for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"), reverse=True):
                stack.append((f"{path}.{k}" if path else k, k, value[k]))
        elif isinstance(value, list):
            for i in range(len(value) - 1, -1, -1):
                stack.append((f"{path}[{i}]", name, value[i]))
        else:
            yield path, json_text(value[:SCALAR_LIMIT] if isinstance(value, str) else value)


def _bounded(lines: list[str]) -> list[str]:
    """Lines that fit the text limit; one that does not is skipped, later ones may still fit."""
    out, used = [], -1
    for line in lines:
        if used + 1 + len(line) <= TEXT_LIMIT:
            out.append(line)
            used += 1 + len(line)
    return out


def searchable_text(tool: str, arguments: object) -> str:
    """Tool name (quoted, bounded like a scalar), omission marks, then locators; each list and the whole are bounded."""
    kept, left = [], []
    for path, value in flatten(arguments):
        (left if value is None else kept).append(f"{path}={'<omitted>' if value is None else value}")
    return "\n".join(_bounded([f"tool={json_text(tool[:SCALAR_LIMIT])}", *_bounded(left), *_bounded(kept)]))


def shell_error(message: dict) -> bool | None:
    if message.get("cancelled") is True:
        return True
    code = message.get("exitCode")
    return code != 0 if isinstance(code, (int, float)) and not isinstance(code, bool) else None


def invocations(entries: list[dict], own_tools: frozenset[str] = frozenset()) -> list[dict]:
    """Records of one session's entries ({id, timestamp, line, record}): tool calls and shell executions.

    A call's error flag comes from the last result with its id. Calls with a blank id or name and calls of
    ``own_tools`` (the search tool itself, whose queries would only find themselves) are left out.
    """
    errors: dict[str, bool | None] = {}
    for e in entries:
        m = e["record"].get("message")
        if isinstance(m, dict) and m.get("role") == "toolResult" and isinstance(m.get("toolCallId"), str):
            errors[m["toolCallId"]] = m.get("isError") if isinstance(m.get("isError"), bool) else None
    out = []
    for e in entries:
        m = e["record"].get("message")
        if not isinstance(m, dict):
            continue
        base = {"entry_id": e["id"], "line": e["line"], "timestamp": e["timestamp"]}
        if m.get("role") == "bashExecution" and isinstance(m.get("command"), str):
            out.append(base | {"kind": "bash_execution", "tool_name": "bash", "tool_call_id": None, "block": None, "is_error": shell_error(m), "text": searchable_text("bash", {"command": m["command"]})})
        elif m.get("role") == "assistant" and isinstance(m.get("content"), list):
            for i, b in enumerate(m["content"]):
                if isinstance(b, dict) and b.get("type") == "toolCall" and isinstance(b.get("id"), str) and isinstance(b.get("name"), str) and b["id"] and b["name"] and b["name"] not in own_tools:
                    out.append(base | {"kind": "tool_call", "tool_name": b["name"], "tool_call_id": b["id"], "block": i, "is_error": errors.get(b["id"]), "text": searchable_text(b["name"], b.get("arguments"))})
    return out
