"""From canonical session records to validated graphs, dense documents and invocations.

One logical session is one group: its records are walked in Python because paths, contexts and turn
contexts follow links of unknown depth. A session that breaks a rule gives one error row and nothing else.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions.invocations import invocations
from .forest import whole_groups

DOCUMENT = (
    "session_path string, session_id string, id string, checksum string, schema_version int, document_kind string, summary_kind string, evidence_kind string, "
    "evidence_part string, is_dense_searchable boolean, parent_session_path string, cwd string, session_name string, entry_id string, parent_entry_id string, "
    "child_entry_ids array<string>, contributing_entry_ids array<string>, current_leaf_id string, branch_path_leaf_ids array<string>, is_active boolean, "
    "is_visible boolean, compacted_by array<string>, compaction_first_kept string, branch_from string, role string, timestamp string, line_start int, line_end int, "
    "block_start int, block_end int, char_start int, char_end int, token_start int, token_end int, n_tokens int, overlap_tokens int, text_run_id string, "
    "text_run_index int, chunk_index int, chunk_count int, sibling_ids array<string>, previous_sibling_id string, next_sibling_id string, tool_call_id string, "
    "tool_name string, tool_call_entry_id string, tool_result_entry_id string, tool_error boolean, content string, projection_input_id string, input_checksum string, error string"
)
COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]
ENTRY = (
    "session_path string, session_no int, session_id string, entry_id string, parent_id string, depth int, child_ids array<string>, is_active boolean, is_visible boolean, "
    "leaf_ids array<string>, compacted_by array<string>, line int, record_type string, error string"
)
INVOCATION = "session_path string, session_id string, cwd string, kind string, tool_name string, tool_call_id string, entry_id string, line int, block int, timestamp string, is_error boolean, text string"


class Invalid(ValueError):
    """The session breaks a rule of the format."""


def _text(record: dict, name: str) -> str:
    value = record.get(name)
    if not isinstance(value, str) or not value:
        raise Invalid(f"{name} must be a non-empty string")
    return value


class Graph:
    """A validated session: header, entries in file order, links and derived sets."""

    def __init__(self, records: list[tuple[int, dict]]):
        heads = [r for _, r in records if r["type"] == "session"]
        if len(heads) != 1 or records[0][1]["type"] != "session":
            raise Invalid("exactly one leading header is needed")
        self.header, self.session_line = heads[0], records[0][0]
        self.entries = [{"id": _text(r, "id"), "parent": r.get("parentId"), "timestamp": _text(r, "timestamp"), "line": n, "record": r} for n, r in records if r["type"] not in ("session", "leaf")]
        self.at = {e["id"]: e for e in self.entries}
        if len(self.at) < len(self.entries):
            raise Invalid("an entry id occurs twice")
        self.children: dict[str, list[str]] = {e["id"]: [] for e in self.entries}
        for e in self.entries:
            if e["parent"] is not None and e["parent"] not in self.at:
                raise Invalid(f"parent of {e['id']} does not exist")
            if e["parent"] is not None:
                self.children[e["parent"]].append(e["id"])
        self._check_cycles()
        leaves = [r for _, r in records if r["type"] == "leaf"]
        self.leaf = leaves[-1].get("targetId") if leaves else self.entries[-1]["id"] if self.entries else None
        if self.leaf and self.leaf not in self.at:
            raise Invalid("current leaf does not exist")
        names = [e["record"].get("name") for e in self.entries if e["record"]["type"] == "session_info" and isinstance(e["record"].get("name"), str)]
        self.name = names[-1].strip(ck.TRIM) if names else ""
        self._check_links()
        self._check_tools()
        active = self.path(self.leaf) if self.leaf else []
        self.active = set(active)
        self.visible = set(self._context(active))
        self.compacted = self._compactions()
        self.leaves_of = self._leaf_membership()

    def _check_cycles(self) -> None:
        """Depth of every entry; an entry met again on its own way up closes a cycle."""
        self.depth: dict[str, int] = {}
        for e in self.entries:
            trail, at = [], e["id"]
            seen: set[str] = set()
            while at is not None and at not in self.depth:
                if at in seen:
                    raise Invalid("links form a cycle")
                seen.add(at)
                trail.append(at)
                at = self.at[at]["parent"]
            base = -1 if at is None else self.depth[at]
            for k, i in enumerate(reversed(trail), 1):
                self.depth[i] = base + k
        # numbers of one depth-first walk: b lies below a if its number falls into a's range
        self.enter: dict[str, int] = {}
        self.leave: dict[str, int] = {}
        open_entries = [e["id"] for e in reversed(self.entries) if e["parent"] is None]
        order = []
        while open_entries:
            at = open_entries.pop()
            self.enter[at] = len(order)
            order.append(at)
            open_entries.extend(reversed(self.children[at]))
        for at in reversed(order):
            self.leave[at] = max([self.enter[at], *(self.leave[c] for c in self.children[at])])

    def above(self, a: str, b: str) -> bool:
        """Whether a is a proper ancestor of b."""
        return a != b and self.enter[a] <= self.enter[b] <= self.leave[a]

    def path(self, entry: str) -> list[str]:
        """Ids from the root to an entry."""
        out = []
        while entry is not None:
            out.append(entry)
            entry = self.at[entry]["parent"]
        return out[::-1]

    def _check_links(self) -> None:
        for e in self.entries:
            r = e["record"]
            if r["type"] == "compaction" and not isinstance(r.get("retainedTail"), list) and not ((kept := _text(r, "firstKeptEntryId")) in self.at and self.above(kept, e["id"])):
                raise Invalid(f"compaction {e['id']} keeps no ancestor")
            if r["type"] == "branch_summary" and r.get("fromId") != "root" and r.get("fromId") not in self.at:
                raise Invalid(f"branch summary {e['id']} comes from nowhere")

    def _check_tools(self) -> None:
        calls, results = {}, set()
        for e in self.entries:
            m = e["record"].get("message")
            if not isinstance(m, dict):
                continue
            if m.get("role") == "assistant":
                for b in m.get("content") if isinstance(m.get("content"), list) else []:
                    if isinstance(b, dict) and b.get("type") == "toolCall" and (b.get("id"), b.get("name")) != ("", ""):
                        if _text(b, "id") in calls:
                            raise Invalid(f"tool call {b['id']} occurs twice")
                        calls[b["id"]] = _text(b, "name")
        for e in self.entries:
            m = e["record"].get("message")
            if isinstance(m, dict) and m.get("role") == "toolResult" and (m.get("toolCallId"), m.get("toolName")) != ("", ""):
                if calls.get(_text(m, "toolCallId")) != _text(m, "toolName") or m["toolCallId"] in results:
                    raise Invalid(f"tool result {m['toolCallId']} answers no call or one already answered")
                results.add(m["toolCallId"])

    def _context(self, path: list[str]) -> list[str]:
        last = max((i for i, e in enumerate(path) if self.at[e]["record"]["type"] == "compaction"), default=None)
        if last is None:
            return path
        r = self.at[path[last]]["record"]
        kept = [] if isinstance(r.get("retainedTail"), list) else path[path.index(r["firstKeptEntryId"]):last]
        return [*kept, *path[last:]]

    def _compactions(self) -> dict[str, list[str]]:
        """Entry -> compactions that leave it out, in file order: the path above the kept entry, or above the compaction itself."""
        out: dict[str, list[str]] = {}
        for e in self.entries:
            r = e["record"]
            if r["type"] == "compaction":
                at = self.at[e["id"] if isinstance(r.get("retainedTail"), list) else r["firstKeptEntryId"]]["parent"]
                while at is not None:
                    out.setdefault(at, []).append(e["id"])
                    at = self.at[at]["parent"]
        return out

    def _leaf_membership(self) -> dict[str, list[str]]:
        """Entry -> ends of the branches through it, in file order, the current leaf last if it is no end."""
        ends = [e["id"] for e in self.entries if not self.children[e["id"]]]
        if self.leaf and self.leaf not in ends:
            ends.append(self.leaf)
        out: dict[str, list[str]] = {e["id"]: [] for e in self.entries}
        for end in ends:
            at = end
            while at is not None:
                out[at].append(end)
                at = self.at[at]["parent"]
        return out

    def message(self, entry: dict) -> dict | None:
        m = entry["record"].get("message")
        return m if entry["record"]["type"] == "message" and isinstance(m, dict) else None

    def role_text(self, entry: dict, role: str) -> str:
        m = self.message(entry)
        return "\n\n".join(t for t, *_ in ck.text_runs(m.get("content"))) if m and m.get("role") == role else ""


def _pending(g: Graph) -> list[dict]:
    """Documents before chunking: entry documents, then turn contexts."""
    out = []
    for e in g.entries:
        r, m = e["record"], g.message(e)
        base = {"entry": e, "contributing": [e], "summary": None, "kind": "conversation", "evidence": "conversation", "kept": None, "branch": None}
        if m and m.get("role") in ("user", "assistant"):
            source, role = m.get("content"), m["role"]
        elif r["type"] == "custom_message" and r.get("display") is not False:
            source, role = r.get("content"), "custom"
        elif r["type"] in ("compaction", "branch_summary"):
            compaction = r["type"] == "compaction"
            source, role = r.get("summary") if isinstance(r.get("summary"), str) else "", "summary"
            base |= {"kind": "summary", "summary": "compaction" if compaction else "branch", "evidence": "compaction_summary" if compaction else "branch_summary", "kept": r.get("firstKeptEntryId") if compaction else None, "branch": None if compaction else r.get("fromId")}
        else:
            continue
        out += [base | {"role": role, "text": t, "run": k, "blocks": (a, b)} for t, k, a, b in ck.text_runs(source)]
    seen = set()
    for user in g.entries:
        text = g.role_text(user, "user")
        if not text:
            continue
        open_paths = deque((c, [user], []) for c in g.children[user["id"]])
        while open_paths:
            at, who, answers = open_paths.popleft()
            e = g.at[at]
            m = g.message(e)
            ended = bool(m) and m.get("role") == "user"
            if not ended and (answer := g.role_text(e, "assistant")):
                who, answers = [*who, e], [*answers, answer]
            key = tuple(x["id"] for x in who)
            if answers and key not in seen and (ended or at == g.leaf or not g.children[at]):
                seen.add(key)
                out.append({"entry": user, "contributing": who, "summary": None, "kind": "turn_context", "evidence": "turn_context", "kept": None, "branch": None, "role": "turn", "turn": (text, "\n\n".join(answers)), "run": 0, "blocks": (None, None)})
            if not ended:
                open_paths.extend((c, who, answers) for c in g.children[at])
    return out


Known = dict[tuple[str, str], list[ck.Span]]


def documents(session_path: str, logical: str, g: Graph, policy: ck.ChunkPolicy, count: ck.Count, known: Known | None = None) -> list[dict]:
    """All chunks of one session with full provenance.

    ``known`` holds the spans of earlier runs by (projection input, checksum of policy and text): what is found
    there is not tokenized again, while everything about the graph is made anew.
    """
    rows = []
    pending = []
    for p in _pending(g):
        if "turn" in p:
            pending += [p | {"text": t, "run": k} for k, t in enumerate(ck.turn_texts(*p["turn"], count, policy.max_tokens))]
        else:
            pending.append(p)
    for p in pending:
        e, ids = p["entry"], [x["id"] for x in p["contributing"]]
        key, check = ck.projection_input(logical, e["id"], ids, p["kind"], p["evidence"], "content", p["run"], policy, p["text"])
        spans = (known or {}).get((key, check)) or ck.chunk_text(p["text"], count, policy)
        run = ck.text_run_id(logical, e["id"], ids, p["evidence"], "content", p["run"])
        names = [ck.chunk_id(run, s.char_start, s.char_end) for s in spans]
        shared = [x for x in g.leaves_of[ids[0]] if all(x in g.leaves_of[i] for i in ids[1:])]
        for k, s in enumerate(spans):
            before, after = (names[k - 1] if k else None), (names[k + 1] if k + 1 < len(spans) else None)
            rows.append({
                "session_path": session_path, "session_id": g.header["id"], "id": names[k], "checksum": ck.checksum(s.content), "schema_version": ck.SCHEMA_VERSION, "document_kind": p["kind"],
                "summary_kind": p["summary"], "evidence_kind": p["evidence"], "evidence_part": "content", "is_dense_searchable": True, "parent_session_path": g.header.get("parentSession"), "cwd": g.header["cwd"],
                "session_name": g.name, "entry_id": e["id"], "parent_entry_id": e["parent"], "child_entry_ids": g.children[e["id"]], "contributing_entry_ids": ids, "current_leaf_id": g.leaf,
                "branch_path_leaf_ids": shared, "is_active": all(i in g.active for i in ids), "is_visible": all(i in g.visible for i in ids), "compacted_by": list(dict.fromkeys(c for i in ids for c in g.compacted.get(i, []))),
                "compaction_first_kept": p["kept"], "branch_from": p["branch"], "role": p["role"], "timestamp": e["timestamp"], "line_start": min(x["line"] for x in p["contributing"]), "line_end": max(x["line"] for x in p["contributing"]),
                "block_start": p["blocks"][0], "block_end": p["blocks"][1], "char_start": s.char_start, "char_end": s.char_end, "token_start": s.token_start, "token_end": s.token_end, "n_tokens": s.n_tokens,
                "overlap_tokens": s.overlap_tokens, "text_run_id": run, "text_run_index": p["run"], "chunk_index": k, "chunk_count": len(spans), "sibling_ids": [x for x in (before, after) if x],
                "previous_sibling_id": before, "next_sibling_id": after, "content": s.content, "projection_input_id": key, "input_checksum": check,
            })
    return rows


def _frame(rows: list[dict], names: list[str] = COLUMNS) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names).astype(object)
    return out.where(out.notna(), None)


def _each_session(records: DataFrame, rows_of: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """Rows of every logical session of valid files; sessions are co-located by one shuffle, and small ones share a frame."""
    names = [c.split()[0] for c in schema.split(", ")]

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, "part"):
            yield _frame([r for _, one in g.groupby("part", sort=False) for r in rows_of(one)], names)

    part = F.concat_ws("\0", "session_path", "session_no").alias("part")
    valid = records.where("error is null").select(part, "session_path", "session_no", "session_id", "format", "line", "record_json")
    return valid.repartition("part").sortWithinPartitions("part", "line").mapInPandas(frames, schema)


def _records(group: pd.DataFrame) -> list[tuple[int, dict]]:
    g = group.sort_values("line")
    return [(int(n), json.loads(t)) for n, t in zip(g["line"], g["record_json"])]


def project_graph(records: DataFrame) -> DataFrame:
    """One row per entry of every logical session of ``import_sessions``: links, depth, branches, current path, context, compactions.

    A session that breaks a rule gives one row with ``error``; a valid one without entries gives one row with
    null entry_id. Rejected files are left out.
    """
    def rows(group: pd.DataFrame) -> list[dict]:
        base = {"session_path": group["session_path"].iloc[0], "session_no": int(group["session_no"].iloc[0]), "session_id": group["session_id"].iloc[0]}
        try:
            g = Graph(_records(group))
        except ValueError as e:
            return [base | {"error": str(e)}]
        return [base | {
            "entry_id": e["id"], "parent_id": e["parent"], "depth": g.depth[e["id"]], "child_ids": g.children[e["id"]], "is_active": e["id"] in g.active, "is_visible": e["id"] in g.visible,
            "leaf_ids": g.leaves_of[e["id"]], "compacted_by": g.compacted.get(e["id"], []), "line": e["line"], "record_type": e["record"]["type"]} for e in g.entries] or [base]

    return _each_session(records, rows, ENTRY)


def _known(group: pd.DataFrame) -> Known:
    """Spans of earlier documents; an input whose chunks are not all there, once each, is left out."""
    out: Known = {}
    for key, g in group.groupby(["projection_input_id", "input_checksum"]):
        g = g.sort_values("chunk_index")
        if g["chunk_index"].tolist() == list(range(len(g))) and (g["chunk_count"] == len(g)).all():
            out[key] = [ck.Span(*map(int, r[:6]), r[6]) for r in g[["char_start", "char_end", "token_start", "token_end", "n_tokens", "overlap_tokens", "content"]].itertuples(index=False, name=None)]
    return out


def project_sessions(records: DataFrame, policy: ck.ChunkPolicy | None = None, count: Callable[[str], int] = ck.whitespace_tokens, earlier: DataFrame | None = None) -> DataFrame:
    """Dense documents of all logical sessions of ``import_sessions``; an invalid session gives one row with ``error``.

    Rejected files are left out here. One session file must fit a task; it is the reference unit of work, too.
    With ``earlier`` documents of the same files, texts that have not changed keep their chunks without being
    tokenized again; the result is the same.
    """
    policy = policy or ck.ChunkPolicy()

    def one(group: pd.DataFrame, known: Known | None = None) -> list[dict]:
        path, sid = group["session_path"].iloc[0], group["session_id"].iloc[0]
        try:
            recs = _records(group)
            logical = f"{sid}@{recs[0][0]}" if group["format"].iloc[0] == "reuse_history" else sid
            return documents(path, logical, Graph(recs), policy, count, known)
        except ValueError as e:
            return [{"session_path": path, "session_id": sid, "error": str(e)}]

    if earlier is None:
        return _each_session(records, one, DOCUMENT)

    def file(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        known = _known(before)
        return _frame([r for _, g in group.groupby("session_no", sort=True) for r in one(g, known)])

    spans = earlier.where("error is null").select("session_path", "projection_input_id", "input_checksum", "chunk_index", "chunk_count", "char_start", "char_end", "token_start", "token_end", "n_tokens", "overlap_tokens", "content")
    return records.where("error is null").groupBy("session_path").cogroup(spans.groupBy("session_path")).applyInPandas(file, DOCUMENT)


def project_invocations(records: DataFrame, own_tools: frozenset[str] = frozenset()) -> DataFrame:
    """Tool calls and shell executions of all valid sessions, without calls of ``own_tools``."""
    def rows(group: pd.DataFrame) -> list[dict]:
        path, sid = group["session_path"].iloc[0], group["session_id"].iloc[0]
        try:
            g = Graph(_records(group))
        except ValueError:
            return []
        return [r | {"session_path": path, "session_id": sid, "cwd": g.header["cwd"]} for r in invocations(g.entries, own_tools)]

    return _each_session(records, rows, INVOCATION)


def unique_documents(docs: DataFrame) -> DataFrame:
    """Document ids owned by one session only; see maintenance.ownership_conflicts for the others."""
    owners = docs.where("error is null").groupBy("id").agg(F.countDistinct("session_path").alias("n")).where("n = 1")
    return docs.join(owners.select("id"), "id", "left_semi")
