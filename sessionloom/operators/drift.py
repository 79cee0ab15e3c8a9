"""Schemas that drift between files: member profiles, changes, renames and one unified table.

Lines are parsed once, in Arrow batches, into per-batch member profiles (JSON types, counts and a
bottom-k value sketch); profiles are merged by a partially aggregated groupBy, each version is laid
against its predecessor by one more groupBy, and only versions with both added and removed members reach
Python, where a bipartite matching pairs old names with new ones. A pair needs evidence: shared values
in the sketches, or almost the same name, and a JSON type in common; names that share records are no
renaming. Renames belong to their producer.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from .forest import whole_groups

SKETCH = 32
#: Evidence for a renaming: the least share of common sketch values (of at least LEAST_VALUES), or the least likeness of the names.
SHARED_VALUES, LEAST_VALUES, LIKE_NAMES = 0.3, 4, 0.75
VERSION = ["producer", "record_type", "file_seq"]


class _Number(str):
    """A JSON number kept as its text: no precision or digit limit applies."""


def _reject(text: str):
    raise ValueError(text)


_decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_reject)


def parse_object(text: str | None) -> dict | None:
    """The JSON object a line holds, or None for anything else (blank, damaged, other JSON values)."""
    if not text:
        return None
    try:
        value = _decoder.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value) -> str | None:
    """string, number, boolean, array or object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, _Number):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def clean(text: str) -> str:
    """Text without lone surrogates, which no column can hold."""
    return text.encode("utf-8", "replace").decode("utf-8")


def members(record: dict) -> Iterator[tuple[str, object]]:
    """Every member with its dotted path; objects count as members too, arrays are not entered."""
    stack = [("", record)]
    while stack:
        prefix, obj = stack.pop()
        for name, value in obj.items():
            path = prefix + clean(name)
            yield path, value
            if isinstance(value, dict):
                stack.append((path + ".", value))


def value_text(value) -> str | None:
    """Scalars as text, arrays and objects as compact JSON, null as None."""
    if value is None or isinstance(value, str):
        return None if value is None else clean(str(value))
    return clean(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _type_of(record: dict) -> str | None:
    kind = record.get("type")
    return clean(kind) if isinstance(kind, str) and not isinstance(kind, _Number) else None


def _profile_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        seen: dict[tuple, list] = {}
        for file_id, text in zip(frame["file_id"].tolist(), frame["raw_json"].tolist()):
            record = parse_object(text)
            if record is None:
                continue
            kind = _type_of(record)
            for path, value in members(record):
                found = json_type(value)
                slot = seen.setdefault((file_id, kind, path, found), [0, set()])
                slot[0] += 1
                if found is not None and found != "object":
                    slot[1].add(xxhash.xxh64_intdigest(value_text(value) or "") >> 1)
                    if len(slot[1]) > 4 * SKETCH:
                        slot[1] = set(sorted(slot[1])[:SKETCH])
        yield pd.DataFrame(
            [(*k, n, sorted(s)[:SKETCH]) for k, (n, s) in seen.items()],
            columns=["file_id", "record_type", "field_path", "json_type", "n", "sketch"],
        )


def profiles(records: DataFrame, files: DataFrame) -> DataFrame:
    """Member profile of each (producer, record_type, file_seq, field_path).

    ``records`` needs file_id and raw_json, ``files`` file_id, producer and file_seq; other columns are
    ignored, repeated listings and lines change nothing. Records whose ``type`` is missing or no string
    form the type null. Rows with a null file_id or unlisted files belong to no version and are left out.
    Columns: types (sorted distinct non-null JSON types), n (occurrences), sketch (smallest value hashes).
    """
    listed = files.select("file_id", "producer", "file_seq").dropna().distinct()
    part = records.select("file_id", "raw_json").where("file_id is not null and raw_json is not null").mapInPandas(
        _profile_frames, "file_id long, record_type string, field_path string, json_type string, n long, sketch array<long>")
    keys = ["record_type", "field_path"]
    by_file = part.groupBy("file_id", *keys).agg(
        F.array_sort(F.collect_set("json_type")).alias("types"), F.sum("n").alias("n"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"))
    return by_file.join(listed, "file_id").groupBy(*VERSION, "field_path").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.sum("n").alias("n"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"))


def version_pairs(prof: DataFrame) -> DataFrame:
    """Each member of a version beside the same path in the nearest earlier version, either side null if absent."""
    versions = prof.select(*VERSION).distinct()
    w = W.partitionBy("producer", "record_type").orderBy("file_seq")
    order = versions.withColumn("prev_seq", F.lag("file_seq").over(w)).withColumn("next_seq", F.lead("file_seq").over(w))
    same = F.col("v.producer").eqNullSafe(F.col("p.producer")) & F.col("v.record_type").eqNullSafe(F.col("p.record_type")) & (F.col("v.file_seq") == F.col("p.file_seq"))
    placed = prof.alias("p").join(order.alias("v"), same).select("p.*", "prev_seq", "next_seq")
    side = F.struct("types", "n", "sketch")
    sides = placed.select(
        "producer", "record_type", "field_path",
        F.explode(F.array(
            F.struct(F.col("file_seq").alias("at"), F.col("prev_seq").isNotNull().alias("use"), side.alias("new"), F.lit(None).cast("struct<types:array<string>,n:bigint,sketch:array<bigint>>").alias("old")),
            F.struct(F.col("next_seq").alias("at"), F.col("next_seq").isNotNull().alias("use"), F.lit(None).cast("struct<types:array<string>,n:bigint,sketch:array<bigint>>").alias("new"), side.alias("old")),
        )).alias("s"),
    ).where("s.use")
    return sides.groupBy("producer", "record_type", F.col("s.at").alias("file_seq"), "field_path").agg(
        F.first("s.old", ignorenulls=True).alias("old"), F.first("s.new", ignorenulls=True).alias("new"))


def similarity(old: dict, new: dict) -> float:
    """Score of a renaming in (0, 1], or 0 without enough evidence.

    Evidence is a JSON type in common (unless one side is null throughout) together with values that occur
    on both sides or names that differ in little but case and punctuation.
    """
    a, b = set(old["types"]), set(new["types"])
    if a and b and not a & b:
        return 0.0
    types = 0.5 if not a or not b else len(a & b) / len(a | b)
    pa, _, na = old["path"].rpartition(".")
    pb, _, nb = new["path"].rpartition(".")
    plain = lambda name: "".join(c for c in name.lower() if c.isalnum())
    name = difflib.SequenceMatcher(None, plain(na), plain(nb)).ratio()
    x, y = set(old["sketch"]), set(new["sketch"])
    low = sorted(x | y)[:SKETCH]
    values = sum(1 for v in low if v in x and v in y) / len(low) if len(low) >= LEAST_VALUES else 0.0
    if values < SHARED_VALUES and name < LIKE_NAMES:
        return 0.0
    presence = min(old["n"], new["n"]) / max(old["n"], new["n"], 1)
    return 0.4 * name + 0.3 * values + 0.15 * types + 0.1 * (pa == pb) + 0.05 * presence


def best_matching(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching of a score matrix by successive shortest augmenting paths."""
    rows, cols = score.shape
    if rows > cols:
        return [(i, j) for j, i in best_matching(score.T)]
    cost = score.max(initial=0.0) - score
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        owner[0], j0 = i, 0
        least, came, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while owner[j0]:
            used[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, cols + 1) if owner[j]]


def _match_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(version, old_path, new_path) of the best pairs of removed and added members of each version."""
    for frame in whole_groups(frames, "version"):
        out = []
        for version, group in frame.groupby("version", sort=False):
            rows = [dict(path=p, types=list(t), n=int(n), sketch=[int(x) for x in s]) for p, t, n, s in zip(group["field_path"], group["types"], group["n"], group["sketch"])]
            gone = [r for r, c in zip(rows, group["change"]) if c == "removed"]
            came = [r for r, c in zip(rows, group["change"]) if c == "added"]
            score = np.array([[similarity(a, b) for b in came] for a in gone])
            out.extend((version, gone[a]["path"], came[b]["path"]) for a, b in best_matching(score) if score[a, b] > 0)
        yield pd.DataFrame(out, columns=["version", "old_path", "new_path"])


def _renamed(moved: DataFrame, prof: DataFrame) -> DataFrame:
    """(producer, record_type, file_seq, old_path, new_path) of matched members.

    Only versions with both added and removed members are sorted and walked, in as many tasks as the
    session's shuffle partitions. A pair is dropped if the producer has a version whose records of the type
    are fewer than the two members' occurrences together, so that some record must hold both.
    """
    spark = moved.sparkSession
    key = F.to_json(F.struct(*VERSION)).alias("version")
    both = moved.groupBy(*VERSION).agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r")).where("a > 0 and r > 0")
    same = lambda x, y: F.col(f"{x}.producer").eqNullSafe(F.col(f"{y}.producer")) & F.col(f"{x}.record_type").eqNullSafe(F.col(f"{y}.record_type"))
    open_rows = moved.alias("m").join(both.alias("b"), same("m", "b") & (F.col("m.file_seq") == F.col("b.file_seq")), "left_semi")
    sent = open_rows.select(key, "field_path", "change", "types", "n", "sketch").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "version").sortWithinPartitions("version", "field_path")
    pairs = sent.mapInPandas(_match_frames, "version string, old_path string, new_path string")
    named = pairs.select(F.from_json("version", "producer string, record_type string, file_seq long").alias("v"), "old_path", "new_path").select("v.*", "old_path", "new_path")
    names = named.select("producer", "record_type", "old_path", "new_path").distinct().alias("q")
    side = lambda n: prof.select("producer", "record_type", "file_seq", "field_path", "n").alias(n)
    at = lambda x, y: same(x, y) & (F.col(f"{x}.file_seq") == F.col(f"{y}.file_seq"))
    met = names.join(side("x"), same("q", "x") & (F.col("q.old_path") == F.col("x.field_path"))).join(side("y"), at("x", "y") & (F.col("q.new_path") == F.col("y.field_path"))).join(
        side("z"), at("x", "z") & (F.col("z.field_path") == "type")).where(F.col("x.n") + F.col("y.n") > F.col("z.n")).select("q.*").distinct()
    together = same("n", "t") & (F.col("n.old_path") == F.col("t.old_path")) & (F.col("n.new_path") == F.col("t.new_path"))
    return named.alias("n").join(met.alias("t"), together, "left_anti")


def changes(prof: DataFrame) -> DataFrame:
    """Every change of a member between a version and its predecessor.

    Columns: producer, file_seq, record_type, field_path, change (added, removed, type_changed),
    old_types, new_types, renamed (the matched other name of an added or removed member). A member that
    is null throughout one version has no types there and is no type change. A producer's first version
    of a record type has no changes; empty input gives no rows.
    """
    pairs = version_pairs(prof)
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when((F.size("old.types") > 0) & (F.size("new.types") > 0) & (F.col("old.types") != F.col("new.types")), "type_changed")
    )
    rows = pairs.withColumn("change", change).where("change is not null")
    base = ["producer", "file_seq", "record_type", "field_path", "change"]
    text = lambda side: F.array_join(f"{side}.types", "|")
    typed = rows.where("change = 'type_changed'").select(*base, text("old").alias("old_types"), text("new").alias("new_types"), F.lit(None).cast("string").alias("renamed"))
    here = F.coalesce("new", "old")
    moved = rows.where("change <> 'type_changed'").select(
        *base, text("old").alias("old_types"), text("new").alias("new_types"), here["types"].alias("types"), here["n"].alias("n"), here["sketch"].alias("sketch"))
    moved, _ = materialize(moved.sparkSession, moved.withColumn("file_seq", F.col("file_seq").cast("long")), "drift-moved")
    pairs = _renamed(moved, prof)
    names = pairs.select(*VERSION, F.explode(F.array(
        F.struct(F.lit("removed").alias("change"), F.col("old_path").alias("field_path"), F.col("new_path").alias("renamed")),
        F.struct(F.lit("added").alias("change"), F.col("new_path").alias("field_path"), F.col("old_path").alias("renamed")))).alias("p")).select(*VERSION, "p.*").alias("n")
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("producer", "record_type")] + [F.col(f"m.{c}") == F.col(f"n.{c}") for c in ("file_seq", "change", "field_path")]
    matched = moved.alias("m").join(names, on[0] & on[1] & on[2] & on[3] & on[4], "left").select(*[f"m.{c}" for c in base], "m.old_types", "m.new_types", "n.renamed")
    return typed.withColumn("file_seq", F.col("file_seq").cast("long")).unionByName(matched)


def _components(group: pd.DataFrame) -> pd.DataFrame:
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    weight = dict(zip(group["old_name"], group["old_n"])) | dict(zip(group["new_name"], group["new_n"]))
    for a, b in zip(group["old_name"], group["new_name"]):
        up[find(a)] = find(b)
    best: dict[str, str] = {}
    for name in sorted(weight, key=lambda x: (-weight[x], x)):
        best.setdefault(find(name), name)
    return pd.DataFrame({"producer": group["producer"].iloc[0], "record_type": group["record_type"].iloc[0], "field_path": list(weight), "canonical": [best[find(x)] for x in weight]})


def renames(found: DataFrame) -> DataFrame:
    """(producer, record_type, field_path, canonical): names joined by a producer's renamings.

    The canonical name is the one that most renamings of the record type involve over all producers, so that
    producers agree; ties go to the smaller name. A group holds the distinct renamings of one producer and
    record type, whose number its member names bound.
    """
    edges = found.where("change = 'added' and renamed is not null").groupBy("producer", "record_type", F.col("renamed").alias("old_name"), F.col("field_path").alias("new_name")).agg(F.count("*").alias("n"))
    weight = edges.select("record_type", "n", F.explode(F.array("old_name", "new_name")).alias("name")).groupBy("record_type", "name").agg(F.sum("n").alias("n"))
    e, o, w = edges.alias("e"), weight.alias("o"), weight.alias("w")
    at = lambda x, side: F.col("e.record_type").eqNullSafe(F.col(f"{x}.record_type")) & (F.col(f"e.{side}") == F.col(f"{x}.name"))
    weighed = e.join(o, at("o", "old_name")).join(w, at("w", "new_name")).select("e.producer", "e.record_type", "old_name", "new_name", F.col("o.n").alias("old_n"), F.col("w.n").alias("new_n"))
    return weighed.groupBy("producer", "record_type").applyInPandas(_components, "producer string, record_type string, field_path string, canonical string")


def _member_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for file_id, line_no, text in zip(frame["file_id"].tolist(), frame["line_no"].tolist(), frame["raw_json"].tolist()):
            record = parse_object(text)
            if record is not None:
                kind = _type_of(record)
                out.extend((file_id, line_no, kind, path, json_type(value) or "null", value_text(value)) for path, value in members(record) if value == {} or not isinstance(value, dict))
        yield pd.DataFrame(out, columns=["file_id", "line_no", "record_type", "field_path", "json_type", "value"])


def unify(records: DataFrame, files: DataFrame, mapping: DataFrame) -> DataFrame:
    """All records in one schema: file_id, line_no, record_type and fields, a map of name -> (json_type, value).

    Values are text with their JSON type beside them; nulls have type null, objects appear as their members
    and only empty ones as themselves. Names are those of ``mapping`` for the file's producer. Repeated
    deliveries of a line count once (its latest by read_at). When several names of one member occur in a record,
    the canonical name keeps its own value, or takes that of the smallest path; the others stay under
    their own names, so no value is lost.
    """
    w = W.partitionBy("file_id", "line_no").orderBy(F.col("read_at").desc_nulls_last(), F.col("raw_json").desc_nulls_last())
    once = records.select("file_id", "line_no", "raw_json", "read_at").withColumn("rn", F.row_number().over(w)).where("rn = 1 and raw_json is not null")
    cells = once.select("file_id", "line_no", "raw_json").mapInPandas(_member_frames, "file_id long, line_no int, record_type string, field_path string, json_type string, value string")
    made_by = files.select(F.col("file_id").alias("f_id"), F.col("producer").alias("f_producer")).where("f_id is not null").groupBy("f_id").agg(F.min("f_producer").alias("f_producer"))
    names = mapping.select(F.col("producer").alias("m_producer"), F.col("record_type").alias("m_type"), F.col("field_path").alias("m_path"), "canonical").join(
        made_by, F.col("m_producer").eqNullSafe(F.col("f_producer"))).select(F.col("f_id").alias("m_id"), "m_type", "m_path", "canonical")
    on = (cells["file_id"] == F.col("m_id")) & cells["record_type"].eqNullSafe(F.col("m_type")) & (cells["field_path"] == F.col("m_path"))
    named = cells.join(names, on, "left").select("file_id", "line_no", "record_type", "field_path", F.coalesce("canonical", "field_path").alias("name"), F.struct("json_type", "value").alias("cell"))
    group = F.struct((F.col("field_path") != F.col("name")).alias("other"), F.col("field_path").alias("path"), "name", "cell")
    gathered = named.groupBy("file_id", "line_no", "record_type").agg(F.array_sort(F.collect_list(group)).alias("all"))  # the members of one record
    first = F.transform("all", lambda x, i: F.struct(
        F.when(F.exists(F.slice("all", 1, F.greatest(i, F.lit(0))), lambda y: y["name"] == x["name"]), x["path"]).otherwise(x["name"]).alias("name"), x["cell"].alias("cell")))
    return gathered.select("file_id", "line_no", "record_type", F.map_from_entries(F.array_sort(first)).alias("fields"))
