"""Incremental maintenance: snapshot diff, vector reuse, generations with atomic activation, locks and ignore lists."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import posixpath
import socket
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_diff(files: DataFrame, stored: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(path, status): new, changed, touched, unchanged, missing or ignored, by one full outer join on the path.

    ``files`` and ``stored``: path, size, mtime_ms, sha256. Equal size and time is unchanged; equal content
    under another time is touched (state refresh only); ignored stored paths are removals.
    """
    f, s = files.alias("f"), stored.alias("s")
    both = f.join(s, F.col("f.path") == F.col("s.path"), "full_outer").select(
        F.coalesce("f.path", "s.path").alias("path"), F.col("f.path").isNotNull().alias("here"), F.col("s.path").isNotNull().alias("known"),
        (F.col("f.size") == F.col("s.size")).alias("same_size"), (F.col("f.mtime_ms") == F.col("s.mtime_ms")).alias("same_time"), (F.col("f.sha256") == F.col("s.sha256")).alias("same_hash"))
    if ignored is not None:
        both = both.join(ignored.select("path").distinct().withColumn("skip", F.lit(True)), "path", "left")
    else:
        both = both.withColumn("skip", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("skip"), "ignored").when(~F.col("known"), "new").when(~F.col("here"), "missing")
        .when(F.col("same_size") & F.col("same_time"), "unchanged").when(F.col("same_size") & F.col("same_hash"), "touched").otherwise("changed")
    )
    return both.select("path", status.alias("status"))


def reuse_vectors(wanted: DataFrame, current: DataFrame, legacy: DataFrame) -> DataFrame:
    """(id, checksum, session, source, vector): where the vector of each document comes from.

    ``wanted``: id, checksum (of the text), session. The own current vector (by id and checksum) comes first
    (current), then a current vector of the same text in the session (copy), then the own legacy one
    (legacy), then a legacy one of the same text (copy). Without any, the smallest id of the text is
    embedded (embed) and the others copy it; their vector is null until ``fill_copies``. Of several equal
    texts with a vector the smallest id's counts.
    """
    c, g = current.select("id", "checksum", F.col("vector").alias("v1")), legacy.select("id", "checksum", F.col("vector").alias("v2"))
    j = wanted.select("id", "checksum", "session").join(c, ["id", "checksum"], "left").join(g, ["id", "checksum"], "left")
    text = ["session", "checksum"]
    first = j.groupBy(*text).agg(
        F.min("id").alias("first"), F.min_by("v1", F.when(F.col("v1").isNotNull(), F.col("id"))).alias("t1"), F.min_by("v2", F.when(F.col("v2").isNotNull(), F.col("id"))).alias("t2"))
    same = [F.col(f"j.{k}").eqNullSafe(F.col(f"f.{k}")) for k in text]
    both = j.alias("j").join(first.alias("f"), same[0] & same[1])
    source = (
        F.when(F.col("v1").isNotNull(), "current").when(F.col("t1").isNotNull(), "copy").when(F.col("v2").isNotNull(), "legacy")
        .when(F.col("t2").isNotNull() | (F.col("id") != F.col("first")), "copy").otherwise("embed"))
    return both.select("j.id", "j.checksum", "j.session", source.alias("source"), F.coalesce("v1", "t1", "v2", "t2").alias("vector"))


def fill_copies(reused: DataFrame, embedded: DataFrame) -> DataFrame:
    """(id, checksum, session, source, vector) with the vectors of ``embedded`` (id, vector) at the embedded documents and their copies."""
    made = reused.where("source = 'embed'").join(embedded.select("id", F.col("vector").alias("made")), "id").select("session", "checksum", "made")
    on = F.col("r.session").eqNullSafe(F.col("m.session")) & F.col("r.checksum").eqNullSafe(F.col("m.checksum"))
    return reused.alias("r").join(made.alias("m"), on, "left").select("r.id", "r.checksum", "r.session", "r.source", F.coalesce("r.vector", "m.made").alias("vector"))


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "session_path") -> DataFrame:
    """Rows of a table's next generation: old ones of unchanged keys, and the new ones."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def ownership_conflicts(documents: DataFrame) -> DataFrame:
    """Document ids that more than one session owns."""
    return documents.groupBy("document_id").agg(F.countDistinct("session_path").alias("owners")).where("owners > 1")


def manifest_differences(actual: dict, expected: dict, prefix: str = "") -> list[str]:
    """Paths at which ``actual`` misses or differs from ``expected``; extra members are no difference."""
    out = []
    for name in expected:
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(expected[name], dict):
            below = actual.get(name) if isinstance(actual, dict) else None
            out += manifest_differences(below, expected[name], path) if isinstance(below, dict) else [path]
        elif not isinstance(actual, dict) or actual.get(name) != expected[name]:
            out.append(path)
    return out


class Shared:
    """Small files on whatever file system a folder lies on, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))) if self.exists(self.root) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise RuntimeError(f"cannot rename {old} to {new}")

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError:
            if self.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Write beside the target and rename over it in one step."""
        folder, name = posixpath.split(path)
        temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.create(temp, text)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        whole = self._fs.makeQualified(self._path(temp))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self._conf).rename(whole, self._fs.makeQualified(self._path(path)), options)

    def size(self) -> dict[str, int]:
        """Bytes and files below the folder."""
        if not self.exists(self.root):
            return {"bytes": 0, "files": 0}
        found = self._fs.getContentSummary(self._path(self.root))
        return {"bytes": found.getLength(), "files": found.getFileCount()}


class Generations:
    """Immutable generations of Parquet tables under one shared folder; a pointer file, replaced in one step, names the active one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Shared(spark, root)
        self.files.make(self.files.root)

    def create(self) -> str:
        """A fresh candidate; earlier candidates are dropped."""
        for old in self.files.names():
            if old.startswith("candidate-"):
                self.files.delete(self.files.at(old))
        path = self.files.at(f"candidate-{uuid.uuid4().hex}")
        self.files.make(path)
        return path

    def resume(self) -> str:
        found = [n for n in self.files.names() if n.startswith("candidate-")]
        if len(found) != 1:
            raise RuntimeError(f"expected one candidate, found {len(found)}")
        return self.files.at(found[0])

    def write(self, candidate: str, tables: dict[str, DataFrame], manifest: dict) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{candidate}/{name}")
        self.files.replace(f"{candidate}/manifest.json", json.dumps(manifest, sort_keys=True))

    def stage(self, candidate: str) -> str:
        target = self.files.at(posixpath.basename(candidate).replace("candidate-", "generation-"))
        self.files.rename(candidate, target)
        return target

    def activate(self, generation: str) -> None:
        folder, name = posixpath.split(generation.rstrip("/"))
        if folder != self.files.root or not name.startswith("generation-") or not self.files.exists(f"{generation}/manifest.json"):
            raise ValueError("not a complete generation of this root")
        self.files.replace(self.files.at("active"), name)

    def has_active(self) -> bool:
        return self.files.exists(self.files.at("active"))

    def active(self, expected: dict | None = None) -> str:
        """Folder of the active generation; one that was built otherwise than ``expected`` must be rebuilt."""
        path = self.files.at(self.files.read(self.files.at("active")).strip())
        if expected and (bad := manifest_differences(json.loads(self.files.read(f"{path}/manifest.json")), expected)):
            raise RuntimeError(f"index differs from the configuration, rebuild: {', '.join(bad)}")
        return path

    def read(self, name: str, generation: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{generation or self.active()}/{name}")

    def lookup(self, name: str, ids: DataFrame, key: str = "id") -> DataFrame:
        """Rows of a table by a list of ids; absent ids give nothing."""
        return self.read(name).join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")

    def export(self, session_path: str) -> dict[str, DataFrame]:
        """Every table's rows of one session file."""
        at = self.active()
        tables = {n: self.read(n, at) for n in Shared(self.spark, at).names() if n != "manifest.json"}
        return {n: df.where(F.col("session_path" if "session_path" in df.columns else "path") == session_path) for n, df in tables.items()}


def _abandoned(owner: str) -> bool:
    """Whether the process that a lock names has ended on this host."""
    host, _, pid = owner.partition(" ")
    if host != socket.gethostname() or not pid.isdigit():
        return False
    try:
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        pass
    return False


@contextlib.contextmanager
def exclusive_lock(spark: SparkSession, root: str, wait_seconds: float = 0.0, poll: float = 0.25) -> Iterator[None]:
    """A lock file with its owner; one whose owner has ended, or that stays unreadable for four polls, is taken over."""
    files = Shared(spark, root)
    files.make(files.root)
    path, end, unreadable = files.at(".lock"), time.monotonic() + wait_seconds, 0
    while not files.create(path, f"{socket.gethostname()} {os.getpid()}"):
        owner = ""
        with contextlib.suppress(Py4JJavaError):
            owner = files.read(path).strip()
        unreadable = 0 if owner else unreadable + 1
        if unreadable >= 4 or owner and _abandoned(owner):
            files.delete(path)
        elif owner and time.monotonic() >= end:
            raise TimeoutError("the index is being changed")
        else:
            time.sleep(poll)
    try:
        yield
    finally:
        files.delete(path)


def locked(spark: SparkSession, root: str) -> bool:
    """Whether somebody who is still there changes the index; searches refuse meanwhile."""
    files = Shared(spark, root)
    return files.exists(files.at(".lock")) and not _abandoned(files.read(files.at(".lock")).strip())


class IgnoreList:
    """Sorted, unique absolute paths of session files to leave out; changes hold the store's lock."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Shared(spark, root)

    def paths(self) -> list[str]:
        path = self.files.at("ignore.json")
        return json.loads(self.files.read(path))["paths"] if self.files.exists(path) else []

    def change(self, add: list[str] = (), remove: list[str] = ()) -> list[str]:
        full = lambda ps: {os.path.abspath(p) for p in ps}
        with exclusive_lock(self.spark, self.files.root):
            now = sorted((set(self.paths()) | full(add)) - full(remove))
            self.files.replace(self.files.at("ignore.json"), json.dumps({"version": 1, "paths": now}))
        return now

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in self.paths()], "path string")


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, separators=(",", ":")).encode()).hexdigest()
