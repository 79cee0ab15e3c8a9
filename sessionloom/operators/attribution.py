"""Projects of sessions: canonical identities, resolution of session origins, lineages and attribution of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import apply_lineage, normalise_remote, repository_path_column


def plain_absolute_path(path: Column) -> Column:
    """Whether a path is absolute and has no empty, single-dot or double-dot segment; a slash at the end is fine."""
    return path.rlike("^/([^/]+/)*[^/]*$") & ~path.rlike("(^|/)\\.{1,2}(/|$)")


def is_repository_identity(identity: Column) -> Column:
    """git-origin:host[:port]/a/b… or git-common-directory:/…, both in normal form."""
    path = F.regexp_extract(identity, "^git-origin:[a-z0-9.-]+(?::[0-9]+)?/(.+)$", 1)
    shared = F.regexp_extract(identity, "^git-common-directory:(.*)$", 1)
    origin = (path != "") & F.coalesce(repository_path_column(path) == path, F.lit(False))
    return F.coalesce(F.when(identity.startswith("git-origin:"), origin).when(identity.startswith("git-common-directory:"), plain_absolute_path(shared)).otherwise(False), F.lit(False))


def is_project_identity(identity: Column) -> Column:
    """A repository identity or non-git-session-origin: with an absolute path in normal form; false for null."""
    origin = F.regexp_extract(identity, "^non-git-session-origin:(.*)$", 1)
    return is_repository_identity(identity) | F.coalesce(identity.startswith("non-git-session-origin:") & plain_absolute_path(origin), F.lit(False))


def _remotes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"remote": f["remote"], "named": [normalise_remote(r) for r in f["remote"]]})


def resolve_identities(origins: DataFrame, environment: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """(origin, project_identity, identity_source) of each distinct non-empty origin.

    ``environment``: origin, remote, common_dir, is_directory, as found beside the session files. A hosted remote
    comes first, then the shared git directory, then an existing directory without git; what git gives
    but is not canonical stays null. An origin at or below a root of ``lineage`` (root, project_identity) belongs
    to that project whatever else is found, the longest root deciding.
    """
    wanted = origins.select("origin").where("origin <> ''").distinct()
    once = environment.groupBy("origin").agg(F.min("remote").alias("remote"), F.min("common_dir").alias("common_dir"), F.bool_or("is_directory").alias("is_directory"))
    named = once.where("remote is not null").select("remote").distinct().mapInPandas(_remotes, "remote string, named string")
    found = wanted.join(once, "origin", "left").join(named, "remote", "left")
    shared, own = F.concat(F.lit("git-common-directory:"), "common_dir"), F.concat(F.lit("non-git-session-origin:"), "origin")
    git = F.coalesce(F.col("common_dir") != "", F.lit(False))
    identity = F.when(F.col("named").isNotNull(), F.col("named")).when(git, F.when(is_repository_identity(shared), shared)).when(F.col("is_directory") & is_project_identity(own), own)
    source = F.when(F.col("named").isNotNull(), "git_origin").when(git, F.when(is_repository_identity(shared), "git_common_directory")).when(F.col("is_directory") & is_project_identity(own), "non_git_session_origin")
    out = found.select("origin", identity.alias("project_identity"), source.alias("identity_source"))
    if lineage is None:
        return out
    placed = apply_lineage(out.select("origin"), lineage.select("root", F.col("project_identity").alias("heir")))
    takes = F.col("heir").isNotNull()
    return out.join(placed, "origin").select("origin", F.when(takes, F.col("heir")).otherwise(F.col("project_identity")).alias("project_identity"), F.when(takes, "configured_project_lineage").otherwise(F.col("identity_source")).alias("identity_source"))


def attribute(rows: DataFrame, resolved: DataFrame, cwd: str = "cwd") -> DataFrame:
    """``rows`` with project_identity and identity_source of their working directory; null for unknown, empty or null ones."""
    known = resolved.select(F.col("origin").alias(cwd), "project_identity", "identity_source")
    return rows.drop("project_identity", "identity_source").join(known, cwd, "left")


def normalize_lineages(spark: SparkSession, declared: dict[str, list[str]]) -> DataFrame:
    """(root, project_identity) of a configuration; targets must be repository identities, roots absolute and without conflict."""
    import posixpath

    rows = sorted({(posixpath.normpath(r), p) for p, roots in declared.items() for r in roots})
    if any(not r.startswith("/") for roots in declared.values() for r in roots):
        raise ValueError("a lineage root must be absolute")
    out = spark.createDataFrame(rows, "root string, project_identity string")
    if not out.where(~is_repository_identity(F.col("project_identity"))).isEmpty():
        raise ValueError("a lineage target must be a canonical repository identity")
    if clash := lineage_conflicts(out).first():
        raise ValueError(f"lineage roots conflict: {clash.root} and {clash.other_root} belong to different projects")
    return out


def lineage_conflicts(lineage: DataFrame) -> DataFrame:
    """(root, project_identity, other_root, other_identity): a root that lies at or below one of another project.

    Found by an equi-join on every prefix of a root, not by comparing all pairs.
    """
    parts = F.split(F.regexp_replace("root", "/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, n), "/"), F.lit("")), F.lit("/")))
    below = lineage.select("root", "project_identity", F.explode(F.array_distinct(prefixes)).alias("at"))
    above = lineage.select(F.coalesce(F.nullif(F.regexp_replace("root", "/+$", ""), F.lit("")), F.lit("/")).alias("at"), F.col("root").alias("other_root"), F.col("project_identity").alias("other_identity"))
    return below.join(above, "at").where("project_identity <> other_identity").select("root", "project_identity", "other_root", "other_identity").distinct()
