"""Project identities: repository remotes, lineages and how evidence relates to a search."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Default ports that the URL syntax drops.
DEFAULT_PORTS = {"http": 80, "https": 443}


def repository_path(path: str) -> str | None:
    """Path of a repository without outer slashes and .git; None if it has fewer than two plain segments."""
    parts = re.sub(r"\.git$", "", path.strip("/"), flags=re.I).split("/")
    return "/".join(parts) if len(parts) > 1 and not any(p in ("", ".", "..") for p in parts) else None


def normalise_remote(remote: str) -> str | None:
    """git-origin:host[:port]/path of a remote in URL or scp form; credentials and default ports are dropped."""
    remote = remote.strip()
    if "://" not in remote:
        m = re.fullmatch(r"(?:[^@/:\s]+@)?([^/:\s]+):(.+)", remote)
        host, path = (m[1].lower(), repository_path(m[2])) if m else ("", None)
    else:
        try:
            u = urlsplit(remote)
            port = u.port
        except ValueError:
            return None
        if u.scheme.lower() not in ("git", "http", "https", "ssh") or u.query or u.fragment or not u.hostname:
            return None
        port = None if DEFAULT_PORTS.get(u.scheme.lower()) == port else port
        host, path = u.hostname.lower() + (f":{port}" if port else ""), repository_path(u.path)
    return f"git-origin:{host}/{path}" if path else None


def repository_path_column(path: Column) -> Column:
    """``repository_path`` as a column expression."""
    plain = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "(?i)\\.git$", "")
    parts = F.split(plain, "/")
    fine = (F.size(parts) > 1) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(fine, plain)


def apply_lineage(origins: DataFrame, lineage: DataFrame) -> DataFrame:
    """(origin, project_identity, root): each origin with the longest lineage root that contains it, null for none.

    ``lineage``: root, project_identity. Candidates come from an equi-join on every prefix of the origin's
    path, so no all-pairs comparison takes place; equal lengths go to the smaller root.
    """
    parts = F.split("origin", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = origins.select("origin").distinct().select("origin", F.explode(prefixes).alias("root"))
    found = each.join(lineage, "root")
    w = W.partitionBy("origin").orderBy(F.length("root").desc(), "root")
    best = found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return origins.join(best, "origin", "left")


def evidence_relation(own: Column, other: Column, own_source: Column, other_source: Column) -> Column:
    """How a result's project relates to the search's: the label shown beside evidence."""
    return (
        F.when(own.isNull() | other.isNull() | (own != other), "unrestricted_global_evidence")
        .when((own_source == "configured_project_lineage") | (other_source == "configured_project_lineage"), "configured_project_lineage")
        .when(own.startswith("non-git-session-origin:"), "same_session_origin")
        .otherwise("same_repository")
    )
