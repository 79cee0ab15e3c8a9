"""Current, live and first-delivered views of repeatedly delivered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import small_side
from .text import norm_id


def current_rows(df: DataFrame, key: str, at: str = "ingested_at", tie: str | None = None) -> DataFrame:
    """One row per key: the one with the latest delivery time (ties: the larger ``tie``).

    The rank filter becomes a WindowGroupLimit, so each map task keeps one row per key before the
    shuffle and a key with a third of all rows stays harmless. Rows with a null key are dropped.
    """
    order = [F.col(at).desc_nulls_last()] + ([F.col(tie).desc_nulls_last()] if tie else [])
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def live_rows(df: DataFrame, key: str, at: str = "ingested_at", tie: str | None = None, deleted: str = "deleted_at") -> DataFrame:
    """Current rows that are not deleted."""
    return current_rows(df, key, at, tie).where(F.col(deleted).isNull())


def keep_live(df: DataFrame, key: str = "entry_key", row: str = "row_id", at: str = "ingested_at", deleted: str = "deleted_at") -> DataFrame:
    """Live rows of a wide table without shuffling its wide columns for the ranking.

    Only the ids of stale rows (superseded or deleted, a small share) are computed from four narrow
    columns and written once; the wide side is filtered by an anti join that broadcasts them up to a
    checked number and shuffles beyond it.
    """
    narrow = df.select(key, row, at, deleted)
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(row).desc_nulls_last()))
    stale = narrow.withColumn("__rn", rn).where((F.col("__rn") > 1) | F.col(deleted).isNotNull() | F.col(key).isNull()).select(row)
    return df.join(small_side(df.sparkSession, stale, "stale-rows"), row, "left_anti").where(F.col(row).isNotNull())


def link_column(prefix: str = "") -> Column:
    """The raw link of an entry row: target of a leaf, origin of a parentless branch summary, else parent."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when(c("record_type") == "leaf", c("target_id"))
        .when((c("record_type") == "branch_summary") & c("parent_id").isNull(), c("from_id"))
        .otherwise(c("parent_id"))
    )


def linked_entries(entries: DataFrame, *extra: Column | str) -> DataFrame:
    """Live entries with scope (session), own id and link, ids normalised; ``extra`` columns are carried along."""
    base = entries.select(
        "entry_key", "session_key", "row_id", "ingested_at", "deleted_at",
        norm_id(F.col("entry_id")).alias("node_id"), norm_id(link_column()).alias("link_id"), *extra,
    )
    return live_rows(base, "entry_key", tie="row_id").drop("row_id", "ingested_at", "deleted_at")
