"""Spark session defaults, shared-folder materialisation and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def build_session(app: str = "sessionloom", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sessionloom-code-")) / "sessionloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where none is set and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), f"sessionloom-{spark.sparkContext.applicationId}")
    os.makedirs(local, exist_ok=True)
    return f"file://{local}"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Tables lie in a subfolder of the application, which may be deleted when it has ended.
    """
    path = f"{shared_folder(spark)}/sessionloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str | None) -> None:
    """Delete materialised tables that no later step reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            target = jvm.org.apache.hadoop.fs.Path(p)
            target.getFileSystem(conf).delete(target, True)


def small_side(spark: SparkSession, df: DataFrame, tag: str, most_rows: int = 500_000) -> DataFrame:
    """df, written to the shared folder and counted: broadcast up to ``most_rows`` narrow rows, joined as it is beyond."""
    kept, _ = materialize(spark, df, tag)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def clean(spark: SparkSession) -> None:
    """Delete every table this application materialised; results that still read one must have been written before."""
    release(spark, f"{shared_folder(spark)}/sessionloom/{spark.sparkContext.applicationId}")
