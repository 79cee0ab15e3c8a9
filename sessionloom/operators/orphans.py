"""References to records that do not exist, tracked as keyed state over deliveries.

The deliveries of a batch are collapsed to one version per record and period, combined in the map tasks.
A version is in force from its period until the record's next one: what it offers as a target and what
it refers to become intervals over periods. The offers of a key are the parent index; every reference
probes it once and waits over the periods in which no offer covers it: an arriving parent closes such a
stretch, a superseded or deleted one opens the next. So any number of periods costs one pass, and counts
are snapshots at their ends. Between batches the state lies in hash buckets (records by record, offers
and references by key); a later batch reads and rewrites only the buckets that its own rows touch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..runtime import materialize, release, shared_folder

RECORD = ["table_name", "record_key"]
KEY = ["kind", "scope", "ref_id"]
REFS = "array<struct<ref_field:string,kind:string,scope:string,ref_id:string>>"
#: Periods before and after all others: in force when the batch begins, and when it has ended.
BEFORE, OPEN = -(2**31), 2**31 - 1
BUCKETS = 64


def _ref(field: str, kind: str, scope: Column, value: Column | None = None) -> Column:
    return F.struct(F.lit(field).alias("ref_field"), F.lit(kind).alias("kind"), scope.alias("scope"), norm_id(value if value is not None else F.col(field)).alias("ref_id"))


def deliveries(df: DataFrame, table: str, key: Column, tie: Column, kind: str, scope: Column, own_id: Column, refs: list[Column], deleted: Column | None = None) -> DataFrame:
    """One row per delivery in the common shape: record, time, liveness, the id it offers and the ids it refers to.

    Null references are dropped; blank ones stay and resolve only to a blank id. Rows without key or
    delivery time are no deliveries.
    """
    held = F.filter(F.array(*refs), lambda r: r["ref_id"].isNotNull()) if refs else F.array()
    return df.select(
        F.lit(table).alias("table_name"), key.cast("string").alias("record_key"), F.col("ingested_at").alias("at"), tie.alias("tie"),
        (deleted.isNull() if deleted is not None else F.lit(True)).alias("live"),
        F.lit(kind).alias("kind"), scope.alias("scope"), norm_id(own_id).alias("ref_id"), held.cast(REFS).alias("refs"),
    ).where("record_key is not null and at is not null")


def session_log_deliveries(entries: DataFrame, sessions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Deliveries of the three session-log tables with their reference fields."""
    c, none = F.col, F.lit(None)
    e = deliveries(entries, "entries", c("entry_key"), c("row_id"), "entry", c("session_key"), c("entry_id"), [
        *(_ref(f, "entry", c("session_key")) for f in ("parent_id", "from_id", "target_id", "first_kept_entry_id")),
        _ref("message_tool_call_id", "call", c("session_key"))], c("deleted_at"))
    s = deliveries(sessions, "sessions", c("session_key"), none.cast("long"), "session", F.lit(""), c("session_path"), [_ref("parent_session", "session", F.lit(""))], c("deleted_at"))
    t = deliveries(tool_calls, "tool_calls", c("call_key"), none.cast("long"), "call", c("session_key"), c("tool_call_id"), [])
    return e.unionByName(s).unionByName(t)


def versions(batch: DataFrame, period: str, before: DataFrame | None = None) -> DataFrame:
    """(record, v, first_day, start, stop, newest): each record's version in force from period to period.

    v holds live, kind, scope, ref_id and refs; ``before`` are stored versions of records that the batch
    touches. A delivery older than the stored one supersedes nothing, but can lower the first day.
    """
    once = batch.groupBy(*RECORD, F.unix_date(F.trunc(F.to_date("at"), period)).alias("start")).agg(
        F.max(F.struct("at", "tie", F.struct("live", "kind", "scope", "ref_id", "refs").alias("v"))).alias("newest"), F.min(F.to_date("at")).alias("first_day"))
    if before is not None:
        once = once.unionByName(before.select(*RECORD, F.lit(BEFORE).alias("start"), "newest", "first_day"))
    w = W.partitionBy(*RECORD).orderBy("start")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return once.select(
        *RECORD, "start", F.coalesce(F.lead("start").over(w), F.lit(OPEN)).alias("stop"),
        F.max("newest").over(so_far).alias("newest"), F.min("first_day").over(so_far).alias("first_day"))


def offers_of(found: DataFrame) -> DataFrame:
    """(record, key, start, stop, first_day) of live versions that can be referred to."""
    return found.where("newest.v.live and newest.v.ref_id is not null").select(*RECORD, *[F.col(f"newest.v.{k}").alias(k) for k in KEY], "start", "stop", "first_day")


def references_of(found: DataFrame) -> DataFrame:
    """(record, ref_field, key, start, stop, first_day) of live versions' references."""
    each = found.where("newest.v.live").select(*RECORD, "start", "stop", "first_day", F.explode("newest.v.refs").alias("r"))
    return each.select(*RECORD, F.col("r.ref_field").alias("ref_field"), *[F.col(f"r.{k}").alias(k) for k in KEY], "start", "stop", "first_day")


def probe(refs: DataFrame, offers: DataFrame) -> DataFrame:
    """``refs`` with since (the first day of a parent in force at the end) and waits, the stretches without one in time.

    The index holds distinct (start, stop, first day) triples of a key, so its size follows the number of
    periods and days, not the records that offer the key.
    """
    span = F.struct("start", "stop", "first_day")
    index = offers.groupBy(*KEY).agg(F.collect_set(span).alias("offered"))
    joined = refs.join(index, KEY, "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<struct<start:int,stop:int,first_day:date>>")))
    timely = joined.withColumn("timely", F.filter("offered", lambda o: (o["first_day"] <= F.col("first_day")) & (o["stop"] > F.col("start")) & (o["start"] < F.col("stop"))))
    begins = F.array_distinct(F.concat(F.array("start"), F.transform("timely", lambda o: o["stop"])))
    free = F.filter(begins, lambda p: (p < F.col("stop")) & ~F.exists("timely", lambda o: (o["start"] <= p) & (p < o["stop"])))
    until = lambda p: F.least(F.col("stop"), F.array_min(F.filter(F.transform("timely", lambda o: o["start"]), lambda x: x > p)))
    at_end = F.array_min(F.transform(F.filter("offered", lambda o: o["stop"] == OPEN), lambda o: o["first_day"]))
    return timely.select(*RECORD, "ref_field", *KEY, "first_day", "start", "stop", at_end.alias("since"), F.transform(free, lambda p: F.struct(p.alias("start"), until(p).alias("stop"))).alias("waits"))


def _counts(spark: SparkSession, probed: DataFrame, periods: list[int], base: DataFrame | None) -> DataFrame:
    """(table_name, ref_field, month, period, orphans) at the end of every period, zero counts included."""
    month = F.date_format("first_day", "yyyy-MM").alias("month")
    ends = probed.select("table_name", "ref_field", month, F.explode("waits").alias("w")).select(
        "table_name", "ref_field", "month", F.explode(F.array(F.struct(F.col("w.start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("w.stop").alias("at"), F.lit(-1).alias("by")))).alias("d"))
    series = ["table_name", "ref_field", "month"]
    moved = ends.where((F.col("d.at") > BEFORE) & (F.col("d.at") < OPEN)).groupBy(*series, "d.at").agg(F.sum("d.by").alias("by"))
    if base is not None:
        moved = moved.unionByName(base.select(*series, F.lit(BEFORE).alias("at"), F.col("orphans").alias("by")))
    marks = F.array(*[F.lit(p) for p in periods]) if periods else F.array().cast("array<int>")
    lists = moved.groupBy(*series).agg(F.collect_list(F.struct("at", "by")).alias("moves")).select(*series, "moves", F.explode(marks).alias("mark"))
    total = F.aggregate(F.filter("moves", lambda m: m["at"] <= F.col("mark")), F.lit(0).cast("long"), lambda s, m: s + m["by"])
    return lists.select(*series, F.date_from_unix_date("mark").alias("period"), total.alias("orphans"))


def _bucket(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


class OrphanState:
    """Pending orphans after the batches seen so far.

    With ``folder`` the state (bucket files and a manifest written last) outlives the application: a new
    object over the same folder goes on where the last complete batch ended.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.seq, self.buckets = spark, 0, buckets
        self.folder = folder or f"{shared_folder(spark)}/sessionloom/{spark.sparkContext.applicationId}/orphans-{uuid.uuid4().hex}"
        #: bucket -> folder of its current rows, for records, offers and refs; the tables of counts
        self.at: dict[str, dict[str, str]] = {"records": {}, "offers": {}, "refs": {}}
        self.snapshots: list[str] = []
        self._last: DataFrame | None = None
        if folder:
            self._resume()

    def _files(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _resume(self) -> None:
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._files()
        if not fs.exists(path(self.folder)):
            return
        found = [s.getPath() for s in fs.listStatus(path(self.folder)) if s.getPath().getName().startswith("manifest-") and fs.exists(path(s.getPath(), "_SUCCESS"))]
        if found:
            newest = max(found, key=lambda p: int(p.getName().split("-")[1]))
            kept = json.loads(self.spark.read.text(newest.toString()).first()[0])
            self.seq, self.buckets, self.at, self.snapshots = kept["seq"], kept["buckets"], kept["at"], kept["snapshots"]

    def _save(self) -> None:
        text = json.dumps({"seq": self.seq, "buckets": self.buckets, "at": self.at, "snapshots": self.snapshots})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{self.seq}")

    def _stored(self, table: str, touched: list[int] | None = None) -> DataFrame | None:
        at = self.at[table]
        paths = sorted(p for b, p in at.items() if touched is None or int(b) in touched)
        return self.spark.read.parquet(*paths) if paths else None

    def _store(self, table: str, rows: DataFrame, by: list[str], touched: list[int]) -> None:
        """Write the touched buckets anew; the others keep their files."""
        path = f"{self.folder}/{table}-{self.seq}-{uuid.uuid4().hex}"
        kept = rows.withColumn("bucket", _bucket(by, self.buckets))
        kept.repartition("bucket").write.partitionBy("bucket").parquet(path)
        fs, hadoop = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        written = {s.getPath().getName().removeprefix("bucket="): s.getPath().toString() for s in fs.listStatus(hadoop(path)) if s.getPath().getName().startswith("bucket=")}
        for b in touched:
            self.at[table].pop(str(b), None)
        self.at[table] |= written

    def advance(self, batch: DataFrame, period: str = "quarter", keep: bool = True) -> None:
        """Apply a batch of deliveries; counts are taken at the end of each of its periods.

        ``keep=False`` ends the history: no bucket is written, only pending() and history() can follow.
        """
        spark = self.spark
        self.seq += 1
        touched = lambda df, by: sorted(r[0] for r in df.select(_bucket(by, self.buckets)).distinct().collect())  # at most ``buckets`` numbers
        records = touched(batch, RECORD) if keep or self.at["records"] else []
        before = self._stored("records", records)
        if before is not None:
            before = before.join(batch.select(*RECORD).distinct(), RECORD, "left_semi")
        found, path = materialize(spark, versions(batch, period, before), "orphans-versions")
        offers, refs = offers_of(found), references_of(found)
        periods = sorted(r[0] for r in found.where(F.col("start") > BEFORE).select("start").distinct().collect())
        keys: list[int] = []
        if keep or self.at["offers"] or self.at["refs"]:
            keys = touched(offers.select(*KEY).unionByName(refs.select(*KEY)), KEY)
            again = found.select(*RECORD).distinct()
            for table in ("offers", "refs"):
                old = self._stored(table, keys)
                if old is not None:  # rows of records that came again are among the new ones, with their old version
                    old = old.join(again, RECORD, "left_anti").withColumn("start", F.lit(BEFORE)).withColumn("stop", F.lit(OPEN))
                    if table == "offers":
                        offers = offers.unionByName(old)
                    else:
                        refs = refs.unionByName(old.select(*refs.columns))
        probed, probed_path = materialize(spark, probe(refs, offers), "orphans-probed")
        base = spark.read.parquet(self.snapshots[-1]) if self.snapshots else None
        if base is not None:
            last = base.agg(F.max("period")).first()[0]
            base = base.where(F.col("period") == F.lit(last)) if last else base
        if periods or not self.snapshots:
            counts_path = f"{self.folder}/counts-{self.seq}-{uuid.uuid4().hex}"
            _counts(spark, probed, periods, base).withColumn("batch", F.lit(self.seq)).write.parquet(counts_path)
            self.snapshots.append(counts_path)
        if not keep:
            self._last = probed
            release(spark, path)
            return
        fresh = found.where(F.col("stop") == OPEN).select(*RECORD, "newest", "first_day")
        stored = self._stored("records", records)
        if stored is not None:
            fresh = fresh.unionByName(stored.join(fresh.select(*RECORD), RECORD, "left_anti"))
        self._store("records", fresh, RECORD, records)
        self._store("offers", offers.where(F.col("stop") == OPEN).select(*RECORD, *KEY, "first_day"), KEY, keys)
        waiting = F.exists("waits", lambda w: w["stop"] == OPEN)
        self._store("refs", probed.where(F.col("stop") == OPEN).select(*RECORD, "ref_field", *KEY, "first_day", "since", waiting.alias("waiting")), KEY, keys)
        self._save()
        release(spark, path, probed_path)

    def pending(self) -> DataFrame:
        """Open references: record, field, the id they name, the record's first day; ``since`` is set for late parents."""
        out = [*RECORD, "ref_field", *KEY, "first_day", "since"]
        if self._last is not None:
            return self._last.where(F.exists("waits", lambda w: w["stop"] == OPEN)).select(*out)
        stored = self._stored("refs")
        if stored is None:
            return self.spark.createDataFrame([], "table_name string, record_key string, ref_field string, kind string, scope string, ref_id string, first_day date, since date")
        return stored.where("waiting").select(*out)

    def history(self) -> DataFrame:
        """Counts per table, field and month of first delivery, as they stood after each period of each batch."""
        return self.spark.read.parquet(*self.snapshots).where("orphans > 0")


def track(spark: SparkSession, rows: DataFrame, period: str = "quarter") -> OrphanState:
    """All deliveries as one history, with counts at the end of each period (year, quarter, month or week of delivery).

    An empty input gives an empty waiting set and no counts.
    """
    state = OrphanState(spark)
    state.advance(rows, period, keep=False)
    return state
