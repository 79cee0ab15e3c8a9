"""Inverted index and phrase search: postings, consecutive-position match, BM25, and an index kept on disk."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def unicode_tokens(text: Column) -> Column:
    """Runs of letters and digits with case folded and combining marks dropped."""
    plain = F.regexp_replace(F.lower(text), "\\p{Mn}", "")
    return F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(token, doc, col, pos): one row per occurrence; null texts have none."""
    each = F.array(*[F.struct(F.lit(i).alias("col"), unicode_tokens(F.col(c)).alias("ts")) for i, c in enumerate(columns)])
    fields = docs.select(F.col(id_col).alias("doc"), F.explode(each).alias("f"))
    return fields.select("doc", F.col("f.col").alias("col"), F.posexplode("f.ts").alias("pos", "token")).select("token", "doc", "col", "pos")


def lengths(post: DataFrame) -> DataFrame:
    """(doc, n): tokens of each document over all indexed columns."""
    return post.groupBy("doc").agg(F.count("*").alias("n"))


def phrase_hits(post: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc, hits): documents that hold the tokens at consecutive positions of one column.

    Only postings of the phrase's tokens are read; each is shifted to the phrase's start and a start is a
    hit when every token of the phrase votes for it. One shuffle, whatever the phrase's length.
    """
    slots = F.array(*[F.struct(F.lit(t).alias("want"), F.lit(i).alias("at")) for i, t in enumerate(phrase)])
    votes = post.where(F.col("token").isin(sorted(set(phrase)))).select("doc", "col", "token", "pos", F.explode(slots).alias("s")).where("s.want = token")
    starts = votes.groupBy("doc", "col", (F.col("pos") - F.col("s.at")).alias("start")).agg(F.count("*").alias("votes")).where(F.col("votes") == len(phrase))
    return starts.groupBy("doc").agg(F.count("*").alias("hits"))


def _tokens_of(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(unicode_tokens(F.lit(query)).alias("t")).first()[0]


def _bm25(hits: Column, n: Column, n_docs: Column, n_hits: Column, all_tokens: Column) -> Column:
    """Negative BM25 of one phrase: lower is better."""
    idf = F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(1e-6))
    return -idf * hits * (K1 + 1) / (hits + K1 * (1 - B + B * n / (all_tokens / n_docs)))


def phrase_search(docs: DataFrame, id_col: str, columns: list[str], query: str, k: int, scope: Column | None = None) -> DataFrame:
    """(id, rank): the k best documents for the whole query as one phrase; lower rank is better.

    BM25 with corpus-wide statistics; the scope filters after matching and before the limit. A query
    without any letter or digit matches nothing. Ties go to the smaller id. Matches are counted in the row
    that holds the text, so nothing is shuffled; ``PhraseIndex`` reads only the postings of the query.
    """
    if not 1 <= k <= 200:
        raise ValueError("k must lie in 1..200")
    phrase = _tokens_of(docs.sparkSession, query)
    if not phrase:
        return docs.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    # looking ahead without taking finds matches that overlap, too
    wanted = F.lit(f"(?= {' '.join(phrase)} )")
    tokens = docs.select(F.col(id_col), (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))).alias("in_scope"), F.array(*[unicode_tokens(F.col(c)) for c in columns]).alias("ts"))
    spelled = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))), "\n")
    sized = tokens.select(id_col, "in_scope", F.aggregate("ts", F.lit(0).cast("long"), lambda s, t: s + F.size(t)).alias("n"), F.regexp_count(spelled, wanted).alias("hits"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.sum("n").alias("all_tokens"), F.count_if(F.col("hits") > 0).alias("n_hits"))
    scored = sized.where("hits > 0 and in_scope").crossJoin(F.broadcast(stats))  # a one-row side
    return scored.select(id_col, _bm25(F.col("hits"), F.col("n"), F.col("n_docs"), F.col("n_hits"), F.col("all_tokens")).alias("rank")).orderBy("rank", id_col).limit(k)


class PhraseIndex:
    """An inverted index of Parquet segments under one folder, bucketed by token.

    ``add`` writes one segment with the postings, lengths and replaced ids of its documents; documents of
    earlier segments with these ids no longer count. A search reads the buckets of its own tokens and the
    narrow lengths table. ``compact`` merges all segments into one. The list of segments is a small table
    written last, so an interrupted change leaves the old list in force.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: list[str], buckets: int = 64):
        self.spark, self.folder, self.columns, self.buckets = spark, folder.rstrip("/"), columns, buckets
        self.seq, self.segments = 0, []
        path = spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.folder}/lists")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        lists = [s.getPath() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        if lists:
            newest = max(lists, key=lambda p: int(p.getName()))
            self.seq, self.segments = int(newest.getName()), json.loads(spark.read.text(newest.toString()).first()[0])

    def _save(self, segments: list[str]) -> None:
        self.seq, self.segments = self.seq + 1, segments
        self.spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.text(f"{self.folder}/lists/{self.seq}")

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str, removed: DataFrame | None = None) -> None:
        """Index documents; those of equal id before are replaced, ``removed`` ids (one column) only dropped."""
        name = f"{self.folder}/segment-{uuid.uuid4().hex}"
        post = postings(docs, id_col, self.columns).withColumn("bucket", self._bucket(F.col("token")))
        post.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{name}/postings")
        sizes = F.aggregate(F.array(*[F.size(unicode_tokens(F.col(c))) for c in self.columns]), F.lit(0).cast("long"), lambda s, n: s + n)
        docs.select(F.col(id_col).alias("doc"), sizes.alias("n")).write.parquet(f"{name}/lengths")
        gone = docs.select(F.col(id_col).alias("doc"))
        gone = gone if removed is None else gone.unionByName(removed.select(F.col(removed.columns[0]).alias("doc")))
        gone.distinct().write.parquet(f"{name}/gone")
        self._save([*self.segments, name])

    def _live(self, part: str) -> DataFrame | None:
        """A table of all segments without the documents that later segments replace."""
        out = None
        for k, s in enumerate(self.segments):
            df = self.spark.read.parquet(f"{s}/{part}")
            if later := [f"{x}/gone" for x in self.segments[k + 1:]]:
                df = df.join(self.spark.read.parquet(*later).distinct(), "doc", "left_anti")
            out = df if out is None else out.unionByName(df)
        return out

    def compact(self) -> None:
        if len(self.segments) > 1:
            name = f"{self.folder}/segment-{uuid.uuid4().hex}"
            self._live("postings").repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{name}/postings")
            lengths = self._live("lengths")
            lengths.write.parquet(f"{name}/lengths")
            lengths.select("doc").write.parquet(f"{name}/gone")
            self._save([name])

    def search(self, query: str, k: int, scope: DataFrame | None = None) -> DataFrame:
        """(doc, rank) as ``phrase_search``; ``scope`` is a table of allowed documents (one column)."""
        if not 1 <= k <= 200:
            raise ValueError("k must lie in 1..200")
        phrase, post = _tokens_of(self.spark, query), self._live("postings")
        if not phrase or post is None:
            return self.spark.createDataFrame([], "doc long, rank double") if post is None else post.select("doc", F.lit(0.0).alias("rank")).limit(0)
        wanted = self.spark.createDataFrame([(t,) for t in set(phrase)], "t string").select(self._bucket(F.col("t")).alias("b")).distinct().collect()
        hits = phrase_hits(post.where(F.col("bucket").isin([r.b for r in wanted])), phrase)
        sizes = self._live("lengths")
        stats = sizes.agg(F.count("*").alias("n_docs"), F.sum("n").alias("all_tokens"))
        scored = hits.join(sizes, "doc").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(hits.agg(F.count("*").alias("n_hits"))))  # one-row sides
        if scope is not None:
            scored = scored.join(scope.select(F.col(scope.columns[0]).alias("doc")).distinct(), "doc", "left_semi")
        return scored.select("doc", _bm25(F.col("hits"), F.col("n"), F.col("n_docs"), F.col("n_hits"), F.col("all_tokens")).alias("rank")).orderBy("rank", "doc").limit(k)
