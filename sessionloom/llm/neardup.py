"""Near-duplicate records by token-combination prefixes.

Records become sets of hashed word runs; records with equal sets collapse to one class. Tokens are
ordered by rising document frequency. Two sets with the wanted similarity share their first two common
tokens within both extended prefixes, so indexing every rare token of that prefix alone and every pair
of its frequent tokens finds all of them: either one of the two is rare, or the pair itself is a key.
Candidates pass a length and a position bound and are then verified by intersecting the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.components import components
from ..runtime import materialize, release, small_side

#: Tokens held by more classes are indexed only in combination with others, which costs a row for each other token.
RARE = 512
#: Posting lists of combinations above this length are extended by one more token where that lessens the pairs.
HOT = 256
MOST_TOKENS = 6
#: The table of frequencies that is sent to the tasks has at most this many places of one byte; beyond, tokens share places.
MOST_KNOWN = 1 << 26
PAGE_BITS = 16
TOKEN_BITS = 40
ODD = ["odd_0", "odd_1"]


def _level(df: np.ndarray) -> np.ndarray:
    """Frequencies as one byte: exact below 32, then eight steps an octave."""
    return np.where(df < 32, df, np.minimum(32 + 8 * np.log2(np.maximum(df, 32) / 32), 255)).astype(np.uint8)


def _page(size: int) -> Callable[[pa.Table], pa.Table]:
    """Arrow function that lays the tokens of a page on their places; a place keeps the highest of its frequencies."""

    def lay(rows: pa.Table) -> pa.Table:
        levels = np.zeros(size, np.uint8)
        np.maximum.at(levels, rows["token"].to_numpy() & (size - 1), _level(rows["df"].to_numpy()))
        return pa.table({"page": rows["page"][:1].cast(pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    return lay


def _sets(items: DataFrame, width: int, least_words: int) -> DataFrame:
    """(id, tokens): sorted distinct hashes of word runs, for items with enough words."""
    def runs(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - (width - 1)),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(width)]), 64 - TOKEN_BITS))
        return F.sort_array(F.array_distinct(hashes))

    # the words are bound once as a lambda variable; an outer explode keeps filters on the result above it,
    # where the optimizer cannot repeat the expression
    spelled = F.filter(F.array(words(F.col("text"))), lambda w: F.size(w) >= max(least_words, width))
    return items.select("id", F.explode_outer(F.transform(spelled, runs)).alias("tokens")).where("tokens is not null")

def _at_least(num: int, den: int, n: Column) -> Column:
    """ceil(num * n / den) in whole numbers."""
    return ((n.cast("long") * num + (den - 1)) / den).cast("long")


def _cutter(known, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function that orders each set by (level, hash) and keeps its extended prefix, without the tokens of no other set.

    Of 128 classes of tokens, odd_0 and odd_1 mark those of which a set holds an odd number.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            sets = batch.column("tokens")
            flat, n = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
            ranked = (levels[flat & (len(levels) - 1)].astype(np.int64) << TOKEN_BITS) | flat
            row = np.repeat(np.arange(len(n)), n)
            ranked = ranked[np.lexsort((ranked, row))]
            keep = np.minimum(n, n - (n * num + den - 1) // den + MOST_TOKENS)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            shared = ranked >= 1 << TOKEN_BITS
            skip = n - np.bincount(row[shared], minlength=len(n))
            held = shared & (place < np.repeat(keep, n))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[held], minlength=len(n))))).astype(np.int32)
            pre = pa.ListArray.from_arrays(pa.array(ends), pa.array(ranked[held]))
            bit = flat >> (TOKEN_BITS - 7)
            marks = [np.bitwise_xor.reduceat(np.where(bit >> 6 == half, np.left_shift(1, bit & 63), 0), np.cumsum(n) - n) if len(n) else n for half in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), pa.array(n, pa.int32()), pa.array(skip, pa.int32()), pre, *map(pa.array, marks)],
                ["class_id", "n", "skip", "pre", "odd_0", "odd_1"])

    return cut


class NearDuplicates:
    """The similarity join of one table of (id, text): classes, links between classes, pairs, groups.

    ``similarity`` is the least Jaccard similarity as a fraction (num, den), ``width`` the words of a
    run, ``least_words`` the least length of an item. Null, empty and shorter texts belong to no class;
    ids must be unique and not null (others are dropped); extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, items: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), least_words: int = 1, rare: int = RARE, hot: int = HOT, most_known: int = MOST_KNOWN):
        self.spark, self.rare, self.hot, self.most_known = spark, rare, hot, most_known
        self.num, self.den = similarity
        self.items = items.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null")
        self.width, self.least_words = width, least_words
        sets = _sets(self.items, width, least_words).select("id", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit(7), "tokens").alias("s2"), "tokens")
        self._sets, self._sets_path = materialize(spark, sets, "neardup-sets")
        signed = self._sets.drop("tokens")
        first = signed.groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id"))
        self.members, _ = materialize(spark, signed.join(first, ["n", "s1", "s2"]).select("id", "class_id"), "neardup-members")
        self._links: DataFrame | None = None
        self._scratch: list[str] = []

    def _prefixes(self) -> DataFrame:
        """(class_id, n, skip, pre, odd_0, odd_1): each class's extended prefix, rarest tokens first, without its first ``skip`` tokens, which no other class has.

        Frequencies are counted over all classes, combined in the map tasks. The order only has to be
        the same everywhere, so a table of one byte for each place that tokens hash to is enough: its
        size is bounded, and where tokens share a place the more frequent one stands for both. The
        prefix is cut in the row that holds the set, and no token row is shuffled to its class.
        """
        copies, firsts = self.members.where("id <> class_id").select("id"), self.members.where("id = class_id").select("id")
        alone = self.members.agg(F.count_if(F.col("id") == F.col("class_id"))).first()[0] * 2 > self.members.count()
        how = (small_side(self.spark, copies, "neardup-copies"), "id", "left_anti") if alone else (small_side(self.spark, firsts, "neardup-firsts"), "id", "left_semi")
        sets = self._sets.select("id", "tokens").join(*how).withColumnRenamed("id", "class_id")
        counted = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        shared, path = materialize(self.spark, counted, "neardup-frequencies")
        bits = min(shared.count().bit_length(), max(self.most_known, 1).bit_length() - 1)
        page = min(bits, PAGE_BITS)
        at = F.shiftright(F.col("token").bitwiseAND((1 << bits) - 1), page).cast("int").alias("page")
        pages = shared.select(at, "token", "df").groupBy("page").applyInArrow(_page(1 << page), "page int, levels binary").toArrow()
        levels = bytearray(1 << bits)
        for no, part in zip(pages["page"].to_pylist(), pages["levels"].to_pylist()):
            levels[no << page:(no + 1) << page] = part
        release(self.spark, path)
        return sets.mapInArrow(_cutter(self.spark.sparkContext.broadcast(bytes(levels)), self.num, self.den), "class_id long, n int, skip int, pre array<long>, odd_0 long, odd_1 long")

    def links(self) -> DataFrame:
        """(class_a, class_b, common, n_a, n_b): pairs of different classes with at least the similarity, a < b."""
        if self._links is not None:
            return self._links
        index = self._index()
        side = lambda x: index.select("key", "one", *[F.col(c).alias(f"{c.removesuffix('_id')}_{x}") for c in ("class_id", "n", "paired", "pos", *ODD)])
        sized = F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num
        behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        wanted = (F.col("n_a") + F.col("n_b")) * self.num
        # two sets differ in a token at least for each mark that only one of them has
        apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ODD), F.lit(0))
        alike = apart * (self.num + self.den) <= (F.col("n_a") + F.col("n_b")) * (self.den - self.num)
        # common tokens lie behind the met one or ahead of it
        met = side("a").join(side("b"), ["key", "one"]).where((F.col("class_a") < F.col("class_b")) & sized & ((behind + F.least("pos_a", "pos_b")) * (self.num + self.den) >= wanted) & alike)
        # every common token from the first on lies behind the first one's position in both sets
        enough = behind * (self.num + self.den) >= wanted
        # common tokens are met alone, or are frequent ones of both prefixes, or lie behind one of the prefixes
        rest = F.greatest(_at_least(self.num, self.den, F.greatest("n_a", "n_b")) - 1, F.lit(0))
        counted = (F.col("met") + F.least("paired_a", "paired_b") + rest) * (self.num + self.den) >= wanted
        sizes = ["n_a", "n_b", "paired_a", "paired_b"]
        pairs = met.groupBy("class_a", "class_b", *sizes).agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"), F.count_if("one").alias("met")).where(enough & counted).select("class_a", "class_b", "n_a", "n_b")
        pairs, pairs_path = materialize(self.spark, pairs, "neardup-candidates")
        met_classes = small_side(self.spark, pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct(), "neardup-candidate-classes")
        texts = self.items.withColumnRenamed("id", "class_id").join(met_classes, "class_id", "left_semi")
        bags = _sets(texts.withColumnRenamed("class_id", "id"), self.width, self.least_words).select(F.col("id").alias("class_id"), F.col("tokens").alias("t"))
        both = pairs.join(bags.select(F.col("class_id").alias("class_a"), F.col("t").alias("t_a")), "class_a").join(bags.select(F.col("class_id").alias("class_b"), F.col("t").alias("t_b")), "class_b")
        checked = both.withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
        near = checked.where(F.col("common") * (self.num + self.den) >= (F.col("n_a") + F.col("n_b")) * self.num)
        self._links, _ = materialize(self.spark, near.select("class_a", "class_b", "common", "n_a", "n_b"), "neardup-links")
        release(self.spark, pairs_path, *self._scratch)
        self._scratch.clear()
        return self._links

    def _index(self) -> DataFrame:
        """Posting rows (class_id, n, odd_0, odd_1, paired, key, one, pos): single rare tokens and combinations of frequent ones.

        Sets so small that one common token suffices have their frequent tokens indexed alone, too.

        A combination's posting list above ``hot`` classes is replaced by those of all its extensions by
        one later token of prefixes extended as far, if these together make fewer pairs; a set of near
        copies, which every extension keeps together, stays with the shorter key. Whether a key is
        extended depends on the key alone, so both sides of a pair meet at the same length. Sets so
        small that fewer common tokens than the extension has suffice stay with the shorter key, too.
        """
        pre, path = materialize(self.spark, self._prefixes(), "neardup-prefixes")
        self._scratch.append(path)
        release(self.spark, self._sets_path)
        rare = int(_level(np.array([self.rare]))[0])
        o = _at_least(self.num, self.den, F.col("n"))
        numbered = pre.select("class_id", "n", *ODD, (F.col("n") - o).alias("free"), F.transform("pre", lambda t, i: F.struct(F.shiftright(t, TOKEN_BITS).alias("level"), t.alias("token"), (i + F.col("skip")).alias("pos"))).alias("pre"))
        single = F.transform(F.filter("pre", lambda t: ((t["level"] <= rare) | (o < 2)) & (t["pos"] <= F.col("free"))), lambda t: F.struct(t["token"].alias("key"), t["pos"].alias("pos"), t["pos"].alias("last"), F.lit(True).alias("one")))
        common = F.filter("pre", lambda t: (t["level"] > rare) & (t["pos"] <= F.col("free") + 1))
        split = numbered.select("class_id", "n", *ODD, single.alias("single"), common.alias("common"))
        double = F.flatten(F.transform("common", lambda x, i: F.transform(
            F.slice(F.col("common"), i + 2, F.size("common")),
            lambda y: F.struct(F.xxhash64(x["token"], y["token"]).alias("key"), x["pos"].alias("pos"), y["pos"].alias("last"), F.lit(False).alias("one")))))
        posted = split.select("class_id", "n", *ODD, F.size("common").alias("paired"), F.explode(F.concat("single", double)).alias("k")).select("class_id", "n", *ODD, "paired", "k.*")
        hot, path = self._hot_keys(posted.where("not one"))
        self._scratch.append(path)
        if hot.isEmpty():
            return posted.drop("last")
        level, kept = posted.where("not one"), [posted.where("one")]
        tails = numbered.select("class_id", "free", "pre")
        for size in range(3, MOST_TOKENS + 1):
            chosen = small_side(self.spark, hot, "neardup-hot")
            reach = F.filter("pre", lambda t: (t["pos"] > F.col("last")) & (t["pos"] <= F.col("free") + (size - 1)))
            longer = level.join(chosen, "key", "left_semi").join(tails, "class_id").select("class_id", "n", *ODD, "paired", F.col("key").alias("stem"), "pos", F.explode(reach).alias("t")).select(
                "class_id", "n", *ODD, "paired", "stem", F.xxhash64("stem", "t.token").alias("key"), "pos", F.col("t.pos").alias("last"), F.lit(False).alias("one"))
            longer, path = materialize(self.spark, longer, "neardup-longer")
            self._scratch.append(path)
            square = F.col("held").cast("double") * F.col("held")
            spread = longer.groupBy("stem", "key").agg(F.count("*").alias("held")).groupBy("stem").agg(F.sum(square).alias("after"))
            gains = spread.join(hot, spread["stem"] == hot["key"]).where("after < before").select("stem")
            gains = small_side(self.spark, gains, "neardup-extended")
            kept.append(level.join(gains, level["key"] == gains["stem"], "left_anti"))
            kept.append(level.where(o < size).join(gains, level["key"] == gains["stem"], "left_semi"))
            level = longer.join(gains, "stem", "left_semi").drop("stem")
            hot, path = self._hot_keys(level)
            self._scratch.append(path)
            if hot.isEmpty():
                break
        kept.append(level)
        out = kept[0]
        for k in kept[1:]:
            out = out.unionByName(k)
        return out.drop("last")

    def _hot_keys(self, level: DataFrame) -> tuple[DataFrame, str]:
        """(key, before) of combinations with more than ``hot`` classes; before is the square of their number."""
        held = level.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > self.hot)
        return materialize(self.spark, held.select("key", (F.col("held").cast("double") * F.col("held")).alias("before")), "neardup-hot")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), a < b: every pair of items, copies within a class included."""
        m = self.members
        left, right = m.select(F.col("class_id").alias("class_a"), F.col("id").alias("x")), m.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
        across = self.links().select("class_a", "class_b").join(left, "class_a").join(right, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        inside = left.join(right, F.col("class_a") == F.col("class_b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        return across.unionByName(inside)

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): each item's class, the group of linked classes and its class's number of links."""
        edges = self.links().select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        joined = components(self.spark, edges).withColumnRenamed("node", "class_id").withColumnRenamed("component", "group_id")
        degree = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
        return self.members.join(joined, "class_id", "left").join(degree, "class_id", "left").select(
            "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
