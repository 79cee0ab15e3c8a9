"""Texts cut off by field limits or transfers, found from n-gram counts in pure SQL.

Lines become token sequences in which numbers, identifiers, paths and CJK runs are one class each.
Every trigram is counted once over the corpus, inside lines and at line ends, within its kind of line;
bigram, word and shape counts are rolled up from that table. The final trigram of each text is joined to
the counts in two ways. As it stands: frequent inside but almost never final means that the text stops
inside a sentence. As the beginning of longer trigrams: its last token hardly ever stands between these
neighbours, but often begins what does, so the text stops inside a word; the counts of all longer trigrams
are one difference of running sums over the sorted tokens of a context. Where trigrams lack support,
bigrams, words and word shapes decide in the same two ways. A text that leaves a code fence open or ends
in a broken character is cut, too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WS_CLASS
from ..runtime import materialize, small_side

#: Occurrences that let an n-gram decide, and the largest share of final ones among them for a cut.
SUPPORT = 15
RATE = 0.03
#: Fewer occurrences suffice to clear a text if at least half of them are final.
CLEARING = 3

# One token: letters and digits joined by - _ . / inside, an ellipsis of dots, or any other visible character.
_TOKEN = r"[\p{L}\p{N}]+(?:[-_./]+[\p{L}\p{N}]+)*|\.\.\.|[^WS\p{L}\p{N}]".replace("WS", WS_CLASS)
_BREAKS = r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+"
_VISIBLE = f"ascii(l) BETWEEN 33 AND 126 OR l RLIKE r'[^{WS_CLASS}]'"

# Expressions over a token t.
_NORM = r"""CASE WHEN t RLIKE r'^\p{Ll}+$' THEN t
  WHEN t RLIKE r'^\p{N}+$' THEN '0'
  WHEN t RLIKE r'[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]' THEN '<cjk>'
  WHEN t RLIKE r'[\p{L}\p{N}].*[./]' THEN '<path>'
  WHEN t RLIKE r'\p{L}[-_]+\p{L}|[-_]\p{N}' THEN '<joined>'
  WHEN t RLIKE r'^\p{Ll}+\p{Lu}' THEN '<camel>'
  WHEN t RLIKE r'^\p{Lu}[\p{Lu}\p{N}]+$' THEN '<code>'
  ELSE lower(t) END"""


def _shape(t: str, n: str) -> str:
    """The shape of a token t with class n; the first test spares most tokens the patterns."""
    return (f"CASE WHEN {n} = {t} AND ascii({n}) BETWEEN 97 AND 122 THEN '<w>' WHEN ascii({n}) = 60 OR {n} = '0' OR NOT {n} RLIKE r'^\\p{{L}}' THEN {n} "
            f"WHEN {t} RLIKE r'^\\p{{Lu}}' THEN '<W>' ELSE '<w>' END")


def _stem(t: str, n: str) -> str:
    """The spelling that can be cut inside: not of CJK runs, and not with a digit at its end, which might begin another number."""
    return f"CASE WHEN {n} = {t} AND ascii({n}) BETWEEN 97 AND 122 THEN {t} WHEN {t} RLIKE r'\\p{{L}}$' AND {n} <> '<cjk>' THEN lower({t}) END"


# The views are outer ones: the filters that the optimizer derives from inner ones would repeat the expressions below them.
_LINES = f"""
WITH split AS (SELECT doc_id, source, counted, filter(split(text, r'{_BREAKS}'), l -> {_VISIBLE}) AS ls FROM {{docs}}),
line AS (
  SELECT doc_id, source, counted, @fence AS open_fence, regexp_extract_all(l, r'{_TOKEN}', 0) AS raw FROM split LATERAL VIEW OUTER explode(@lines) x AS l),
bare AS (
  SELECT doc_id, source, counted, open_fence,
    CASE WHEN size(raw) > 1 AND try_element_at(raw, -1) IN ('…', '...') THEN slice(raw, 1, size(raw) - 1) ELSE raw END AS ts FROM line),
normed AS (SELECT *, transform(ts, t -> {_NORM}) AS ns FROM bare),
shaped AS (SELECT *, transform(arrays_zip(ts, ns), z -> {_shape('z.ts', 'z.ns')}) AS ss FROM normed)
SELECT doc_id, source, counted, open_fence, ts, ns, ss,
  CASE WHEN get(ss, 0) = '<w>' THEN get(ns, 0) WHEN get(ss, 0) = '<path>' AND get(ns, 1) = ':' THEN '<path>:' ELSE get(ss, 0) END AS kind FROM shaped
"""
# Every line of every text for the counts; the last line alone for the finals.
_EVERY = _LINES.replace("@fence", "false").replace("@lines", "ls")
_LAST = _LINES.replace("@fence", "size(filter(ls, l -> startswith(ltrim(l), '```'))) % 2 = 1").replace("@lines", "slice(ls, -1, 1)")

_GRAMS = f"""
SELECT kind, t2, t1, t, shape, stem, count_if(NOT final) AS inside, count_if(final) AS ends FROM (
  SELECT kind, coalesce(get(ns, i - 2), '^') AS t2, coalesce(get(ns, i - 1), '^') AS t1, ns[i] AS t, ss[i] AS shape,
    {_stem('ts[i]', 'ns[i]')} AS stem, i = size(ns) - 1 AS final
  FROM (SELECT *, explode_outer(CASE WHEN size(ns) > 0 THEN sequence(0, size(ns) - 1) END) AS i FROM {{lines}}) WHERE i IS NOT NULL)
GROUP BY ALL
"""

_FINALS = f"""
SELECT doc_id, source, counted, open_fence, kind, coalesce(get(ns, size(ns) - 3), '^') AS t2, coalesce(get(ns, size(ns) - 2), '^') AS t1, t, shape,
  {_stem('last', 't')} AS stem, last = '\\ufffd' AS broken
FROM (SELECT *, try_element_at(ns, -1) AS t, try_element_at(ss, -1) AS shape, try_element_at(ts, -1) AS last FROM {{lines}})
"""

# Levels of back-off, the most specific first: the columns that identify an n-gram, and the name of its rule.
_LEVELS = [
    (("kind", "t2", "t1", "t"), "trigram"), (("t2", "t1", "t"), "trigram"), (("kind", "t1", "t"), "bigram"), (("t1", "t"), "bigram"),
    (("kind", "t"), "word"), (("kind", "shape"), "shape"), (("shape",), "shape"),
]
# Contexts in which a last token is compared with the tokens that it begins.
_CONTEXTS = [(("t2", "t1"), "trigram"), (("t1",), "bigram"), ((), "word")]

# Counts of the tokens that continue a stem (mass) and of the stem itself (own) in one context @c. Sorted by spelling, the
# continuations of a stem lie together behind it, so each count is the difference of two running sums.
_STEMS = """
WITH tok AS (SELECT @c stem, sum(inside) AS inside, sum(ends) AS ends FROM {grams} WHERE stem IS NOT NULL GROUP BY @c stem),
want AS (SELECT DISTINCT @c stem FROM {finals} WHERE stem IS NOT NULL),
probe AS (SELECT *, explode(array(named_struct('at', stem, 'place', 0), named_struct('at', stem, 'place', 2), named_struct('at', concat(stem, chr_last()), 'place', 3))) AS p FROM want),
mixed AS (
  SELECT @c stem AS at, inside, ends, 1 AS place, CAST(NULL AS STRING) AS stem FROM tok
  UNION ALL SELECT @c p.at, 0L, 0L, p.place, stem FROM probe),
summed AS (SELECT *, sum(inside) OVER w AS upto, sum(inside + ends) OVER w AS all_upto FROM mixed
  WINDOW w AS (PARTITION BY @c substring(at, 1, 1) ORDER BY at, place ROWS UNBOUNDED PRECEDING))
SELECT @c stem, max(CASE WHEN place = 3 THEN upto END) - max(CASE WHEN place = 2 THEN upto END) AS mass,
  max(CASE WHEN place = 2 THEN all_upto END) - max(CASE WHEN place = 0 THEN all_upto END) AS own
FROM summed WHERE place <> 1 GROUP BY @c stem
""".replace("chr_last()", "decode(unhex('F48FBFBF'), 'UTF-8')")  # the last code point sorts behind every continuation


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL whose {name} stand for DataFrames; the views live only while it is analysed."""
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in tables}
    for k, df in tables.items():
        df.createOrReplaceTempView(names[k])
        text = text.replace(f"{{{k}}}", names[k])
    try:
        return spark.sql(text)
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def _judged() -> str:
    """Finals with the counts of every level (i, e) and of every context (m, o); the text's own n-gram is no evidence about itself."""
    joins, cols = [], []
    for k, (keys, _) in enumerate(_LEVELS):
        on = " AND ".join(f"f.{c} = g{k}.{c}" for c in keys)
        joins.append(f"LEFT JOIN (SELECT {', '.join(keys)}, sum(inside) AS inside, sum(ends) AS ends FROM {{grams}} GROUP BY {', '.join(keys)}) g{k} ON {on}")
        cols.append(f"coalesce(g{k}.inside, 0) AS i{k}, greatest(coalesce(g{k}.ends, 0) - f.counted::int, 0) AS e{k}")
    for k, (keys, _) in enumerate(_CONTEXTS):
        on = " AND ".join(f"f.{c} = c{k}.{c}" for c in (*keys, "stem"))
        joins.append(f"LEFT JOIN ({_STEMS.replace('@c', ''.join(f'{c}, ' for c in keys))}) c{k} ON {on}")
        cols.append(f"coalesce(c{k}.mass, 0) AS m{k}, greatest(coalesce(c{k}.own, 0) - f.counted::int, 0) AS o{k}")
    return f"SELECT f.*, {', '.join(cols)} FROM {{finals}} f " + " ".join(joins)


def _decision() -> str:
    """The deciding rule and what it says, as 'rule:verdict'."""
    def level(k: int) -> str:
        total, rule = f"(i{k} + e{k})", _LEVELS[k][1]
        return (f"WHEN {total} >= {CLEARING} AND e{k} >= 0.5 * {total} THEN '{rule}:whole' "
                f"WHEN {total} >= {SUPPORT} THEN CASE WHEN e{k} <= {RATE} * {total} THEN '{rule}:sentence' ELSE '{rule}:whole' END")

    def begun(k: int) -> str:
        rare = lambda j: f"m{j} >= {SUPPORT} AND o{j} <= greatest(1, {RATE} * m{j})"
        test = rare(k)
        if k < len(_CONTEXTS) - 1:  # identifiers and paths are built freely: a neighbourhood alone does not tell a whole one from a part
            last = len(_CONTEXTS) - 1
            test += f" AND (shape IN ('<w>', '<W>') OR {rare(last)})"
        else:
            test += f" AND i3 + e3 < {CLEARING}"
        return f"WHEN {test} THEN '{_CONTEXTS[k][1]}:word'"

    fixed = "WHEN broken THEN 'character:character' WHEN open_fence THEN 'fence:fence'"
    return f"CASE {begun(0)} {fixed} {level(0)} {level(1)} {begun(1)} {level(2)} {level(3)} {begun(2)} {level(4)} {level(5)} {level(6)} ELSE 'none:whole' END"


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, source, verdict, rule) of every document with a visible character.

    verdict: whole, or what the text stops in (character, fence, word, sentence; table rows and JSON
    values count as sentences of their kind of line); rule: the n-gram order, or the test, that decided.
    ``docs`` needs doc_id, text and source; other columns are ignored. Null, empty and blank texts are
    whole and left out. Equal texts count once in the statistics, so copies of a cut text are no evidence
    for its ending, but each is judged. Words of any length take part.
    """
    rows = docs.selectExpr("doc_id", "text", "source").where(f"text RLIKE r'[^{WS_CLASS}]'")
    known, _ = materialize(spark, rows.selectExpr("doc_id", "xxhash64(text) AS h", "length(text) AS n"), "truncation-hashes")
    again = _sql(spark, "SELECT k.doc_id FROM {k} k JOIN (SELECT h, n, min(doc_id) AS first FROM {k} GROUP BY h, n HAVING count(*) > 1) f ON k.h = f.h AND k.n = f.n WHERE k.doc_id <> f.first", k=known)
    marked = _sql(spark, "SELECT d.*, a.doc_id IS NULL AS counted FROM {docs} d LEFT JOIN {again} a ON d.doc_id = a.doc_id", docs=rows, again=small_side(spark, again, "truncation-copies"))
    grams, _ = materialize(spark, _sql(spark, _GRAMS, lines=_sql(spark, _EVERY, docs=marked.where("counted"))), "truncation-grams")
    finals, _ = materialize(spark, _sql(spark, _FINALS, lines=_sql(spark, _LAST, docs=marked)), "truncation-finals")
    judged = _sql(spark, _judged(), finals=finals, grams=grams)
    return _sql(spark, f"SELECT doc_id, source, substring_index(found, ':', -1) AS verdict, substring_index(found, ':', 1) AS rule FROM (SELECT *, {_decision()} AS found FROM {{judged}})", judged=judged)


def by_source(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(source, documents, cut, cut_share, by_trigram): by_trigram counts the cut texts that trigrams decided; a null source is its own group."""
    return _sql(spark, """SELECT d.source, count(*) AS documents, count_if(j.verdict <> 'whole') AS cut, round(count_if(j.verdict <> 'whole') / count(*), 6) AS cut_share,
      count_if(j.verdict <> 'whole' AND j.rule = 'trigram') AS by_trigram
      FROM {docs} d LEFT JOIN {j} j ON d.doc_id = j.doc_id GROUP BY d.source""", docs=docs.select("doc_id", "source"), j=judge(spark, docs).select("doc_id", "verdict", "rule"))
