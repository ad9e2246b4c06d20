"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document gets a few whole numbers (word counts, symbols, repeated lines and windows, capitals).  Each of
the five measures is the number of occurrences in a document of the corpus's typical size: the count itself for
a document up to the median size in the measure's units (words, lines or characters), the count scaled down to
that size for a longer one; plus one.  Measures go, in thousandths, into mergeable quantile sketches per language
and source: counts of buckets that keep the seven leading bits of a value, so a value is off by less than 1/64,
a rank by nothing, and a sketch has at most 3,712 buckets however many documents it holds.  Sketches add up
whatever the order of merging; those of sources merge into that of their language, these into that of all
documents, which serve groups of fewer than ``min_group`` documents (a rank of 0.9 then has a sampling error
of at most 0.01).

The sketches alone set the fences, by the same rule for every measure: the fence lies ``spread`` times as far
above the upper quantile (``UPPER``) as this lies above the median, on a logarithmic scale; a group whose
quantiles are less than a doubling apart counts as one doubling apart.  So what a tenth of a source's documents
has is normal there, and a rare excess over it is not.  The fences are then joined back.

Defined cases: null or empty text has no words and fails the base rule; null languages and sources are
groups of their own; repeated rows count and are judged alike; an empty table gives an empty table;
columns other than doc_id, text, lang and source are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, WORD, broadcast_if_small, save

#: Measures with a fence: what is counted, and in units of which size.
MEASURES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"), "long_words": ("word_chars", "n_words")}
SIZES = ("n_words", "n_lines", "word_chars")
MIN_GROUP, UPPER, SPREAD = 1000, 90, 3
BROADCAST_GROUPS = 50_000


def counts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source and the counts, from one reading of the text."""
    text, w = F.coalesce(F.col("text"), F.lit("")), P + "w"
    rows = docs.select("doc_id", "lang", "source", text.alias(P + "t")).withColumn(w, F.regexp_extract_all(P + "t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(P + "t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(P + "t") - F.length(F.regexp_replace(P + "t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(P + "t") - F.length(F.regexp_replace(P + "t", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        lines.alias(P + "l"),
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias(P + "h"),
    )
    repeated = F.size(F.array_distinct(P + "h")) < F.size(P + "h")
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_capitals",
        F.size(P + "l").cast("long").alias("n_lines"),
        (F.size(P + "l") - F.size(F.array_distinct(P + "l"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(F.transform(P + "h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(P + "s"),
    )
    same = lambda x, j: (x["h"] == F.get(P + "s", j - 1)["h"]) | (x["h"] == F.get(P + "s", j + 1)["h"])
    covered = F.flatten(F.transform(F.filter(P + "s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col(P + "s").isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)).cast("long")).drop(P + "l", P + "s")


def bucket(v: str) -> Column:
    """The sketch's bucket of a whole number: its seven leading bits."""
    return F.expr(f"{v} - {v} % shiftleft(1L, greatest(0, length(bin({v})) - 7))")


def quantile(q: int) -> Column:
    """The lowest bucket whose running count holds ``q`` percent of all."""
    return F.min(F.when(F.col(P + "run") * 100 >= F.col(P + "all") * q, F.col(P + "b")))


def running(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged by ``keys`` and measure, with running and total counts.  A window holds one sketch: 3,712 rows at most."""
    by = Window.partitionBy(*keys, P + "m")
    merged = sketch.groupBy(*keys, P + "m", P + "b").agg(F.sum(P + "n").alias(P + "n"))
    return merged.withColumn(P + "run", F.sum(P + "n").over(by.orderBy(P + "b"))).withColumn(P + "all", F.sum(P + "n").over(by))


def typical_sizes(rows: DataFrame) -> dict[str, int]:
    """The median of each size over all documents with a word (1 where there are none)."""
    sized = rows.filter("n_words > 0").select(F.explode(F.create_map(*[x for k in SIZES for x in (F.lit(k), F.col(k))])).alias(P + "m", P + "v"))
    sketch = sized.groupBy(P + "m", bucket(P + "v").alias(P + "b")).agg(F.count(F.lit(1)).alias(P + "n"))
    found = {r[P + "m"]: r["q"] for r in running(sketch, []).groupBy(P + "m").agg(quantile(50).alias("q")).collect()}  # three rows
    return {k: max(found.get(k, 1), 1) for k in SIZES}


def measures(typical: dict[str, int]) -> dict[str, Column]:
    """Each measure in thousandths, by integer division."""
    return {k: F.expr(f"1000 + ({n} * 1000 * {typical[size]}L) div greatest({size}, {typical[size]}L)") for k, (n, size) in MEASURES.items()}


def thresholds(rows: DataFrame, typical: dict[str, int], min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """One row per (lang, source): an upper fence for each measure, from the group's sketches or those they merge into."""
    valued = F.create_map(*[x for k, c in measures(typical).items() for x in (F.lit(k), c)])
    sketch = rows.filter("n_words > 0").select("lang", "source", F.explode(valued).alias(P + "m", P + "v")).groupBy("lang", "source", P + "m", bucket(P + "v").alias(P + "b")).agg(F.count(F.lit(1)).alias(P + "n"))
    sketch = save(sketch, "rules-sketch")

    def fences(keys: list[str]) -> DataFrame:
        quantiles = running(sketch, keys).groupBy(*keys, P + "m").agg(quantile(50).cast("double").alias(P + "mid"), quantile(UPPER).cast("double").alias(P + "up"), F.first(P + "all").alias(P + "all"))
        ratio, fence = F.greatest(F.col(P + "up") / F.col(P + "mid"), F.lit(2.0)), F.col(P + "up")
        for _ in range(spread):
            fence = fence * ratio
        each = [F.max(F.when(F.col(P + "m") == k, F.col(P + "f"))).alias(f"{P}{k}{len(keys)}") for k in MEASURES]
        return quantiles.withColumn(P + "f", fence).groupBy(*keys).agg(F.max(P + "all").alias(f"{P}n{len(keys)}"), *each)

    own, lang, total = fences(["lang", "source"]), fences(["lang"]), fences([])
    lang = lang.withColumnRenamed("lang", P + "lang")
    joined = own.join(lang, own["lang"].eqNullSafe(lang[P + "lang"])).crossJoin(F.broadcast(total))  # total has one row
    pick = lambda k: F.when(F.col(P + "n2") >= min_group, F.col(f"{P}{k}2")).when(F.col(P + "n1") >= min_group, F.col(f"{P}{k}1")).otherwise(F.col(f"{P}{k}0"))
    return joined.select(F.col("lang").alias(P + "lang"), F.col("source").alias(P + "source"), *[pick(k).alias(f"{P}max_{k}") for k in MEASURES])


def judge(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """Per document: the counts, ``base_failed`` and ``kept``."""
    rows = save(counts(docs), "rules-counts")
    typical = typical_sizes(rows)
    limits = save(thresholds(rows, typical, min_group, spread), "rules-limits")
    limits = broadcast_if_small(limits, BROADCAST_GROUPS)
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits[P + "lang"]) & rows["source"].eqNullSafe(limits[P + "source"]), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    above = [F.coalesce(c > F.col(f"{P}max_{k}"), F.lit(False)) for k, c in measures(typical).items()]
    outlier = above[0]
    for x in above[1:]:
        outlier = outlier | x
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~outlier).drop(*[c for c in joined.columns if c.startswith(P)])


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
e AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM x)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM e),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY rid),
c AS (SELECT x.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM x LEFT JOIN p ON p.rid = x.rid),
z AS (SELECT v - v % (1::BIGINT << greatest(0, length(bin(v)) - 7)) AS b, k FROM (SELECT unnest([n_words, n_lines, word_chars]) AS v, unnest([1, 2, 3]) AS k FROM c WHERE n_words > 0)),
zz AS (SELECT k, min(b) AS q FROM (SELECT k, b, count(*) OVER (PARTITION BY k) AS a, rank() OVER (PARTITION BY k ORDER BY b) + count(*) OVER (PARTITION BY k, b) - 1 AS run FROM z) WHERE run * 2 >= a GROUP BY k),
y AS (SELECT greatest(coalesce(max(q) FILTER (k = 1), 1), 1) AS w, greatest(coalesce(max(q) FILTER (k = 2), 1), 1) AS l, greatest(coalesce(max(q) FILTER (k = 3), 1), 1) AS ch FROM zz),
m AS (SELECT c.*, 1000 + (n_symbols * 1000 * w) // greatest(n_words, w) AS v1, 1000 + (n_dup_lines * 1000 * l) // greatest(n_lines, l) AS v2, 1000 + (n_repeat_words * 1000 * w) // greatest(n_words, w) AS v3,
             1000 + (n_capitals * 1000 * ch) // greatest(word_chars, ch) AS v4, 1000 + (word_chars * 1000 * w) // greatest(n_words, w) AS v5 FROM c, y),
u AS (SELECT lang, source, k, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 7)) AS b
      FROM (SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS k, unnest([v1, v2, v3, v4, v5]) AS v FROM m WHERE n_words > 0)),
g AS (SELECT 2 AS lv, lang, source, k, b FROM u UNION ALL SELECT 1, lang, NULL, k, b FROM u UNION ALL SELECT 0, NULL, NULL, k, b FROM u),
q AS (SELECT lv, lang, source, k, max(a) AS n, (min(b) FILTER (run * 100 >= a * 50))::DOUBLE AS mid, (min(b) FILTER (run * 100 >= a * 90))::DOUBLE AS up FROM (
        SELECT *, count(*) OVER (PARTITION BY lv, lang, source, k) AS a, rank() OVER (PARTITION BY lv, lang, source, k ORDER BY b) + count(*) OVER (PARTITION BY lv, lang, source, k, b) - 1 AS run FROM g)
      GROUP BY lv, lang, source, k),
f AS (SELECT *, up * greatest(up / mid, 2.0::DOUBLE) * greatest(up / mid, 2.0::DOUBLE) * greatest(up / mid, 2.0::DOUBLE) AS f FROM q),
h AS (SELECT lv, lang, source, max(n) AS n, max(f) FILTER (k = 1) AS f1, max(f) FILTER (k = 2) AS f2, max(f) FILTER (k = 3) AS f3, max(f) FILTER (k = 4) AS f4, max(f) FILTER (k = 5) AS f5 FROM f GROUP BY lv, lang, source),
j AS (SELECT m.*, a.n AS n2, b.n AS n1,
             CASE WHEN a.n >= 1000 THEN [a.f1, a.f2, a.f3, a.f4, a.f5] WHEN b.n >= 1000 THEN [b.f1, b.f2, b.f3, b.f4, b.f5] ELSE [z.f1, z.f2, z.f3, z.f4, z.f5] END AS lim
      FROM m LEFT JOIN h a ON a.lv = 2 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
             LEFT JOIN h b ON b.lv = 1 AND b.lang IS NOT DISTINCT FROM m.lang LEFT JOIN h z ON z.lv = 0),
o AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND v1 <= lim[1] AND v2 <= lim[2] AND v3 <= lim[3] AND v4 <= lim[4] AND v5 <= lim[5]) AS kept
FROM o
"""
