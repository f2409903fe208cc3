"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a histogram over log-linear buckets of whole numbers: sixteen
buckets for each power of two, so a quantile is within a sixteenth of its value,
sketches merge by adding counts, and a group's sketch has a bounded size. They
are made for each language and source, merged into sketches for each language
and for everything. A group's limit is its own and its parent's, weighted by the
group's documents against ``PRIOR`` documents of the parent, so that a small group
leans on its language and a small language on everything, without a jump.
A document is rejected where a feature lies beyond the upper quartile by
``spread`` times the distance between the quartiles, that distance being at
least the feature's ``unit``.

Only built-in expressions, joins, aggregates and windows run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import apart, columns_of, let, settle, small_side

#: feature -> least distance between quartiles, in thousandths
UNITS = {"f_symbols": 20, "f_upper": 60, "f_dup_lines": 150, "f_word_length": 1500}
SPREAD = 3
#: Documents that a group's parent counts for in the group's limits.
PRIOR = 100
WINDOW = 5


def _repeated(hashes: Column) -> Column:
    """Words in the windows whose hash occurs twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(x - F.get(starts, k - 1), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"])
        return F.sort_array(F.array_compact(F.transform(ordered, lambda e, k: F.when(same(e, k), e["i"]))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, lambda o: let(places(o), covered)))

    return let(hashes, count)


def _windows(words: Column) -> Column:
    def of(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def features(docs: DataFrame, to: str) -> DataFrame:
    """Add the column ``to``: counts, the base verdict, and features in thousandths.

    Null texts count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(_windows(w)).alias("n_repeat_words"))

    def dup(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def joined(w: Column, d: Column) -> Column:
        n, chars, symbols, upper = w["n_words"], w["word_chars"], F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"), F.regexp_count(text, F.lit("[A-Z]")).cast("long")
        failed = (n < 10) | (w["n_repeat_words"] * 100 > n * 20)
        share = lambda a, b: F.floor(a * 1000 / F.greatest(b, F.lit(1).cast("long"))).cast("long")
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), d["dup"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), share(symbols, chars).alias("f_symbols"), share(upper, chars).alias("f_upper"), share(d["dup"], d["lines"]).alias("f_dup_lines"), share(chars, n).alias("f_word_length"))

    return docs.withColumn(to, let(F.struct(let(words, of).alias("w"), let(lines, dup).alias("d")), lambda x: joined(x["w"], x["d"])))


def bucket_of(value: Column) -> Column:
    e = F.length(F.bin(value)) - 5
    return F.when(value < 16, value).otherwise(e * 16 + F.floor(value / F.pow(F.lit(2.0), e)).cast("long")).cast("int")


def bucket_floor(bucket: Column) -> Column:
    return F.when(bucket < 16, bucket).otherwise((bucket % 16 + 16) * F.pow(F.lit(2.0), F.floor(bucket / 16) - 1)).cast("long")


def sketches(featured: DataFrame, q: str) -> DataFrame:
    """(lang, source, feature, bucket, n) of the documents that pass the base rules."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), bucket_of(F.col(f"{q}.{f}")).alias("bucket")) for f in UNITS))
    return featured.filter(~F.col(f"{q}.base_failed")).select("lang", "source", F.inline(each)).groupBy("lang", "source", "feature", "bucket").agg(F.sum(F.lit(1).cast("long")).alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches to the columns ``by``; one row a group: documents and each feature's limit."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "feature")
    running = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: bucket_floor(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))))
    quartiles = running.groupBy(*by, "feature").agg(F.max("total").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
    unit = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))[F.col("feature")]
    limit = quartiles.withColumn("limit", F.col("q3") + SPREAD * F.greatest(F.col("q3") - F.col("q1"), unit))
    return limit.groupBy(*by).agg(F.max("docs").alias("docs"), *(F.max(F.when(F.col("feature") == f, F.col("limit"))).alias(f) for f in UNITS))


def thresholds(featured: DataFrame, q: str) -> DataFrame:
    """(lang, source, a limit for each feature), a row for each language and source."""
    sketch = settle(sketches(featured, q), "sketches")
    own, lang = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"])
    every = limits(sketch.withColumn("all", F.lit(1)), ["all"]).first()  # one row, none without documents
    joined = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))

    def leaning(side: str, f: str, parent: Column) -> Column:
        n = F.col(f"{side}.docs")
        return F.call_function("div", n * F.col(f"{side}.{f}") + PRIOR * parent, n + PRIOR)

    pick = lambda f: leaning("o", f, leaning("l", f, F.lit(every[f] if every else None).cast("long")))
    return settle(joined.select("o.lang", "o.source", *(pick(f).alias(f) for f in UNITS)), "thresholds")


def judge(featured: DataFrame, q: str, to: str) -> DataFrame:
    """Add the column ``to``: false if a base rule fails or a feature lies beyond its limit."""
    table, p = thresholds(featured, q), apart(featured)
    side = small_side(table).select(*(F.col(c).alias(p + c) for c in table.columns))
    joined = featured.join(side, F.col("lang").eqNullSafe(F.col(f"{p}lang")) & F.col("source").eqNullSafe(F.col(f"{p}source")), "left")
    within = F.lit(True)
    for f in UNITS:
        within = within & F.coalesce(F.col(f"{q}.{f}") <= F.col(p + f), F.lit(True))
    return joined.withColumn(to, ~F.col(f"{q}.base_failed") & within)


def rate(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept.

    Null texts have no words and fail. Null languages and sources are groups of
    their own. Repeated rows each give a row; an empty table gives none. Columns
    but doc_id, text, lang and source are not read. Very long texts are read whole.
    """
    held = settle(features(docs.select("doc_id", "text", "lang", "source"), "_q").drop("text"), "features")
    return judge(held, "_q", "_kept").select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", F.col("_kept").alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The kept documents with their columns, whatever those are called.

    The documents are written once beside their features, so that features are
    found once. Null texts go, null languages and sources are groups of their own,
    repeated rows stay or go together, an empty table stays empty. Texts of any length
    are judged whole.
    """
    p = apart(docs)
    held = settle(features(docs, f"{p}q"), "features")
    return judge(held, f"{p}q", f"{p}kept").filter(F.col(f"{p}kept")).select(*columns_of(docs))


RATE_CTES = r"""
q0 AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
q1 AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM q0),
win AS (SELECT r, s, list_slice(w, s, s + 4) AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3))) AS s FROM q1)),
dup AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM dup) GROUP BY r),
q2 AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(ln) AS n_lines FROM q1 LEFT JOIN rep USING (r)),
q3 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) AS f_symbols, n_upper * 1000 // greatest(word_chars, 1) AS f_upper,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS f_dup_lines, word_chars * 1000 // greatest(n_words, 1) AS f_word_length FROM q2),
f0 AS (SELECT r, lang, source, feature, v FROM (SELECT r, lang, source, base_failed, f_symbols, f_upper, f_dup_lines, f_word_length FROM q3) UNPIVOT (v FOR feature IN (f_symbols, f_upper, f_dup_lines, f_word_length)) WHERE NOT base_failed),
f1 AS (SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS b FROM f0),
lv AS (SELECT 1 AS lv, lang, source, feature, b FROM f1 UNION ALL SELECT 2, lang, NULL, feature, b FROM f1 UNION ALL SELECT 3, NULL, NULL, feature, b FROM f1),
sk AS (SELECT lv, lang, source, feature, b, count(*) AS n FROM lv GROUP BY ALL),
ru AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, feature ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, feature) AS total FROM sk),
qu AS (SELECT lv, lang, source, feature, max(total) AS docs, min(b) FILTER (WHERE upto * 4 >= total) AS b1, min(b) FILTER (WHERE upto * 4 >= total * 3) AS b3 FROM ru GROUP BY ALL),
qv AS (SELECT *, CASE WHEN b1 < 16 THEN b1 ELSE (b1 % 16 + 16) << CAST(b1 // 16 - 1 AS INT) END AS v1, CASE WHEN b3 < 16 THEN b3 ELSE (b3 % 16 + 16) << CAST(b3 // 16 - 1 AS INT) END AS v3 FROM qu),
li AS (SELECT lv, lang, source, docs, feature, v3 + 3 * greatest(v3 - v1, CASE feature WHEN 'f_symbols' THEN 20 WHEN 'f_upper' THEN 60 WHEN 'f_dup_lines' THEN 150 ELSE 1500 END) AS l FROM qv),
th AS (SELECT lv, lang, source, max(docs) AS docs, max(l) FILTER (WHERE feature = 'f_symbols') AS a, max(l) FILTER (WHERE feature = 'f_upper') AS b, max(l) FILTER (WHERE feature = 'f_dup_lines') AS c, max(l) FILTER (WHERE feature = 'f_word_length') AS d FROM li GROUP BY ALL),
pk AS (SELECT o.lang, o.source, list_transform([[o.a, l.a, e.a], [o.b, l.b, e.b], [o.c, l.c, e.c], [o.d, l.d, e.d]], lambda v: (o.docs * v[1] + 100 * ((l.docs * v[2] + 100 * v[3]) // (l.docs + 100))) // (o.docs + 100)) AS x
  FROM th o JOIN th l ON l.lv = 2 AND l.lang IS NOT DISTINCT FROM o.lang JOIN th e ON e.lv = 3 WHERE o.lv = 1),
rated AS (SELECT q3.*, NOT base_failed AND coalesce(f_symbols <= x[1], TRUE) AND coalesce(f_upper <= x[2], TRUE) AND coalesce(f_dup_lines <= x[3], TRUE) AND coalesce(f_word_length <= x[4], TRUE) AS kept
  FROM q3 LEFT JOIN pk ON q3.lang IS NOT DISTINCT FROM pk.lang AND q3.source IS NOT DISTINCT FROM pk.source)
"""
RATE_SQL = f"WITH {RATE_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM rated"
