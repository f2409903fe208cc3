"""Benchmark decontamination with a distributed positional inverted index.

1. Frequencies of the benchmark's terms are counted over all training tokens.
2. Each window of a benchmark item names its two rarest terms; windows with the
   same two places share them, so a run of windows needs few lists.
3. One pass over the training tokens makes the index of the rarest terms: a
   posting (document, position) with the item places it may stand for. The second
   rarest term must be at its offset for an exact phrase, or within reach for a
   proximity match, or the posting isn't stored.
4. Stored postings are verified word by word against the item's words.

Only built-in expressions, joins, aggregates and windows run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import BROADCAST_BYTES, apart, ascii_lower, bytes_of, columns_of, let, settle, small_side

#: Words of a text that a token's row carries, besides its neighbours.
CHUNK = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def around(words: Column, position: Column, reach: int) -> Column:
    """2 * reach + 1 words with the one at ``position`` in the middle, null beyond the ends."""
    return F.transform(F.sequence(position - reach, position + reach), lambda i: F.get(words, i))


def frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n) of the benchmark's terms over all training tokens."""
    terms = settle(items.select(F.explode("words").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    if bytes_of(terms) <= BROADCAST_BYTES:
        counted = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:
        counted = tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")
    return settle(counted, "frequencies")


def anchors(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The places of the two rarest terms of each item's windows: item, need, j1, t1, j2, t2."""
    # a window whose rarest term never occurs is dropped
    placed = items.select("item", F.posexplode("words").alias("at", "term")).join(frequencies(docs, items), "term", "left")
    listed = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("list"))
    n = F.size("list")
    starts = listed.withColumn("n", n).withColumn("need", F.least(n, F.lit(window))).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("need"))).alias("start"))
    cut = F.transform(F.slice("list", F.col("start") + 1, F.col("need")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))
    two = starts.select("item", "need", F.slice(F.array_sort(cut), 1, 2).alias("two")).filter(F.col("two")[0]["n"] > 0)
    first, second = F.col("two")[0], F.coalesce(F.get("two", F.lit(1)), F.col("two")[0])
    return two.select("item", "need", first["at"].alias("j1"), first["term"].alias("t1"), second["at"].alias("j2"), second["term"].alias("t2")).distinct()


def chunks(words: Column, reach: int) -> Column:
    """Arrays of CHUNK words with ``reach`` more on both sides, so that a token's row is small however long its text.

    struct(start, lead, words): the place of the first own word, and how many words stand before it.
    """
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK)))

    def cut(start: Column) -> Column:
        lead = F.least(start, F.lit(reach))
        return F.struct(start.alias("start"), lead.alias("lead"), F.slice(words, start - lead + 1, lead + CHUNK + reach).alias("words"))

    return F.transform(starts, cut)


def postings(docs: DataFrame, marks: DataFrame, window: int, near: bool) -> DataFrame:
    """doc_id, h, at, hits, doc_words of the rarest terms' stored places, and n_words at each document's first word.

    The item places of a term are one row of the side that is broadcast; a
    benchmark too large for one broadcast takes a pass over the documents for each
    part of it that is small enough.
    """
    parts = 1 + bytes_of(marks) // BROADCAST_BYTES
    reach, found = window - 1, []
    for part in range(parts):
        held = marks.filter(F.pmod(F.xxhash64("t1"), F.lit(parts)) == part)
        places = held.groupBy(F.col("t1").alias("wanted")).agg(F.collect_list(F.struct("item", "need", "j1", "j2", "t2")).alias("places"))
        cut = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), chunks(w, reach).alias("chunks")))
        each = docs.select("doc_id", F.xxhash64("text").alias("h"), cut.alias("w")).select("doc_id", "h", "w.n", F.explode_outer("w.chunks").alias("c"))
        tokens = each.select("doc_id", "h", "n", "c.start", "c.lead", F.col("c.words").alias("near"), F.posexplode_outer(F.slice("c.words", F.col("c.lead") + 1, F.lit(CHUNK))).alias("k", "term"))
        first = F.coalesce(F.col("start") + F.col("k"), F.lit(0)) == 0
        met = tokens.join(F.broadcast(places), F.col("term") == F.col("wanted"), "left").filter(F.col("wanted").isNotNull() | first)
        words, at = F.col("near"), F.col("lead") + F.col("k")
        close = F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, 2 * reach + 1 - F.greatest(reach - at, F.lit(0)))
        exact = lambda x: F.coalesce(F.get(words, at - x["j1"] + x["j2"]) == x["t2"], F.lit(False))
        fits = (lambda x: exact(x) | F.array_contains(close, x["t2"])) if near else exact
        judged = met.select("doc_id", "h", (F.col("start") + F.col("k")).alias("at"), (F.when(first, F.col("n")) if part == 0 else F.lit(None).cast("long")).alias("n_words"), F.filter("places", fits).alias("hits"), around(words, at, reach).alias("doc_words"))
        found.append(judged.filter(F.col("n_words").isNotNull() | (F.size("hits") > 0)))
    return settle(reduce(DataFrame.unionByName, found), "postings")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, near_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, places) of exact phrases, and with ``near_words`` of near ones.

    documents: doc_id, h (hash of the text; both name a document), n_words.
    places: doc_id, h, item_id, kind (exact or near), first and last position.
    A near place has at least ``near_words`` different words of the item's
    neighbourhood within window - 1 words of a window's rarest term, the second
    rarest among them, in any order.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = settle(items.distinct().withColumn("item", F.xxhash64("item_id", "words")), "items")
    marks = settle(anchors(docs, items, window), "anchors")
    index = postings(docs, marks, window, near_words is not None)
    documents = index.filter(F.col("n_words").isNotNull()).select("doc_id", "h", "n_words")

    texts = small_side(items.select(F.col("item").alias("i"), "item_id", F.col("words").alias("item_text")))
    hits = index.filter(F.size("hits") > 0).select("doc_id", "h", "at", "doc_words", F.inline("hits"))
    met = hits.join(texts, F.col("item") == F.col("i")).withColumn("item_words", around(F.col("item_text"), F.col("j1"), window - 1))
    equal = F.array_join(F.transform(F.arrays_zip("doc_words", "item_words"), lambda z: F.when(z["doc_words"] == z["item_words"], "1").otherwise("0")), "")
    run = met.filter(F.get("doc_words", F.col("j2") - F.col("j1") + window - 1) == F.col("t2")).withColumn("equal", equal)
    left = F.length(F.regexp_extract(F.substring("equal", 1, window - 1), "1*$", 0))
    right = F.length(F.regexp_extract(F.substring("equal", window + 1, window - 1), "^1*", 0))
    run = run.select("doc_id", "h", "item_id", "need", (F.col("at") - left).alias("first"), (F.col("at") + right).alias("last"))
    places = run.filter(F.col("last") - F.col("first") + 1 >= F.col("need")).select("doc_id", "h", "item_id", F.lit("exact").alias("kind"), "first", "last").distinct()
    if near_words is not None:
        shared = F.size(F.array_intersect(F.array_compact("doc_words"), F.array_compact("item_words")))
        fits = F.array_contains("doc_words", F.col("t2")) & (shared >= F.least(F.lit(near_words), F.col("need")))
        near = met.filter(fits).select("doc_id", "h", "item_id", F.lit("near").alias("kind"), F.greatest(F.col("at") - window + 1, F.lit(0)).alias("first"), (F.col("at") + window - 1).alias("last")).distinct()
        places = settle(places, "exact")
        exact = places.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("item_id").alias("i2")).distinct()
        near = near.join(exact, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & F.col("item_id").eqNullSafe(F.col("i2")), "left_anti")
        places = places.unionByName(near)
    return documents, places


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, near_words: int = 8) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts the items near which the document comes without an exact phrase.
    Null and wordless texts have no words and no hits; an item without words is
    no window, and an item whose id is null hits but is not counted. Repeated
    rows each give a row. Empty tables give no rows or no hits. Columns but doc_id
    and text are not read; very long texts are read whole.
    """
    documents, places = matches(docs, benchmark, window, near_words)
    places = settle(places, "places")
    by_doc = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    exact = F.col("kind") == "exact"
    spans = places.filter(exact).select("doc_id", "h", "first", "last").distinct()
    before = F.coalesce(F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    hit = spans.select("doc_id", "h", F.greatest(F.lit(0), F.col("last") - F.greatest(before, F.col("first") - 1)).alias("new")).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    named = places.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.when(exact, F.col("item_id").cast("string")))).alias("ids"), F.count_distinct(F.when(~exact, F.col("item_id"))).alias("n_near"))
    found = named.alias("b").join(hit.alias("a"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left").select(F.col("b.doc_id").alias("d2"), F.col("b.h").alias("h2"), "n_hit", "ids", "n_near")
    out = documents.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hits = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hits.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without an exact benchmark window, columns unchanged, whatever they are called.

    Null texts stay; repeated rows stay or go together; with an empty benchmark all stay,
    an empty table stays empty. Texts of any length are searched whole.
    """
    p = apart(docs)
    _, places = matches(docs, benchmark, window)
    hit = settle(places.select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h")).distinct(), "hit")
    met = F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64("text") == F.col(f"{p}h"))
    return docs.join(small_side(hit), met, "left_anti").select(*columns_of(docs))


CONTAMINATION_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, s + 1, s + least(10, len(w))) AS g
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
gram AS (
  SELECT r, s, k, list_slice(w, s + 1, s + k) AS g
  FROM (SELECT r, w, k, unnest(range(0, greatest(0, len(w) - k + 1))) AS s FROM doc, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, s, gram.k AS k, item_id FROM gram JOIN win ON gram.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
cnt AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM doc) GROUP BY term),
it AS (SELECT DISTINCT item_id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
pl AS (SELECT item_id, w, k, p, w[p + 1] AS term FROM (SELECT item_id, w, k, unnest(range(0, len(w))) AS p FROM it)),
st AS (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM it),
rk AS (SELECT st.item_id, st.w, st.k, s, p, pl.term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY st.item_id, st.w, s ORDER BY coalesce(n, 0), p) AS q
  FROM st JOIN pl ON st.item_id IS NOT DISTINCT FROM pl.item_id AND st.w = pl.w AND p BETWEEN s AND s + st.k - 1 LEFT JOIN cnt ON cnt.term = pl.term),
mk AS (SELECT DISTINCT a.item_id, a.k, a.p AS j1, a.term AS t1, coalesce(b.term, a.term) AS t2, list_slice(a.w, greatest(a.p - 8, 1), a.p + 10) AS nb
  FROM rk a LEFT JOIN rk b ON b.item_id IS NOT DISTINCT FROM a.item_id AND b.w = a.w AND b.s = a.s AND b.q = 2 WHERE a.q = 1 AND a.n > 0),
po AS (SELECT r, term, list_slice(w, greatest(p - 8, 1), p + 10) AS dw FROM (SELECT r, w, p, w[p + 1] AS term FROM (SELECT r, w, unnest(range(0, len(w))) AS p FROM doc)) WHERE term IN (SELECT t1 FROM mk)),
nr AS (SELECT r, count(DISTINCT item_id) AS n_near FROM po JOIN mk ON t1 = term
  WHERE list_contains(dw, t2) AND len(list_intersect(list_distinct(dw), list_distinct(nb))) >= least(8, k) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.r = po.r AND hit.item_id = mk.item_id) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS j FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM doc LEFT JOIN pos USING (r) LEFT JOIN ids USING (r) LEFT JOIN nr USING (r)
"""
