"""Queries on ordered lines: timelines, windows, sorting, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text as tx
from linewright.operators import summary, timeline
from linewright.plans.registry import query

TIMED = """
tl0 AS (SELECT *, coalesce(length(text), 0) AS n, lead(role) OVER w AS nr, lead(1) OVER w AS nx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tl1 AS (SELECT *, CASE WHEN nx IS NULL THEN 0 WHEN nr IS NOT DISTINCT FROM role THEN 20000 ELSE 40000 END AS gap_after FROM tl0),
tl AS (SELECT *, CAST(80000 + coalesce(sum(n + gap_after) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample FROM tl1)
"""


def timed(t):
    """Conversations as archives: a turn is a line of as many frames as characters, a role is a group."""
    return timeline.resolve(t("conversations"), ["conv_id"], ["turn"], "role", F.length("text"), 8000, strict=False)


@query(f"WITH {TIMED} SELECT conv_id, turn, start_sample, start_sample + n AS end_sample, CAST(gap_after AS BIGINT) AS gap_after, start_sample + n + gap_after AS next_start FROM tl")
def timeline_resolve(t):
    return timed(t).select("conv_id", "turn", "start_sample", "end_sample", "gap_after", "next_start")


@query(f"""WITH {TIMED}, s AS (
  SELECT conv_id, turn, 'intro' AS kind, CAST(0 AS BIGINT) AS start_sample, CAST(80000 AS BIGINT) AS n_samples FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM tl) WHERE r = 1
  UNION ALL SELECT conv_id, turn, 'voice', start_sample, n FROM tl
  UNION ALL SELECT conv_id, turn, CASE WHEN gap_after = 20000 THEN 'between' ELSE 'chapter' END, start_sample + n, gap_after FROM tl WHERE gap_after > 0)
SELECT * FROM s""")
def timeline_segments(t):
    return timeline.segments(timed(t), ["conv_id"], ["turn"], 20000, 80000)


@query("""WITH a AS (SELECT *, lead(p_brand) OVER w AS nb, lead(1) OVER w AS nx FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)),
b AS (SELECT *, CASE WHEN nx IS NULL THEN 0 WHEN nb = p_brand THEN 12000 ELSE 24000 END AS g FROM a)
SELECT p_type, p_partkey, CAST(72000 + coalesce(sum(p_size * 100 + g) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample,
row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS track FROM b""")
def timeline_retime_by_group(t):
    lines = timeline.resolve(t("part"), ["p_type"], ["p_partkey"], "p_brand", F.col("p_size") * 100, 8000, intro=9.0, same_gap=1.5, group_gap=3.0)
    return timeline.occurrences(lines, ["p_type"], ["p_partkey"]).select("p_type", "p_partkey", "start_sample", F.col("occurrence").cast("long").alias("track"))


@query("SELECT conv_id, count(*) FILTER (WHERE r > 1 AND p IS DISTINCT FROM role) AS boundaries, count(*) AS lines FROM (SELECT *, lag(role) OVER w AS p, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id")
def group_boundaries(t):
    return timeline.boundaries(t("conversations"), ["conv_id"], ["turn"], "role")


MS = "(epoch_us(ts) // 1000)"


def clips(t):
    """Events as clips of a tenth of a second: start and end in milliseconds."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return t("events").withColumn("start_ms", ms).withColumn("end_ms", ms + 100)


@query(f"""WITH g AS (SELECT user_id, greatest(0, {MS} - lag({MS} + 100) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, CAST(min(gap) FILTER (WHERE r > 1) AS BIGINT) AS min_gap_ms, CAST(greatest(0, min(gap) FILTER (WHERE r > 1) - 400) AS BIGINT) AS remaining_ms,
coalesce(400 * 100 > 60 * min(gap) FILTER (WHERE r > 1), FALSE) AS warning, coalesce(400 > min(gap) FILTER (WHERE r > 1), FALSE) AS exceeds FROM g GROUP BY user_id""")
def min_adjacent_gap(t):
    lines = timeline.gaps(clips(t), ["user_id"], ["ts", "event_id"], F.col("start_ms"), F.col("end_ms"))
    gap = F.min("gap_before")
    return lines.groupBy("user_id").agg(gap.alias("min_gap_ms"), F.when(gap.isNotNull(), F.greatest(F.lit(0).cast("long"), gap - 400)).otherwise(0).alias("remaining_ms"), F.coalesce(gap * 60 < 400 * 100, F.lit(False)).alias("warning"), F.coalesce(gap < 400, F.lit(False)).alias("exceeds"))


@query(f"""WITH e AS (SELECT *, {MS} AS s, {MS} + 100 AS x FROM events),
f AS (SELECT *, lead(s) OVER w AS ns, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(CASE WHEN r = 1 THEN least(200, greatest(0, s)) ELSE 200 END AS BIGINT) AS fade_in, CAST(300 AS BIGINT) AS fade_out, ns IS NOT NULL AND 500 > greatest(0, ns - x) AS too_tight FROM f""")
def fade_windows(t):
    return timeline.fades(clips(t), ["user_id"], ["ts", "event_id"], F.col("start_ms"), F.col("end_ms"), 200, 300).select("user_id", "event_id", "fade_in", "fade_out", "too_tight")


@query(f"""WITH e AS (SELECT *, {MS} AS s, {MS} + 100 AS x FROM events),
f AS (SELECT *, lead(s) OVER w AS ns, lag(x) OVER w AS px, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, greatest(0, s - coalesce(px, 0)) AS gb, greatest(0, ns - x) AS ga FROM f)
SELECT user_id, event_id, CAST(least(1500, CASE WHEN r = 1 THEN gb WHEN gb < 3000 THEN gb // 2 ELSE gb END) AS BIGINT) AS before,
CAST(CASE WHEN ns IS NULL THEN 1500 ELSE least(1500, CASE WHEN ga < 3000 THEN ga // 2 ELSE ga END) END AS BIGINT) AS after FROM g""")
def local_envelope(t):
    return timeline.envelope(clips(t), ["user_id"], ["ts", "event_id"], F.col("start_ms"), F.col("end_ms"), 1500).select("user_id", "event_id", "before", "after")


@query("""WITH w AS (SELECT *, substr(text, 1, 1) AS k FROM conversations),
a AS (SELECT *, CASE WHEN lag(k) OVER o = k AND k <> '' THEN lag(text) OVER o END AS context_before, CASE WHEN lead(k) OVER o = k AND k <> '' THEN lead(text) OVER o END AS context_after FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, context_before, context_after FROM a WHERE role = 'assistant' AND text <> ''""")
def neighbor_context(t):
    lines = t("conversations").withColumn("k", F.left("text", F.lit(1)))
    return timeline.neighbours(lines, ["conv_id"], ["turn"], "text", "k").filter("role = 'assistant' and text <> ''").select("conv_id", "turn", "context_before", "context_after")


@query("""WITH a AS (SELECT *, last_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM orders)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS at, CAST(l AS VARCHAR) AS last_valid FROM a WHERE o_orderstatus <> 'P' AND o_orderdate < l""")
def non_monotonic_rows(t):
    rows = timeline.non_monotonic(t("orders"), ["o_custkey"], ["o_orderkey"], "o_orderdate", F.col("o_orderstatus") != "P")
    return rows.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("at"), F.col("last_valid").cast("string").alias("last_valid"))


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE}) AS r FROM lineitem) WHERE r > 1")
def duplicate_occurrences(t):
    rows = timeline.occurrences(t("lineitem"), ["l_orderkey", "l_linenumber"], LINE.split(", ")).filter("occurrence > 1")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS w FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
d AS (SELECT *, sum(w) OVER (PARTITION BY n_regionkey) AS t FROM c),
e AS (SELECT *, CASE WHEN t > 0 THEN w * 10000 // t ELSE 0 END AS f, CASE WHEN t > 0 THEN w * 10000 % t ELSE 0 END AS r FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY r DESC, n_nationkey) AS k, CASE WHEN t > 0 THEN 10000 - sum(f) OVER (PARTITION BY n_regionkey) ELSE 0 END AS left_over FROM e)
SELECT n_regionkey, n_nationkey, CAST(f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS units FROM g""")
def largest_remainder(t):
    counted = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("w"))
    return timeline.apportion(counted, ["n_regionkey"], ["n_nationkey"], "w", 10000).select("n_regionkey", "n_nationkey", "units")


CATEGORY = r"""CASE WHEN regexp_matches(text, '(?i)<[^>]+>|\{[^}]+\}|RUBY') THEN 'tags_placeholders' WHEN contains(lower(text), 'theabout') THEN 'hsr_terminology' WHEN length(text) >= 140 THEN 'long_complex' WHEN length(text) <= 45 THEN 'short_context_sensitive'
WHEN regexp_matches(text, '(?i)\.\.\.|[!?~—]|\b(?:don''t|isn''t|aren''t|can''t|won''t|wouldn''t|couldn''t|shouldn''t)\b') THEN 'expressive_dialogue' ELSE 'general' END"""


@query(f"""WITH s AS (SELECT conv_id, turn, {CATEGORY} AS stratum, sha256('seed-1' || chr(0) || conv_id || '/' || turn || chr(0) || text) AS h FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn FROM s)
SELECT conv_id, turn, stratum, rn AS round FROM r ORDER BY rn, stratum LIMIT 50""")
def stratified_sample(t):
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = summary.stratified(t("conversations"), tx.sample_category(F.col("text"), ("theabout",), ascii_words=True), F.concat(key, F.char(F.lit(0)), "text"), "seed-1", 50)
    return rows.select("conv_id", "turn", "stratum", "round")


@query("""WITH p AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS c, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS dn, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
t1 AS (SELECT p_partkey, p_brand FROM p WHERE c > 1 AND dn <= 2),
t2 AS (SELECT min(p_partkey) AS p_partkey FROM p WHERE p_brand NOT IN (SELECT p_brand FROM t1) GROUP BY p_brand),
t3 AS (SELECT p_partkey FROM p WHERE i IN (SELECT k * (SELECT count(*) FROM part) // 600 FROM range(0, 600) r(k))),
a AS (SELECT p_partkey, 1 AS tier FROM t1 UNION ALL SELECT p_partkey, 2 FROM t2 UNION ALL SELECT p_partkey, 3 FROM t3 UNION ALL SELECT p_partkey, 4 FROM part),
m AS (SELECT p_partkey, min(tier) AS tier FROM a GROUP BY p_partkey)
SELECT p_partkey, CAST(tier AS INT) AS tier FROM m ORDER BY tier, p_partkey LIMIT 200""")
def priority_sample(t):
    return summary.covering(t("part"), "p_partkey", "p_name", "p_brand", 200)


@query("SELECT page_id, row_number() OVER (ORDER BY host, d, page_id) AS place FROM (SELECT page_id, regexp_extract(url, '://([^/?#0-9]*)', 1) AS host, CAST(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS BIGINT) AS d FROM pages)")
def natural_sort_rank(t):
    """Paths of one host stand in the order of their numbers; places are counted within hosts and added up."""
    host, number = F.regexp_extract("url", "://([^/?#0-9]*)", 1), F.regexp_extract("url", "(/[a-z]+/[0-9]+)", 1)
    pages = t("pages").select("page_id", host.alias("host"), tx.natural_key(F.regexp_replace(number, "^/[a-z]+", "")).alias("key"), F.regexp_extract("url", "/[a-z]+/([0-9]+)", 1).try_cast("long").alias("number"))
    return summary.placed(pages, "host", ["number", "key", "page_id"]).select("page_id", "place")


@query("""WITH f AS (SELECT c_custkey, c_custkey % 9 AS f FROM customer),
m AS (SELECT c_custkey, CASE WHEN f = 1 THEN 0 WHEN f = 0 OR (f = 4 AND c_custkey % 5 = 0) OR (f = 7 AND c_custkey % 2 = 0) THEN 1 WHEN f = 2 THEN 2 WHEN f = 3 THEN 3 WHEN f IN (4, 5) THEN 4 WHEN f = 6 OR (f = 8 AND c_custkey % 2 = 0) THEN 5 ELSE 6 END AS rank,
CASE WHEN f = 0 THEN c_custkey % 7 WHEN f = 4 AND c_custkey % 5 = 0 THEN 3 WHEN f = 7 AND c_custkey % 2 = 0 THEN 3 WHEN f = 3 THEN c_custkey % 4 WHEN f = 4 THEN 999 WHEN f = 5 THEN c_custkey % 6 ELSE 0 END AS number,
CASE WHEN f = 2 THEN 'chapterfinality' || c_custkey % 3 WHEN f = 6 THEN 'anecdote_' || c_custkey % 50 ELSE '' END AS name FROM f)
SELECT c_custkey, CAST(rank AS INT) AS rank, CAST(number AS BIGINT) AS number, row_number() OVER (PARTITION BY rank, number, name ORDER BY c_custkey) AS place FROM m""")
def chapter_order(t):
    """Lines in the order of their stories: family, number, name, then index."""
    from linewright.plans.records import families

    lines = families(t).withColumn("r", tx.chapter_rank(tx.classify_group(F.col("member"), F.col("declared"))["major"])).select("c_custkey", "r.*")
    return timeline.occurrences(lines, ["rank", "number", "name"], ["c_custkey"]).select("c_custkey", "rank", "number", F.col("occurrence").cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r <= greatest(0, 6000 - (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'))")
def retention(t):
    return summary.retain(t("orders"), F.col("o_orderstatus") == "P", [F.desc("o_orderdate"), F.desc("o_orderkey")], 6000).select("o_orderkey", "o_orderstatus")


@query("""WITH m AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), h AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 150)
SELECT user_id, CAST(last AS VARCHAR) AS last FROM m WHERE user_id NOT IN (SELECT user_id FROM h) ORDER BY m.last DESC, user_id LIMIT 20""")
def recent_first(t):
    """The twenty most recent users that are not hidden."""
    hidden = t("events").filter("event_type = 'purchase' and value > 150").select("user_id").distinct()
    last = t("events").groupBy("user_id").agg(F.max("ts").alias("last")).join(hidden, "user_id", "left_anti")
    return last.orderBy(F.desc("last"), "user_id").limit(20).select("user_id", F.col("last").cast("string").alias("last"))


@query(f"""WITH {TIMED}, s AS (SELECT conv_id, turn, CAST(start_sample AS DOUBLE) / 8000 AS a FROM tl)
SELECT conv_id, turn, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS ass
FROM (SELECT *, CAST(round_even(a * 1000, 0) AS BIGINT) AS m, CAST(round_even(a * 100, 0) AS BIGINT) AS c FROM s)""")
def time_format(t):
    seconds = F.col("start_sample").cast("double") / 8000
    return timed(t).select("conv_id", "turn", tx.clock(seconds).alias("srt"), tx.ass_clock(seconds).alias("ass"))


@query(f"""WITH {TIMED}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CAST(round_even(CAST(start_sample AS DOUBLE) / 8, 0) AS BIGINT) AS a, CAST(round_even(CAST(start_sample + n AS DOUBLE) / 8, 0) AS BIGINT) AS b FROM tl WHERE trim(text) <> ''),
f AS (SELECT conv_id, k, k || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS block FROM c)
SELECT conv_id, string_agg(block, chr(10) ORDER BY k) AS srt FROM f GROUP BY conv_id""")
def srt_blocks(t):
    from linewright.sources.exports import render_srt

    return render_srt(timed(t), "conv_id", "turn", "text", F.col("start_sample").cast("double") / 8000, F.col("end_sample").cast("double") / 8000)
