"""Queries on audits, roll-ups and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text as tx
from linewright.operators import audits, changes, summary, timeline
from linewright.operators.tables import spread
from linewright.plans.registry import query
from linewright.sources.tables import latest_snapshot


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS k, l_partkey AS p, l_quantity AS s, l_quantity + l_linenumber AS e FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1),
v AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY k) AS pe FROM w),
b AS (SELECT l_orderkey, k, CASE WHEN s < 0 OR e > 45.05 THEN 'outside' WHEN s < coalesce(pe, 0) THEN 'non_monotonic' END AS problem FROM v)
SELECT l_orderkey, arg_min(problem, k) FILTER (WHERE problem IS NOT NULL) AS problem, count(*) AS words FROM b GROUP BY l_orderkey""")
def word_timing_check(t):
    order = ["l_partkey", "l_suppkey", "l_quantity"]
    one = timeline.occurrences(t("lineitem"), ["l_orderkey", "l_linenumber"], order).filter("occurrence = 1")
    word = F.struct(F.col("l_linenumber").alias("k"), F.lit("w").alias("word"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"))
    lines = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return lines.select("l_orderkey", audits.word_timing_problem(F.col("words"), F.lit(45.0)).alias("problem"), F.size("words").cast("long").alias("words"))


@query("""WITH a AS (SELECT doc_id, CASE quality * 2 + toxic WHEN 2 THEN 'Yes' WHEN 3 THEN 'unclear' WHEN 0 THEN '' ELSE 'NO' END AS v FROM labels UNION ALL SELECT doc_id, 'yes' FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, count(*) AS answers, CASE WHEN bool_or(lower(v) = 'no') THEN 'no' WHEN bool_or(lower(v) = 'unclear') THEN 'unclear' WHEN bool_or(v = '') THEN 'missing' ELSE 'yes' END AS status FROM a GROUP BY doc_id""")
def review_rollup(t):
    k = F.col("quality") * 2 + F.col("toxic")
    a = t("labels").select("doc_id", F.when(k == 2, "Yes").when(k == 3, "unclear").when(k == 0, "").otherwise("NO").alias("v"))
    return audits.review_rollup(a.unionByName(t("documents").filter("doc_id % 3 = 0").select("doc_id", F.lit("yes").alias("v"))), "doc_id", "v").select("doc_id", "answers", "status")


@query("""WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
u AS (SELECT conv_id, turn, unnest(a) AS token, 1 AS s FROM c WHERE b IS NOT NULL UNION ALL SELECT conv_id, turn, unnest(b), -1 FROM c WHERE b IS NOT NULL),
d AS (SELECT conv_id, turn, token, sum(s) AS d FROM u GROUP BY ALL HAVING sum(s) <> 0)
SELECT conv_id, turn, token, CAST(greatest(d, 0) AS BIGINT) AS missing, CAST(greatest(-d, 0) AS BIGINT) AS extra FROM d""")
def token_multiset_difference(t):
    from pyspark.sql import Window

    rows = t("conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    return audits.multiset_difference(rows, ["conv_id", "turn"], F.split("text", " "), F.split("next", " ")).select("conv_id", "turn", "token", F.col("missing").cast("long").alias("missing"), F.col("extra").cast("long").alias("extra"))


@query("SELECT source, lang, count(*) AS lines, count(*) FILTER (WHERE trim(text) <> '') AS with_source, count(quality) AS with_target, min(doc_id) AS first FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def group_coverage(t):
    rows = t("documents").join(t("labels").select("doc_id", F.col("quality").cast("string").alias("target")), "doc_id", "left")
    return audits.group_coverage(rows, ["source"], "lang", "doc_id", "text", "target")


@query("""WITH v AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0), m AS (SELECT p_brand, part.p_name, p_type, v.p_name AS k FROM part LEFT JOIN v ON part.p_name = v.p_name),
e AS (SELECT p_brand, count(DISTINCT k) AS covered, count(k) AS texts FROM m GROUP BY p_brand),
s AS (SELECT p_brand, covered, texts, covered / (SELECT count(*) FROM v) * 1000 + texts + CASE WHEN p_brand LIKE '%1' THEN 5 ELSE 0 END AS score FROM e)
SELECT *, row_number() OVER (ORDER BY score DESC, p_brand) AS rank FROM s""")
def candidate_scores(t):
    return audits.candidate_scores(t("part"), t("part").filter("p_partkey % 2 = 0").select("p_name"), "p_brand", "p_name", "p_type", F.when(F.col("p_brand").endswith("1"), 5).otherwise(0))


@query("WITH r AS (SELECT doc_id, lang, md5(text) AS p FROM documents), f AS (SELECT source, lang, doc_id, CAST(n_chars % 500 AS VARCHAR) AS p FROM documents) SELECT doc_id, (SELECT min(g.doc_id) FROM f g WHERE g.lang = 'fr' AND g.p = f.p) AS pair FROM f WHERE lang = 'en'")
def reference_pairs(t):
    rows = t("documents").select("doc_id", "lang", (F.col("n_chars") % 500).cast("string").alias("p"))
    return audits.reference_pairs(rows, "lang", "p", "doc_id", "en", "fr").select("doc_id", "pair")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' || p_partkey END AS member, p_name FROM part), m AS (SELECT p_partkey, 'm' || p_partkey AS member, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS p_name FROM part WHERE p_partkey % 7 <> 0)
SELECT c.p_partkey, CASE WHEN m.member IS NOT NULL THEN m.p_name WHEN i.p_partkey IS NOT NULL THEN i.p_name ELSE c.p_name END AS p_name, CASE WHEN m.member IS NOT NULL THEN 'member' WHEN i.p_partkey IS NOT NULL THEN 'index' ELSE 'none' END AS route
FROM c LEFT JOIN m ON m.member = c.member LEFT JOIN m i ON c.member = '' AND i.p_partkey = c.p_partkey""")
def training_rows(t):
    k, s = F.col("p_partkey"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    corrected = t("part").select("p_partkey", F.when(k % 3 == 0, "").otherwise(s).alias("member"), "p_name")
    manifest = t("part").filter("p_partkey % 7 <> 0").select("p_partkey", s.alias("member"), F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("p_name"))
    return audits.training_rows(corrected, manifest, "member", "p_partkey", ["p_name"], "p_partkey").select("p_partkey", "p_name", "route")


@query("SELECT o_orderkey // 100 * 100 AS page, string_agg(DISTINCT o_orderkey, ',' ORDER BY o_orderkey) AS positions FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def page_buckets(t):
    return audits.page_buckets(t("orders").filter("o_orderstatus = 'P'"), "o_orderkey").select("page", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("""SELECT event_type, CAST(coalesce(sum(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 1000 END), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 77 END), 0) AS BIGINT) AS output_tokens, bool_or(event_id % 4 = 0) AS incomplete, count(*) AS calls, (input_tokens * 2.5 + output_tokens * 10.0) / 1000000.0 AS cost FROM events GROUP BY event_type""")
def usage_ledger(t):
    k, s = F.col("event_id") % 4, lambda n: (F.col("event_id") % n).cast("string")
    usage = F.when(k == 0, F.lit('{"other": 1}')).when(k == 1, F.concat(F.lit('{"prompt_tokens": '), s(1000), F.lit(', "completion_tokens": '), s(77), F.lit("}"))).when(k == 2, F.concat(F.lit('{"input_tokens": '), s(1000), F.lit(', "output_tokens": "'), s(77), F.lit('"}')))
    ledger = audits.usage_ledger(t("events").withColumn("u", usage.otherwise(F.concat(F.lit('{"usage": {"input": '), s(1000), F.lit(', "output": '), s(77), F.lit("}}")))), ["event_type"], "u")
    return ledger.withColumn("cost", audits.cost(F.col("input_tokens"), F.col("output_tokens"), 2.5, 10.0))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity - 10 > 0 THEN l_quantity - 10 ELSE nullif(l_partkey / 8000.0, 0) END WHEN 1 THEN nullif(l_partkey / 8000.0, 0) END AS duration FROM lineitem")
def duration_chain(t):
    k = F.col("l_linenumber") % 3
    start, end = F.when(k == 0, "10").otherwise("x"), F.when(k == 0, F.col("l_quantity").cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", audits.duration_of(start, end, F.col("l_partkey").cast("string"), F.when(k == 2, "0").otherwise("8000")).alias("duration"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'calm' WHEN 'MACHINERY' THEN 'unmarked' ELSE lower(c_mktsegment) END AS emotion, left(regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '..', '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 12) AS slug FROM customer")
def normal_values(t):
    value = F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return t("customer").select("c_custkey", audits.normal_value(value, {"building": "calm"}, "unmarked").alias("emotion"), tx.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("..")), 12).alias("slug"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, CAST(max(epoch(ts)) AS DOUBLE) AS at, CASE WHEN n - max(epoch(ts)) <= 86400 THEN 'fresh' WHEN n - max(epoch(ts)) <= 604800 THEN 'stale' ELSE 'expired' END AS state FROM events, (SELECT epoch(TIMESTAMP '2024-01-10 00:00:00') AS n) GROUP BY user_id, n")
def snapshot_age(t):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    return latest_snapshot(t("events").select("user_id", "event_id", at), "user_id", "at", "event_id", 1704844800.0)


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'applied' ELSE 'open' END AS state FROM orders WHERE o_orderstatus = 'O'")
def subtract_applied(t):
    applied = t("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    rest, done = changes.subtract(t("orders").filter("o_orderstatus = 'O'"), applied, "o_orderkey")
    return rest.select("o_orderkey", F.lit("open").alias("state")).unionByName(done.select("o_orderkey", F.lit("applied").alias("state")))


OUTCOMES = ["verified", "mismatch", "missing", "unverifiable", "ambiguous", "changed_during_verify", "normalization_ambiguous"]


@query(f"""WITH s AS (SELECT lang, CASE WHEN doc_id % 8 = 0 THEN 'unverifiable' WHEN doc_id % 13 = 0 THEN 'ambiguous' WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'changed_during_verify' WHEN doc_id % 7 > 0 THEN 'verified' WHEN doc_id % 3 = 0 THEN 'normalization_ambiguous' ELSE 'mismatch' END AS o FROM documents)
SELECT lang, {', '.join(f"count(*) FILTER (WHERE o = '{o}') AS {o}" for o in OUTCOMES)}, count(*) AS total FROM s GROUP BY ROLLUP (lang)""")
def source_audit(t):
    from linewright.sources.archives import source_outcome

    k, data = F.col("doc_id"), F.encode("text", "UTF-8")
    expected = F.when(k % 8 == 0, "abc").when(k % 7 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    rows = t("documents").withColumn("o", source_outcome(expected, F.when(k % 9 != 0, data), k % 13 == 0, k % 11 == 0, k % 3 == 0))
    return summary.pivot(rows, "lang", "o", OUTCOMES)


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang, b ORDER BY doc_id) * CASE WHEN b THEN 1 END AS number, b AS in_band FROM (SELECT doc_id, lang, n_chars / 100.0 BETWEEN 3 AND 10 AS b FROM documents WHERE doc_id % 3 = 0)""")
def reference_pack(t):
    from linewright.sources.exports import reference_pack as pack

    return pack(t("documents"), "lang", F.col("doc_id") % 3 == 0, F.col("n_chars") / 100.0, ["doc_id"]).select("doc_id", "number", "in_band")


@query("SELECT conv_id, turn, '[[' || conv_id || '.' || turn || ' ' || sha256(text) || ']]' || chr(10) || 'SOURCE: ' || replace(text, chr(10), ' ') || chr(10) || 'TARGET: ' || role || chr(10) AS block FROM conversations")
def review_blocks(t):
    from linewright.sources.exports import review_block

    key = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t("conversations").select("conv_id", "turn", review_block(key, F.col("text"), F.col("role")).alias("block"))


@query("SELECT doc_id, sha256(text) AS sha256, base64(encode(text)) AS data FROM documents")
def recovery_package(t):
    from linewright.sources.exports import recovery_package as package

    rows = package(t("documents").select("doc_id", F.encode("text", "UTF-8").alias("c")), "doc_id", "c")
    return rows.withColumn("data", F.regexp_replace("data", r"\s", ""))


@query("""WITH l AS (SELECT p_partkey, p_name, p_brand || p_size AS logical, 'm' || p_partkey AS member FROM part), r AS (SELECT p_partkey AS rid, CASE WHEN p_partkey % 4 = 0 THEN 'm' || p_partkey * 3 ELSE '' END AS member, CASE WHEN p_partkey % 4 = 1 THEN p_brand || (p_size + 1) ELSE '' END AS logical, p_name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 4 = 1),
x AS (SELECT rid, 0 AS route, l.p_partkey FROM r JOIN l ON r.member = l.member UNION ALL SELECT rid, 1, v FROM r JOIN (SELECT logical, max(p_partkey) AS v FROM l GROUP BY logical) k ON r.logical = k.logical
UNION ALL SELECT rid, 2, v FROM r JOIN (SELECT p_name, max(p_partkey) AS v FROM l GROUP BY p_name HAVING count(*) = 1) k ON r.p_name = k.p_name)
SELECT rid, arg_min(p_partkey, route) AS p_partkey, CAST(min(route) AS INT) AS route FROM x GROUP BY rid""")
def import_resolution(t):
    from linewright.operators.matching import by_routes

    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    lines = t("part").select("p_partkey", "p_name", F.concat("p_brand", F.col("p_size").cast("string")).alias("logical"), F.concat(F.lit("m"), s).alias("member"))
    member = F.when(k % 4 == 0, F.concat(F.lit("m"), (k * 3).cast("string"))).otherwise("")
    logical = F.when(k % 4 == 1, F.concat("p_brand", (F.col("p_size") + 1).cast("string"))).otherwise("")
    records = t("part").filter("p_partkey % 2 = 0 or p_partkey % 4 = 1").select(k.alias("rid"), member.alias("member"), logical.alias("logical"), "p_name")
    return by_routes(records, lines, "rid", "p_partkey", [("member", "member"), ("logical", "logical"), ("p_name", "p_name")], "p_partkey", ("p_name",))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 60 * 60.0 + 5.5 WHEN 1 THEN 3600.0 + o_orderkey % 60 END AS DOUBLE) AS start, CAST(CASE o_orderkey % 3 WHEN 0 THEN 7300.0 WHEN 1 THEN 4000.0 END AS DOUBLE) AS \"end\" FROM orders")
def time_ranges(t):
    k, m = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 60).cast("string")
    text = F.when(k == 0, F.concat(m, F.lit(":5.5 — 2:01:40"))).when(k == 1, F.concat(F.lit("1:00:"), m, F.lit("~4000"))).otherwise("from 1 - to")
    return t("orders").withColumn("r", tx.time_range(text)).select("o_orderkey", "r.start", "r.end")


@query("""SELECT page_id, CASE WHEN d IS NOT NULL AND d <> 'en' THEN 'declared_locale' WHEN f IN ('de', 'fr', 'es') THEN 'path_locale' WHEN d IS NULL AND f IS NULL THEN 'no_locale' WHEN page_id % 5 = 0 THEN 'other_line' END AS problem
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'en' END AS d, CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_extract(url, '/([a-z][a-z])/[0-9]', 1) END AS f FROM pages)""")
def locale_check(t):
    k, lang = F.col("page_id"), F.regexp_extract("url", "/([a-z][a-z])/[0-9]", 1)
    path = F.concat(F.when(k % 4 == 0, "voice").otherwise(lang), F.lit("\\line.wem"))
    wanted = F.when(k % 5 == 0, "en/other.wem").otherwise(F.when(k % 4 == 0, "voice/line.wem").otherwise("EN/line.wem"))
    return t("pages").select("page_id", tx.locale_problem(F.when(k % 3 == 1, "").otherwise(" English"), path, "en", {"english": "en", "en": "en", "de": "de", "fr": "fr", "es": "es"}, wanted).alias("problem"))


@query("SELECT user_id, n, v, CASE greatest(CASE WHEN v = 0 THEN 0 WHEN least(0.9, v / greatest(n, 1)) >= 0.75 THEN 3 WHEN least(0.9, v / greatest(n, 1)) >= 0.40 THEN 2 ELSE 1 END, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS confidence FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY user_id)")
def evidence_reconciled(t):
    rows = summary.counters(t("events"), ["user_id"], v=F.col("event_type") == "view")
    present = F.when(F.col("user_id") % 3 == 0, "medium").otherwise("none")
    return rows.select("user_id", F.col("total").alias("n"), "v", tx.reconciled(present, F.lit(0.9), F.col("v"), F.col("total")).alias("confidence"))


STRUCTURE = """r AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'm' || o_orderkey % 11 END AS member, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderstatus END AS src, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 't' END AS tgt,
CASE WHEN o_orderkey % 4 = 0 THEN 'abc' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS a, o_totalprice + o_orderkey % 10 - 1 AS b, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 2 END AS c FROM orders),
v AS (SELECT *, a IS NOT NULL AND a >= 0 AND b > a AND coalesce(c, b) > a AS ok, row_number() OVER (PARTITION BY o_custkey, id ORDER BY o_orderkey) AS ni, row_number() OVER (PARTITION BY o_custkey, member ORDER BY o_orderkey) AS nm FROM r),
w AS (SELECT *, last_value(CASE WHEN ok THEN a END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)"""


@query(f"""WITH {STRUCTURE} SELECT o_custkey, o_orderkey, unnest(list_filter([CASE WHEN ni > 1 THEN 'duplicate_entry_id' END, CASE WHEN member <> '' AND nm > 1 THEN 'duplicate_source_member' END, CASE WHEN member = '' THEN 'source_member_missing' END,
CASE WHEN src = ' ' THEN 'source_text_missing' END, CASE WHEN tgt IS NULL THEN 'target_text_missing' END, CASE WHEN sha = 'abc' THEN 'source_audio_hash_missing' END, CASE WHEN NOT ok THEN 'invalid_source_timeline' END, CASE WHEN ok AND a < p - 0.000001 THEN 'non_monotonic_timeline' END], lambda x: x IS NOT NULL)) AS code FROM w""")
def structure_issues(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(
        "o_custkey", "o_orderkey", (k % 5).alias("id"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("m"), (k % 11).cast("string"))).alias("member"), F.when(k % 6 == 0, " ").otherwise(F.col("o_orderstatus")).alias("src"), F.when(k % 8 != 0, "t").alias("tgt"),
        F.when(k % 4 == 0, "abc").otherwise(F.sha2(k.cast("string"), 256)).alias("sha"), F.when(k % 13 != 0, F.col("o_totalprice")).alias("a"), (F.col("o_totalprice") + k % 10 - 1).alias("b"), F.when(k % 3 == 0, F.col("o_totalprice") + 2).alias("c"),
    )
    return audits.structure_issues(rows, ["o_custkey"], ["o_orderkey"], "id", "member", "src", "tgt", "sha", "a", "b", "c")


@query("""WITH d AS (SELECT lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)), p AS (SELECT lang, source, count(*) FILTER (WHERE quality = 1) AS u FROM d GROUP BY ALL)
SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS usable, count(*) FILTER (WHERE quality = 0) AS invalid, count(*) FILTER (WHERE quality IS NULL) AS missing, CAST(round_even(count(*) FILTER (WHERE quality = 1) * 100.0 / count(*), 2) AS DOUBLE) AS usable_percent,
(SELECT string_agg(source || ':' || u, ',' ORDER BY source) FROM p WHERE p.lang = d.lang AND u > 0) AS providers FROM d GROUP BY lang""")
def alignment_diagnostics(t):
    lines = t("documents").join(t("labels"), "doc_id", "left")
    found = audits.alignment_diagnostics(lines, ["lang"], F.col("quality").isNotNull(), F.col("quality") == 1, F.col("source"))
    return found.withColumn("providers", F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries("providers")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ","), F.lit(""))).withColumn("usable_percent", F.col("usable_percent").cast("double"))


@query("""WITH v AS (SELECT p_brand, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_name END AS n, CASE WHEN p_brand LIKE '%3' OR p_partkey % 5 = 0 THEN 'lab' ELSE '' END AS own FROM part),
i AS (SELECT p_brand, p_name AS n, count(*) AS c, bool_or(trim(t) <> '') AS t FROM (SELECT p_brand, p_name, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END AS t FROM part WHERE p_partkey % 3 > 0 OR p_brand LIKE '%2' UNION ALL SELECT p_brand, p_name, '' FROM part WHERE p_partkey % 31 = 0) WHERE p_brand NOT LIKE '%4' AND NOT (p_brand LIKE '%3' AND p_name NOT LIKE 'a%') GROUP BY ALL),
s AS (SELECT v.p_brand, count(v.n) AS total, count(*) FILTER (WHERE c = 1) AS known, count(*) FILTER (WHERE c = 1 AND t) AS texts, count(*) FILTER (WHERE c > 1) AS shared, count(*) FILTER (WHERE v.n IS NOT NULL AND own <> '') AS packed FROM v LEFT JOIN i ON i.p_brand = v.p_brand AND i.n = v.n GROUP BY v.p_brand),
f AS (SELECT *, known < 0.5 * greatest(total, 1) AS few, total > 0 AND packed = total AS whole FROM s)
SELECT p_brand, 'blocker' AS level, 'no_voices' AS code, total AS n FROM f WHERE total = 0 UNION ALL SELECT p_brand, 'blocker', 'no_index', known FROM f WHERE total > 0 AND known = 0 AND NOT whole
UNION ALL SELECT p_brand, 'blocker', 'coverage_below_minimum', known FROM f WHERE known > 0 AND few AND NOT whole UNION ALL SELECT p_brand, 'warning', 'packed_texts_used', known FROM f WHERE few AND whole
UNION ALL SELECT p_brand, 'warning', 'voices_not_in_index', total - known FROM f WHERE NOT few AND known < total UNION ALL SELECT p_brand, 'warning', 'no_source_text', known - texts FROM f WHERE NOT few AND texts < known
UNION ALL SELECT p_brand, 'warning', 'shared_names', shared FROM f WHERE NOT few AND shared > 0""")
def preflight(t):
    k, brand = F.col("p_partkey"), F.col("p_brand")
    voices = t("part").select("p_brand", F.when(k % 97 != 0, F.col("p_name")).alias("n"), F.when(brand.endswith("3") | (k % 5 == 0), "lab").otherwise("").alias("own"))
    index = t("part").filter((k % 3 > 0) | brand.endswith("2")).select("p_brand", F.col("p_name").alias("n"), F.when(k % 7 == 0, " ").otherwise(F.col("p_type")).alias("text"))
    index = index.unionByName(t("part").filter(k % 31 == 0).select("p_brand", F.col("p_name").alias("n"), F.lit("").alias("text"))).filter(~brand.endswith("4") & ~(brand.endswith("3") & ~F.col("n").startswith("a")))
    return audits.preflight(voices, index, ["p_brand"], "n", "text", "own")


def ass_scripts(t):
    """Conversations as ASS scripts, texts broken to lines. Rows only: the breaking is Python's."""
    from linewright.functions.layout import broken_lines
    from linewright.plans.ordered import timed
    from linewright.sources.exports import render_ass

    broken = spread(t("conversations"), "conv_id", "turn").withColumn("broken", broken_lines(2000)("text"))
    lines = timed(lambda _: broken)
    start, end = F.col("start_sample") / 8000.0, F.col("end_sample") / 8000.0
    return render_ass(lines, "conv_id", "turn", F.col("broken"), start, end, F.lit(200), F.lit(300))


query()(ass_scripts)
