"""Queries on what an archive gives out: indexes, subtitles, resolved voices, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import breaking
from linewright.functions import text as tx
from linewright.operators import batches, resolution
from linewright.operators.tables import shared_path, spread
from linewright.plans.records import NAMES, named
from linewright.plans.registry import query
from linewright.sources import exports, published
from linewright.sources.tables import read_object_map


@query("SELECT lang || '/' || doc_id AS key, md5(text) AS text_md5, source FROM documents WHERE lang = 'en'")
def object_map_members(t):
    """Documents written as JSON objects of a hundred each, and read back in byte ranges by the prefix of their keys."""
    docs = t("documents")
    path = shared_path(docs.sparkSession, "objects")
    member = F.struct(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.struct("text", "source").alias("value"))
    docs.groupBy(F.floor(F.col("doc_id") / 100)).agg(F.to_json(F.map_from_entries(F.collect_list(member))).alias("value")).select("value").write.text(path)
    return read_object_map(docs.sparkSession, path, "text string, source string", prefix="en/").select("key", F.md5("text").alias("text_md5"), "source")


ENTRIES = f"""n AS (SELECT *, split_part({NAMES}, '\\', 2) AS filename FROM customer),
e AS (SELECT c_custkey AS k, filename, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN c_custkey % 2 = 0 THEN 'pack/' || c_custkey ELSE '' END AS member, c_name, lower(c_mktsegment) AS grp,
c_custkey * 137 AS ms, CASE c_custkey % 4 WHEN 0 THEN 'official_chs_lab' WHEN 1 THEN '' ELSE 'machine' END AS cs FROM n)"""


def clock_sql(ms):
    return f"printf('%02d:%02d.%03d', greatest(0, {ms}) // 60000, greatest(0, {ms}) // 1000 % 60, greatest(0, {ms}) % 1000)"


@query(f"""WITH {ENTRIES} SELECT k::VARCHAR AS "index", {clock_sql("ms")} AS start, {clock_sql("(ms + 1500)")} AS audio_end, {clock_sql("(ms - 1000)")} AS display_end, grp AS "group", filename, member AS source_member_id,
CASE WHEN regexp_matches(stem, '(?i)_[fm]$') THEN left(stem, length(stem) - 2) ELSE stem END AS logical_id, lower(regexp_extract(stem, '(?i)_([fm])$', 1)) AS variant,
CASE WHEN cs = 'official_chs_lab' THEN 'official_target_lab' ELSE cs END AS target_text_source, CASE WHEN k % 3 = 0 THEN '' ELSE '中文' || k END AS target_text, c_name || ', "said"' AS source_text,
CASE WHEN k % 5 = 0 THEN 'ja' ELSE 'auto' END AS reference_language, '' AS reference_text, cs AS chinese_source, CASE WHEN k % 3 = 0 THEN '' ELSE '中文' || k END AS chinese, c_name || ', "said"' AS english,
printf('%.6f', k / 4) AS source_duration_seconds, md5(c_name) AS sha256,
CASE WHEN (k % 7 = 0 AND k % 2 = 0) OR k % 7 IN (1, 2) THEN 'edit' || k ELSE '' END AS final_chs, CASE WHEN (k % 7 = 0 AND k % 2 = 0) OR k % 7 IN (1, 2) THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS modified FROM e""")
def corrected_index(t):
    """Customers' files as an archive: the index of 19 columns is published, read back, and synced with edits by member, name and number."""
    k = F.col("c_custkey")
    source = F.when(k % 4 == 0, published.FORMER_SOURCE).when(k % 4 != 1, "machine")
    customers = spread(t("customer"), "c_custkey")
    entries = named(lambda _: customers).select(
        k.alias("index"), tx.basename(F.col("path")).alias("filename"), F.when(k % 2 == 0, F.concat(F.lit("pack/"), k.cast("string"))).alias("source_member_id"), F.lower("c_mktsegment").alias("group"),
        (k * 137 / 1000.0).alias("start_seconds"), (k * 137 / 1000.0 + 1.5).alias("audio_end_seconds"), (k * 137 / 1000.0 - 1).alias("display_end_seconds"), F.concat("c_name", F.lit(', "said"')).alias("english"),
        F.when(k % 3 != 0, F.concat(F.lit("中文"), k.cast("string"))).alias("chinese"), source.alias("chinese_source"), F.when(k % 5 == 0, "ja").alias("reference_language"), F.lit(None).cast("string").alias("reference_text"),
        (k / 4).alias("source_duration_seconds"), F.md5("c_name").alias("sha256"),
    )
    spark = entries.sparkSession
    made = published.manifest(entries)
    folder = shared_path(spark, "published")
    published.publish(spark, folder, {"manifest": made, "index": published.corrected_index(made)}, {"manifest": ["index"], "index": ["index"]})
    edits = named(t).filter(k % 7 < 3).select(
        F.when(k % 7 == 0, F.concat(F.lit("pack/"), k.cast("string"))).alias("source_member_id"), F.when(k % 7 == 1, tx.basename(F.col("path"))).alias("filename"), F.when(k % 7 == 2, k).alias("id"),
        F.concat(F.lit("edit"), k.cast("string")).alias("final_chs"), (k % 2 == 0).alias("modified"), k.alias("at"),
    )
    return published.synced(published.published(spark, folder, "index"), edits, "at")


VOICES = """t AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN 'ev_archive_mira_' ELSE 'vo_mira_' END || c_custkey || '.wav' AS filename FROM customer),
r AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 27 AS k FROM orders JOIN t ON c = o_custkey),
h AS (SELECT *, CASE WHEN k = 4 THEN 'media_id' WHEN k = 3 THEN 'media_id' WHEN k = 2 THEN 'wav_hash' WHEN k = 1 THEN 'inGameFilenameBasename' ELSE 'inGameFilename' END AS method, k < 2 OR o % 2 = 0 AS verified FROM r WHERE k < 3 OR (k < 5 AND c % 5 = 0)),
f AS (SELECT c, arg_min(o, o) AS o, arg_min(method, o) AS method, arg_min(verified, o) AS verified FROM h GROUP BY c),
x AS (SELECT c, min(o) AS o, 'unique_transcription' AS method, min(k) = 5 AND min(o) % 2 = 0 AS verified FROM r WHERE k IN (5, 6) GROUP BY c HAVING count(*) = 1),
u AS (SELECT * FROM f UNION ALL SELECT * FROM x WHERE c NOT IN (SELECT c FROM f)),
z AS (SELECT c, min(o) AS z FROM r WHERE k = 8 GROUP BY c)"""


@query(f"""WITH {VOICES} SELECT filename, CASE WHEN verified IS NULL THEN 'unresolved' WHEN verified THEN 'resolved' ELSE 'identity_unverified' END AS status, method, CASE WHEN verified THEN o END AS ordinal,
CASE WHEN verified AND method = 'inGameFilename' THEN z END AS reference_ordinal FROM t LEFT JOIN u USING (c) LEFT JOIN z USING (c)""")
def voice_resolution(t):
    """Orders as dataset rows, customers as the voices wanted: all five ways, rows of other locales, and rows that tell no identity."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    file = F.concat(F.when(c % 5 == 0, "ev_archive_mira_").otherwise("vo_mira_"), c.cast("string"))
    targets = t("customer").select(F.concat(file, F.lit(".wav")).alias("filename"), F.concat(F.lit("H"), c.cast("string"), F.lit("x")).alias("hash"), F.concat(F.lit("Line “"), c.cast("string"), F.lit("” said")).alias("english"), c.alias("order"))
    k, n, own = o % 27, F.col("o_custkey").cast("string"), F.concat(F.when(F.col("o_custkey") % 5 == 0, "ev_archive_mira_").otherwise("vo_mira_"), F.col("o_custkey").cast("string"))
    path = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key = F.when(k == 2, path("English/h", n, "X.wem")).when(k == 3, path("English(US)/", n, ".wem")).when(k == 7, path("japanese/o", o.cast("string"), ".wem")).when(k == 8, path("Chinese(PRC)/o", o.cast("string"), ".wem")).otherwise(path("English/o", o.cast("string"), ".wem"))
    ingame = F.when(k == 0, path("English/Voice/", own, ".wem")).when(k == 1, path("Pack\\VO\\", F.upper(own), ".WEM")).when(k.between(2, 5) & (o % 2 == 0), path("English/voice/other_", o.cast("string"), ".wem")).when(k == 7, path("english/voice/", own, ".wem")).when(k == 8, path("Chinese(PRC)/voice/", own, ".wem"))
    rows = t("orders").select(o.alias("ordinal"), key.alias("key"), ingame.alias("ingame_filename"), F.when(k.isin(5, 6), path("  <b>Line</b> \"", n, "\"  said")).alias("transcription"), F.lit("mira").alias("speaker"), F.when(k == 4, n).alias("voice_id"))
    return resolution.resolve_voices(rows, targets, "en").select("filename", "status", "method", "ordinal", "reference_ordinal")


def annotated(t):
    """Labels as annotations, some by member, some by logical id, some by number."""
    d = F.col("doc_id")
    key = resolution.annotation_key(F.when(d % 3 == 0, F.concat(F.lit("pack/"), d.cast("string"), F.lit(".wav"))), F.when(d % 3 == 1, F.concat(F.lit("log"), d.cast("string"))), d)
    quality = F.when(F.col("quality") == 1, "Good").when(F.col("quality") == 0, "c")
    return t("labels").select("doc_id", key.alias("key"), (F.col("quality") == 1).alias("selected"), F.when(F.col("toxic") == 1, " Angry ").when(d % 7 == 0, "weird").alias("emotion"), F.when(d % 2 == 0, F.col("quality") * 0.25).alias("intensity"), quality.alias("quality"))


@query("""SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'member:pack/' || d.doc_id || '.wav' WHEN 1 THEN 'logical:log' || d.doc_id ELSE 'id:' || d.doc_id END AS reference_key, coalesce(quality = 1, false) AS reference_selected,
CASE WHEN toxic = 1 THEN 'angry' WHEN quality IS NOT NULL AND d.doc_id % 7 = 0 THEN 'other' ELSE 'unmarked' END AS reference_emotion, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(quality * 0.25, 0.5) ELSE 0.5 END::DOUBLE AS reference_intensity,
CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'C' ELSE 'unrated' END AS reference_quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def annotated_lines(t):
    d = F.col("doc_id")
    entries = t("documents").select(d.alias("id"), F.when(d % 3 == 0, F.concat(F.lit(" pack\\"), d.cast("string"), F.lit(".wav "))).alias("source_member_id"), F.when(d % 3 == 1, F.concat(F.lit("log"), d.cast("string"))).alias("logical_id"))
    return resolution.decorate(entries, annotated(t), "doc_id").drop("source_member_id", "logical_id")


@query("""WITH a AS (SELECT l.doc_id, 'id:' || l.doc_id AS key FROM labels l WHERE quality = 1), m AS (SELECT a.*, d.doc_id AS entry, d.n_chars / 100 AS s, CASE WHEN d.doc_id IS NULL THEN 'manifest_entry_not_found' WHEN d.doc_id % 7 = 0 THEN 'audio_unavailable_or_unreadable' END AS reason
FROM a LEFT JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) d ON d.doc_id = a.doc_id)
SELECT key, row_number() OVER (ORDER BY doc_id) AS number, NULL AS reason, coalesce(s BETWEEN 3 AND 10, false) AS recommended, round_even(s, 3) AS duration_seconds FROM m WHERE reason IS NULL UNION ALL SELECT key, NULL, reason, NULL, NULL FROM m WHERE reason IS NOT NULL""")
def reference_catalog(t):
    """Selected labels as reference clips: documents are the entries, their lengths the audio; some have neither."""
    d = F.col("doc_id")
    annotations = annotated(t).withColumn("key", F.concat(F.lit("id:"), d.cast("string")))
    entries = t("documents").filter(d % 5 != 0).select(F.lit("").alias("source_member_id"), F.lit(None).cast("string").alias("logical_id"), d.alias("id"), F.concat(d.cast("string"), F.lit(".wav")).alias("filename"), F.col("text").alias("source_text"), d.alias("place"))
    audio = t("documents").filter(d % 7 != 0).select(F.concat(d.cast("string"), F.lit(".wav")).alias("member"), (F.col("n_chars") / 100).alias("seconds"))
    catalog, rejected = resolution.reference_catalog(annotations, entries, audio, "doc_id")
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return catalog.select("key", "number", empty("string", "reason"), "recommended", "duration_seconds").unionByName(rejected.select("key", empty("long", "number"), "reason", empty("boolean", "recommended"), empty("double", "duration_seconds")))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\s，,\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS said, 0 AS overflowing FROM documents")
def scored_breaks(t):
    """Whole documents broken to 900 pixels: nothing is lost, nothing is wider. Of a null text nothing is said."""
    lines = t("documents").select("doc_id", F.col("text").isNull().alias("none"), breaking.scored(900.0, 42, hard=True)("text").alias("lines"))
    wide = F.filter("lines", lambda x: tx.width(F.regexp_replace(x, tx.MARKUP, "")) * 0.42 > 900)
    said = F.regexp_replace(F.array_join("lines", ""), r"(?U)[\s，,\x1c-\x1f]", "")
    return lines.select("doc_id", F.when(~F.col("none"), F.md5(said)).alias("said"), F.size(wide).alias("overflowing"))


KARAOKE_UNITS = "list_transform(lines, lambda x: regexp_extract_all(x, '\\S+\\s*|\\s+'))"


@query(f"""WITH a AS (SELECT conv_id, turn, length(text) * 5 AS cs, str_split(translate(text, '\\{{}}' || chr(13), '／｛｝ '), chr(10)) AS lines FROM conversations),
u AS (SELECT *, {KARAOKE_UNITS} AS us FROM a), n AS (SELECT *, coalesce(list_sum(list_transform(us, lambda u: len(u))), 0)::BIGINT AS n FROM u),
b AS (SELECT *, CASE WHEN n = 0 THEN array_to_string(lines, '\\N') ELSE array_to_string(list_transform(us, lambda w, i: array_to_string(list_transform(w, lambda x, k: '{{\\k' || (cs // n + CASE WHEN coalesce(list_sum(list_transform(us[1:i - 1], lambda v: len(v))), 0) + k - 1 < cs % n THEN 1 ELSE 0 END)::BIGINT || '}}' || x), '')), '\\N') END AS body,
greatest(0, turn * 1000 - 20) AS s, turn * 1000 + cs + 30 AS e FROM n),
c AS (SELECT *, printf('%d:%02d:%02d.%02d', s // 360000, s // 6000 % 60, s // 100 % 60, s % 100) AS sc, printf('%d:%02d:%02d.%02d', e // 360000, e // 6000 % 60, e // 100 % 60, e % 100) AS ec FROM b)
SELECT conv_id, md5('{exports.ASS_HEADER}' || string_agg('Dialogue: 0,' || sc || ',' || ec || ',Line,{{\\fad(200,300)}}' || body, chr(10) ORDER BY turn) || chr(10)) AS ass FROM c GROUP BY conv_id""")
def karaoke_scripts(t):
    """Conversations as ASS scripts whose words are timed: the tags of a cue add up to its length."""
    lines = F.transform(F.split("text", "\n"), lambda x: exports.ass_text(x))
    start, duration = F.col("turn") * 10.0, F.length("text") * 5 / 100.0
    cues = t("conversations").withColumn("lines", lines)
    scripts = exports.render_ass(cues, "conv_id", "turn", F.col("lines"), start, start + duration, F.lit(200), F.lit(300), body=exports.karaoke_even(F.col("lines"), duration, "word"))
    return scripts.select("conv_id", F.md5("ass").alias("ass"))


@query("SELECT doc_id, md5(replace(translate(coalesce(text, ''), '\\{}' || chr(13), '／｛｝ '), chr(10), '\\N')) AS event, md5(replace(translate(coalesce(text, ''), '\\{}' || chr(13), '／｛｝ '), chr(10), ' ')) AS line FROM documents")
def ass_escapes(t):
    return t("documents").select("doc_id", F.md5(exports.ass_text(F.col("text"))).alias("event"), F.md5(exports.ass_text(F.col("text"), line_feeds=False)).alias("line"))


def stub_model(records):
    """Stands for a model: spoils every third answer, mends it when told so, except every ninth; leaves out every eleventh."""
    out = []
    for r in records:
        k = r["c_custkey"]
        if k % 11 != 0:
            mended = r["problem"] is not None and k % 9 != 0
            out.append({"c_custkey": k, "value": f"{r['c_name']}!" if k % 3 or mended else "?"})
    return out


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '?' ELSE c_name || '!' END AS value, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 9 = 0 THEN 'no_name' END AS problem,
CASE WHEN c_custkey % 11 = 0 OR c_custkey % 9 = 0 OR c_custkey % 3 = 0 THEN 2 ELSE 1 END AS asked, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 9 = 0 THEN 'review' ELSE 'ok' END AS outcome FROM customer""")
def repair_rounds(t):
    """Customers' names answered by a stand-in for a model, checked, and asked for again until nothing changes."""
    rows = t("customer").select("c_custkey", "c_name")
    check = F.when(~F.contains("value", F.col("c_name")), "no_name")
    return batches.answered_in_rounds(rows, "c_custkey", ["c_name"], stub_model, check, shared_path(rows.sparkSession, "rounds"), rounds=5)
