"""Queries on tables made for one finding each, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from linewright.functions import layout
from linewright.functions import text as tx
from linewright.operators import audits as audits_of
from linewright.operators import changes, resolution
from linewright.plans import audits, ordered, outputs, records  # noqa: F401
from linewright.plans.registry import ORACLES, QUERIES
from linewright.sources import published


@pytest.fixture
def same(spark, tmp_path):
    """Run a query on tables (name -> frame) and on DuckDB; its rows, if both are alike."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
        rows, at = got.collect(), [want.columns.index(c) for c in got.columns]
        assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
        return rows

    return check


def test_words_beside_accented_letters(spark, same):
    turns = [(1, 1, "user", "noño dice que va a la casa"), (1, 2, "user", "noño 不"), (1, 4, "user", "不 überall"), (2, 1, "user", "café noé"), (2, 2, "user", "x")]
    rows = same("alignment_zone", conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert not any("negation_added" in r.codes for r in rows if (r.conv_id, r.turn) == (1, 1))
    said = spark.createDataFrame([("noño",), ("no, o",), ("o_no",)], "x string")
    assert [tuple(r) for r in said.select(tx.has_negation(F.col("x")), tx.has_negation(F.col("x"), ascii_words=True)).collect()] == [(False, True), (True, True), (False, False)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sets_are_compared_in_one_reduction(spark, same):
    keys = lambda name, ids: spark.createDataFrame([(i,) for i in ids], f"{name} long")
    same("set_equality", orders=keys("o_orderkey", [1, 2, 3, 3, 9]), lineitem=keys("l_orderkey", [2, 2, 3, 4, 4, -1]))
    got = changes.set_difference(keys("a", [1, None, None, 2]), keys("b", [2, None, 7]), "a", "b")
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'left')", "(7, 'right')", "(None, 'left')", "(None, 'right')"]
    assert "Join" not in plan(got) and "Sort" not in plan(got)


def test_tokens_of_a_line_are_counted_in_its_row(spark, same):
    turns = [(1, 1, "a b  a"), (1, 2, "b b c"), (1, 3, ""), (1, 4, None), (2, 1, "x x x"), (2, 2, "x x x"), (3, 1, "lone")]
    same("token_multiset_difference", conversations=spark.createDataFrame([(*t, "user") for t in turns], "conv_id long, turn long, text string, role string"))
    rows = spark.createDataFrame([(1, ["a", None, "a"], ["b"]), (2, ["k", "m"], ["k"]), (2, ["k"], ["m", "m"]), (3, None, ["z"]), (4, None, None), (5, [], [])], "k int, a array<string>, b array<string>")
    got = audits_of.multiset_difference(rows, ["k"], F.col("a"), F.col("b"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a", 2, 0), (1, None, 1, 0), (1, "b", 0, 1), (2, "k", 1, 0), (2, "m", 0, 1), (3, "z", 0, 1)]))
    kept = audits_of.multiset_difference(rows.filter("k <> 2").withColumn("_n", F.lit(1)), ["k"], F.col("a"), F.col("b"))
    assert plan(kept).count("Generate inline") == 2 and plan(kept).count("Generate explode") == 0


def test_groups_of_names_are_looked_for_once(spark, same):
    same("chapter_order", customer=spark.range(300).selectExpr("id as c_custkey", "id % 25 as c_nationkey", "'BUILDING' as c_mktsegment"))
    named = spark.createDataFrame([("chapter3/x.wav", "y")], "m string, d string")
    ranked = named.select(tx.chapter_rank(tx.classify_group(F.col("m"), F.col("d"))["major"]).alias("r"))
    assert ranked._jdf.queryExecution().analyzed().toString().count("regexp_extract(") < 200


def test_wide_rows_are_ranked_in_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(changes, "RANGE_BYTES", 100_000, raising=False)
    rows = spark.range(2000).select("id", F.rpad(F.col("id").cast("string"), 1000, "x").alias("text"), F.array("id").alias("more"))
    got = changes.numbered(rows, "id", "n")
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, i + 1) for i in range(2000)]
    tasks = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.max("n")).collect()
    assert max(r.rows for r in tasks) < 1000
    few = changes.numbered(rows.filter("id < 2").withColumn("text", F.repeat("text", F.lit(1000))), "id", "n")
    assert sorted(r.n for r in few.collect()) == [1, 2]
    groups = changes.ranked(rows.withColumn("g", F.col("id") % 3), ["g"], ["id"], "n").collect()
    assert all(r.n == r.id // 3 + 1 for r in groups) and len(groups) == 2000


def test_lines_are_broken_in_many_tasks_with_few_steps(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(layout, "char_width", lambda c, plain=layout.char_width: asked.append(c) or plain(c))
    text = "the quick brown fox, jumps over <b>the lazy</b> dog 你好，世界！ " * 200
    lines = layout.break_text(text, 1900)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "") and len(asked) <= len(set(text))
    spark.range(400).selectExpr("id div 4 as conv_id", "id % 4 as turn", "'user' as role", "repeat('word ', 50) as text").repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["ass_scripts"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in plan(got) and got.count() == 100


def test_a_published_table_is_computed_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(x):
        runs.add(1)
        return x

    rows = spark.range(200).select("id", F.udf(counted, "long")("id").alias("x"))
    published.publish(spark, f"{tmp_path}/out", {"rows": rows}, {"rows": ["id"]})
    assert runs.value == 200
    assert sorted(r.x for r in published.published(spark, f"{tmp_path}/out", "rows").collect()) == list(range(200))
    csv = spark.read.option("header", True).csv(f"{tmp_path}/out/versions/*/rows/csv")
    assert sorted(int(r.x) for r in csv.collect()) == list(range(200))


def test_lines_of_odd_documents(spark, same):
    texts = [None, "", "1" * 60, "ab " + "12:" * 50 + "3% cd", "字，" + "１" * 60, "<" + "a" * 90 + ">" + "7" * 90, "Ａ" * 60, "٣" * 60, "x" * 30 + "1" * 90, "-" + "1," * 60 + "1"]
    same("scored_breaks", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sizes = spark.createDataFrame([("ＡＢ",), ("IMWA",)], "x string").select(tx.width(F.col("x")))
    assert [r[0] for r in sizes.collect()] == [sum(map(layout.char_width, x)) for x in ("ＡＢ", "IMWA")]


def test_voices_meet_their_rows_without_a_broadcast(spark, same, tmp_path):
    customers = spark.range(400).selectExpr("id as c_custkey")
    orders = spark.range(1500).selectExpr("id as o_orderkey", "pmod(xxhash64(id), 450) as o_custkey")
    rows = same("voice_resolution", customer=customers, orders=orders)
    assert {r.method for r in rows} == {None, *resolution.WAYS}
    schema = "ordinal long, key string, ingame_filename string, transcription string, speaker string, voice_id string"
    odd = [(1, "english(us)/12.wem", "English(US)\\Voice/X.WEM", None, None, None), (2, "English/7", "English(US)/Voice/A.Wem", None, None, "12"), (3, "english/0a.b", None, None, None, "012"), (4, "English/x", "english.us./voice/c.wem", None, None, None)]
    wanted = spark.createDataFrame([("a.wav", "", "", 1), ("ev_archive_q_12.wav", None, None, 2), ("c.wav", "0A", None, 3)], "filename string, hash string, english string, order long")
    got = resolution.resolve_voices(spark.createDataFrame(odd, schema), wanted)
    assert sorted((r.filename, r.status, r.method, r.ordinal) for r in got.collect()) == [("a.wav", "resolved", "inGameFilename", 2), ("c.wav", "identity_unverified", "wav_hash", None), ("ev_archive_q_12.wav", "resolved", "media_id", 1)]
    joins = [line for line in plan(QUERIES["voice_resolution"](spark, str(tmp_path))).splitlines() if "Join [" in line]
    keyed = [line for line in joins if any(f"[{c}#" in line for c in ("way", "said", "met"))]
    assert len(keyed) == 4 and all("SortMergeJoin" in line for line in keyed), joins  # the first is in both branches
