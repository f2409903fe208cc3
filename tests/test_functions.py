import pytest
from pyspark.sql import functions as F

from linewright.functions import layout
from linewright.functions import text as tx
from linewright.operators import timeline


def values(spark, column, *inputs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(column).collect()]


def test_cross_keys(spark):
    got = values(spark, tx.cross_key(F.col("x")), "chapter5_13_mira_103.wav", "vo_chapter5_13_other_103.wav", "vo_100101_01.wav", "100101_01.wav", "vo_plain.wav")
    assert got == ["chapter5_13::103", "chapter5_13::103", "id::100101_01", "id::100101_01", "plain"]


def test_identity_and_groups(spark):
    assert values(spark, tx.logical_id(tx.stem(F.col("x"))), "chapter5_3_mira_125_f.wav", "a\\b/c.d.wav") == ["chapter5_3_mira_125", "c.d"]
    rows = spark.createDataFrame([("a/chapter2_1_x.wav", ""), ("a/x.wav", "Chapter3"), ("chapter4/x_1.wav", ""), ("a/x_1.wav", "Custom"), ("a/vo_1_2.wav", "vo"), ("a/x.wav", "unknown")], "m string, g string")
    got = [tuple(r[0]) for r in rows.select(tx.classify_group(F.col("m"), F.col("g"))).collect()]
    assert got == [("chapter2_1", "chapter2", "confirmed", "filename_schema"), ("chapter3", "chapter3", "confirmed", "declared_group_schema"), ("chapter4", "chapter4", "inferred", "package_path"), ("custom", "custom", "inferred", "explicit_index_group"), ("", "", "unknown", "unrecognized"), ("", "", "unknown", "unrecognized")]


def test_timeline_literals(spark):
    rows = spark.createDataFrame([(1, 1, "c1", 8000), (1, 2, "c1", 4000), (1, 3, "c2", 2000)], "a int, i int, g string, n long").repartition(3)
    got = timeline.resolve(rows, ["a"], ["i"], "g", F.col("n"), 8000, 5.0, 0.4, 1.2).orderBy("i").collect()
    assert [r.start_sample for r in got] == [40000, 51200, 64800] and got[-1].next_start == got[-1].end_sample == 66800


def test_clocks_round_half_to_even(spark):
    rows = spark.createDataFrame([(0.0025,), (0.0035,), (3661.5,), (0.125,)], "s double")
    assert [r[0] for r in rows.select(tx.clock(F.col("s"))).collect()][:3] == ["00:00:00,002", "00:00:00,004", "01:01:01,500"]
    assert rows.select(tx.ass_clock(F.col("s"))).collect()[3][0] == "0:00:00.12"


def test_issues_and_zones(spark):
    rows = spark.createDataFrame([("{M#he} goes", "{M#她}走"), ("<b>x</b> Star", "x 星"), ("I have 10 and never 3.5 apples today", "我有十个苹果"), ("Is it so, my old and dear friend?", "是这样的朋友，很好很好很好"), ("ok", "")], "a string, b string")
    codes = lambda c: [[x.code for x in r[0]] for r in rows.select(c).collect()]
    assert codes(tx.translation_issues(F.col("a"), F.col("b"), {"star": "星"}))[:2] == [[], ["format_tokens"]]
    assert codes(tx.translation_issues(F.col("a"), F.col("b"), {"star": "月"}))[1] == ["format_tokens", "terminology"]
    signals = codes(tx.alignment_signals(F.col("a"), F.col("b")))
    assert signals[2] == ["numeric_conflict", "negation_dropped"] and signals[3] == ["sentence_type_shift"] and signals[4] == ["empty_official"]
    zones = [r[0] for r in rows.select(tx.alignment_zone(tx.alignment_signals(F.col("a"), F.col("b")))).collect()]
    assert zones == ["green", "red", "red", "yellow", "red"]


def test_natural_order_and_strip(spark):
    rows = spark.createDataFrame([("chapter10/a.wav",), ("chapter2/b.wav",), ("chapter2/a10.wav",), ("chapter2/a9.wav",)], "p string")
    assert [r.p for r in rows.orderBy(tx.natural_key(F.col("p"))).collect()] == ["chapter2/a9.wav", "chapter2/a10.wav", "chapter2/b.wav", "chapter10/a.wav"]
    assert values(spark, tx.strip(F.col("x")), "　 a b  \n") == ["a b"]


def test_layout(spark):
    assert layout.break_text("the quick brown fox jumps over the dog", 1000) == ["the quick brown fox", "jumps over the dog"]
    lines = layout.break_text("你好，世界！这是一个测试。", 600)
    assert "".join(lines) == "你好，世界！这是一个测试。" and all(line[0] not in layout.NO_START for line in lines)
    assert layout.break_text("", 100) == [] and layout.break_text("unbreakable", 10) == ["unbreakable"]
    assert values(spark, layout.normal_text("x"), "&lt;b&gt;Ａ “q”  –<i>x</i>", None) == ['A "q" -x', ""]


def test_fuzzy_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = layout.repair_ids(ids("chapter_mira_103", "side_7", "same_1"), ids("chapter_mirra_103", "other_long_name_7", "same_1"), "id").collect()
    assert [tuple(r) for r in got] == [("chapter_mira_103", "chapter_mirra_103")]


@pytest.mark.parametrize("weights", [[1, 1, 1], [0, 0], [5, 3, 2, 7]])
def test_apportionment(spark, weights):
    rows = spark.createDataFrame([(0, i, w) for i, w in enumerate(weights)], "g int, i int, w long")
    units = [r.units for r in timeline.apportion(rows, ["g"], ["i"], "w", 100).orderBy("i").collect()]
    assert sum(units) == (100 if sum(weights) else 0)


def test_families_of_names(spark):
    rows = spark.createDataFrame([("vo_chapter5_13_evanescia_104.wav", ""), ("Ev_archive_vo_avatar_cast_hero_98765.wav", ""), ("vo_100101_01.wav", "vo"), ("chapter3_7/vo_100101_01.wav", "vo"), ("mystery_001.wav", "event_special"), ("vo_anecdote_106701_hutao_01.wav", ""), ("side2_5_x.wav", ""), ("sidex_1.wav", ""), ("chapter_x.wav", ""), ("ChapterFinality2_x.wav", "")], "m string, g string")
    got = [tuple(r[0])[:3] for r in rows.select(tx.classify_group(F.col("m"), F.col("g"))).collect()]
    assert got == [("chapter5_13", "chapter5", "confirmed"), ("archive", "archive", "confirmed"), ("", "", "unknown"), ("chapter3_7", "chapter3", "inferred"), ("event_special", "event_special", "inferred"), ("anecdote_106701",) * 2 + ("confirmed",), ("side2", "side2", "confirmed"), ("sidex", "sidex", "confirmed"), ("", "", "unknown"), ("chapterfinality2",) * 2 + ("confirmed",)]
    ranks = values(spark, tx.chapter_rank(F.col("x")), "archive", "chapter10", "chapterfinality", "companion2", "companion", "side3", "sidex", "event", "")
    assert [(r.rank, r.number) for r in ranks] == [(0, 0), (1, 10), (2, 0), (3, 2), (3, 0), (4, 3), (4, 999), (5, 0), (6, 0)]


def test_sample_categories(spark):
    assert values(spark, tx.sample_category(F.col("x")), "<color=#fff>Hello</color>", "The Aeon has never answered us.", "Short line.", "Really? You don't believe me!", "This sentence is deliberately long " * 8) == ["tags_placeholders", "hsr_terminology", "short_context_sensitive", "short_context_sensitive", "long_complex"]
