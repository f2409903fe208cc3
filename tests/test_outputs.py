import re

import pytest
from pyspark.sql import functions as F

from linewright.functions.layout import char_width
from linewright.operators import resolution as r
from linewright.sources import exports as x

ROW = "ordinal long, key string, ingame_filename string, transcription string, speaker string, voice_id string"
TARGET = "filename string, hash string, english string, `order` int"


def resolved(spark, rows, targets, **options):
    out = r.resolve_voices(spark.createDataFrame(rows, ROW), spark.createDataFrame(targets, TARGET), **options)
    return {row.filename: row for row in out.collect()}


def test_five_ways_and_rejections(spark):
    targets = [("a.wav", "", "alpha", 1), ("b.wav", "HB", "beta", 2), ("ev_archive_x_77.wav", "", "gamma", 3), ("d.wav", None, "Same  text", 4), ("e.wav", None, "twice", 5), ("f.wav", None, None, 6), ("g.wav", "HG", "golf", 7)]
    rows = [
        (0, "japanese/a.wem", "english/voice/a.wem", None, None, None),  # another locale
        (1, "English/k1.wem", "elsewhere\\A.WEM", None, "s", None),
        (2, "English/k2.wem", "English/voice/A.wem", None, "late", None),  # a came first from row 1: ways do not compete across rows
        (3, "english/hb.wem", None, None, None, None),  # tells no identity
        (4, "english/hb.wem", "x/voice/real.wem", None, "next", None),
        (5, "english/k5.wem", "x/voice/y.wem", None, None, "77"),
        (6, "english/k6.wem", "x/voice/z.wem", "same text", None, None),
        (7, "english/k7.wem", "x/voice/p.wem", "twice", None, None),
        (8, "english/k8.wem", "x/voice/q.wem", "twice", None, None),
        (9, "Chinese(PRC)/k9.wem", "Chinese(PRC)/voice/REAL.wem", None, None, None),
        (10, "english/hg.wem", "english/voice/e.wem.txt", None, None, None),
    ]
    got = resolved(spark, rows, targets)
    assert {k: (v.status, v.method, v.ordinal) for k, v in got.items()} == {
        "a.wav": ("resolved", "inGameFilenameBasename", 1), "b.wav": ("identity_unverified", "wav_hash", None), "ev_archive_x_77.wav": ("resolved", "media_id", 5), "d.wav": ("unresolved", None, None),
        "e.wav": ("unresolved", None, None), "f.wav": ("unresolved", None, None), "g.wav": ("identity_unverified", "wav_hash", None),
    }
    again = resolved(spark, rows, targets, retry=True)
    assert (again["b.wav"].status, again["b.wav"].ordinal, again["b.wav"].speaker, again["b.wav"].reference_ordinal) == ("resolved", 4, "next", 9)
    assert resolved(spark, [], targets[:1])["a.wav"].status == "unresolved"
    with pytest.raises(ValueError, match="no such locale"):
        r.resolve_voices(spark.createDataFrame([], ROW), spark.createDataFrame([], TARGET), "xx")


def test_shared_keys_are_not_multiplied(spark):
    """A third of all rows and of all targets share a key; the plan's largest step stays in proportion to them."""
    rows = spark.range(3000).select(F.col("id").alias("ordinal"), F.lit("english/k.wem").alias("key"), F.when(F.col("id") % 3 == 0, "english/voice/hot.wem").alias("ingame_filename"), F.lit("same").alias("transcription"), F.lit("").alias("speaker"), F.lit("").alias("voice_id"))
    targets = spark.range(3000).select(F.concat(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), F.lit(".wav")).alias("filename"), F.lit("k").alias("hash"), F.lit("same").alias("english"), F.col("id").cast("int").alias("order"))
    got = {row.filename: row for row in r.resolve_voices(rows, targets).collect()}
    assert len(got) == 2001 and got["hot.wav"].ordinal == 0 and got["2999.wav"].status == "identity_unverified"
    assert sum(v.status == "unresolved" for v in got.values()) == 1999


def test_voice_paths(spark):
    paths = {"English/Voice/a.wem": "a.wem", "\\X\\voice\\B\\c.wem": "b/c.wem", "korean/d.wem": "d.wem", " en-us/voice.wem": "voice.wem", "": "", None: "", "voice/e.wem": "e.wem", "english/english/f.wem": "english/f.wem"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {row.p: row.v for row in df.select("p", r.voice_path(F.col("p")).alias("v")).collect()} == paths


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("y")).first().y


WORDS = "array<struct<word:string,start:double,end:double>>"


def test_aligned_karaoke(spark):
    tagged = lambda text, seconds, words: one(spark, x.karaoke_aligned(F.col("t"), F.col("d"), F.col("w")), t=("string", text), d=("double", seconds), w=(WORDS, words))
    assert tagged("Well done", 2.0, [("Well ", 0.0, 0.504), ("done", 0.6, 0.601)]) == "{\\k50}Well {\\k1}done"
    for words in ([("Well ", 0.0, 0.5)], [("Well ", 0.0, 0.5), ("done", 0.4, 0.9)], [("Well ", 0.0, 0.5), ("done", 0.6, 2.3)], [("Well ", 0.5, 0.5), ("done", 0.6, 0.9)], [("Well ", None, 0.5), ("done", 0.6, 0.9)], [], None):
        assert tagged("Well done", 2.0, words) == "Well done"


def sums(script):
    return sum(map(int, re.findall(r"\{\\kf?(\d+)\}", script)))


def test_generated_karaoke_adds_up(spark):
    lines = ["éa 👩‍👩🏽 b", "", "miWl。"]
    even = lambda unit, seconds, held=lines: one(spark, x.karaoke_even(F.col("l"), F.col("d"), unit), l=("array<string>", held), d=("double", seconds))
    assert even("character", 0.1) == "{\\k1}é{\\k1}a{\\k1} {\\k1}👩‍👩🏽{\\k1} {\\k1}b\\N\\N{\\k1}m{\\k1}i{\\k1}W{\\k1}l{\\k0}。"
    assert even("word", 1.0) == "{\\k25}éa {\\k25}👩‍👩🏽 {\\k25}b\\N\\N{\\k25}miWl。"
    assert even("word", 1.0, [""]) == "" and sums(even("character", 7.77)) == 777
    sized = one(spark, x.karaoke_by_width(F.col("l"), F.col("d"), 42.0, "kf"), l=("array<string>", ["ab i", "漢W"]), d=("double", 1.0))
    widths = [char_width(c) * 42 for c in "ab i漢W"]
    quotas = [w * 100 / sum(widths) for w in widths]
    ticks = [int(q) for q in quotas]
    for k in sorted(range(6), key=lambda k: (-(quotas[k] - ticks[k]), k))[: 100 - sum(ticks)]:
        ticks[k] += 1
    t = [f"{{\\kf{n}}}{c}" for n, c in zip(ticks, "ab i漢W")]
    assert sized == "".join(t[:4]) + "\\N" + "".join(t[4:]) and sums(sized) == 100


def test_cues_that_do_not_fit_block_the_script(spark):
    cues = spark.createDataFrame([(1, 1, ["short"]), (1, 2, ["one", "two", "three"]), (2, 1, ["W" * 60]), (2, 2, ["<b>fits</b>"])], "a int, o int, lines array<string>")
    report = x.overflow_report(cues, ["a", "o"], "lines", 900, 42)
    assert sorted((row.a, row.o, row.problem) for row in report.collect()) == [(1, 2, "too_many_lines"), (2, 1, "too_wide")]
    script = lambda rows: x.render_ass(rows, "a", "o", F.col("lines"), F.lit(1.0), F.lit(2.0), F.lit(0), F.lit(0), problem=x.overflow_problem(F.col("lines"), 900, 42))
    with pytest.raises(Exception, match="rendering blocked"):
        script(cues).collect()
    assert script(cues.filter("(a, o) in ((1, 1), (2, 2))")).count() == 2
