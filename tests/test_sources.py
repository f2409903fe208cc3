import io
import json
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from linewright.sources import archives, exports, tables
from linewright.streaming.updates import apply_updates, start_archive


def wav(frames, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * frames)
    return out.getvalue()


def test_csv_index(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿序号,分组,文件名,来源,来源细分,英文文本,SHA-256\n1,g,chapter1_2_x_1.wav,s,d,\"two\nlines\",ABC\n,,chapter10_1_y_2.wav,,,hello,\n,,,,,no name,\n", encoding="utf-8")
    rows = tables.normal_index(tables.read_rows(spark, str(tmp_path / "a.csv"))).orderBy("ordinal").collect()
    assert [(r["index"], r.group, r.filename, r.english, r.sha256, r.problems) for r in rows] == [("1", "g", "chapter1_2_x_1.wav", "two\nlines", "abc", []), ("2", "chapter10_1", "chapter10_1_y_2.wav", "hello", "", []), ("3", "", "", "no name", "", ["no_filename"])]


def test_json_map_and_names(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"voice\\a\\One.wem": {"text": "x"}, "two.wav": {"text": "y"}}))
    wanted = spark.createDataFrame([("one.WAV",)], "filename string")
    rows = tables.read_object_map(spark, str(tmp_path / "m.json"), "text string", wanted).collect()
    assert [(r.ordinal, r.text, r.asked) for r in rows] == [(0, "x", "one.WAV")]
    (tmp_path / "n.txt").write_text("take | chapter1.wav please\nnothing\nB.WAV\n")
    assert sorted(r[0] for r in tables.candidate_names(spark, str(tmp_path / "n.txt")).collect()) == ["B.WAV", "chapter1.wav"]


def test_zip_members_headers_and_inventory(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name, data in (("one/dup.wav", wav(10)), ("one/dup.lab", b"a"), ("two/dup.wav", wav(20)), ("three/solo.wav", wav(5)), ("bad.wav", b"RIFF")):
            z.writestr(name, data)
    archives.register(spark)
    members = spark.read.format("zip_members").option("content", "true").load(str(tmp_path / "p.zip"))
    counts, shared = archives.inventory(members)
    row = counts.first()
    assert row[:3] == (5, 4, 1) and (row.pairs, row.member_pairs, row.stem_pairs, row.unlabelled) == (1, 2, 1, 2)
    assert archives.inventory(members.repartition(3))[0].first().digest == row.digest != archives.inventory(members.limit(4))[0].first().digest
    assert sorted(tuple(r) for r in shared.collect()) == [("dup.wav", "one/dup.wav"), ("dup.wav", "two/dup.wav")]
    heads = {r.member: r.h for r in members.filter("member like '%.wav'").select("member", archives.wav_header_of("content").alias("h")).collect()}
    assert (heads["two/dup.wav"].frames, heads["two/dup.wav"].sample_rate, heads["two/dup.wav"].sample_bits) == (20, 8000, 16) and heads["bad.wav"].problem == "not_wave"
    assert members.filter(F.col("member").isin("one/dup.lab")).count() == 1
    large = b"RF64" + b"\xff" * 4 + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 40, 20, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 48000, 96000, 2, 16) + b"data" + b"\xff" * 4
    assert archives.wav_header(large)["frames"] == 20
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.wav", b"")
    with pytest.raises(Exception, match="unsafe"):
        spark.read.format("zip_members").load(str(tmp_path / "bad.zip")).count()


def test_xlsx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "i.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>hash</t></si><si><t>filename</t></si><si><r><t>a</t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2" t="s"><v>2</v></c></row><row><c r="A3"><v>7</v></c><c r="B3" t="inlineStr"><is><t>b.wav</t></is></c></row></sheetData></worksheet>')
    archives.register(spark)
    rows = spark.read.format("xlsx_index").load(str(tmp_path / "i.xlsx"))
    assert [(r.ordinal, r.filename, r.cells["hash"]) for r in rows.orderBy("ordinal").collect()] == [(0, "a1.wav", ""), (1, "b.wav", "7")]
    assert [r.ordinal for r in rows.filter(F.col("filename").isin("b.wav")).collect()] == [1]


def test_folder_audit(spark, tmp_path):
    import hashlib

    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.wav").write_bytes(b"abc")
    files = archives.read_folder(spark, str(tmp_path))
    want = spark.createDataFrame([("x/a.wav", hashlib.sha256(b"abc").hexdigest().upper()), ("x/b.wav", "0" * 64), ("x/a.wav", ""), ("x/a.wav", "0" * 64)], "member string, sha string")
    assert sorted(r[0] for r in want.join(files, "member", "left").select(archives.source_outcome(F.col("sha"), F.col("content"))).collect()) == ["mismatch", "missing", "unverifiable", "verified"]


def test_training_set(spark, tmp_path):
    rows = spark.createDataFrame([(1, "hello"), (2, " ")], "id long, text string")
    judged = exports.training_list(rows, [("blank", F.trim("text") == "")], "id", "s", F.lit("en"), F.concat("id", F.lit(".wav")), F.col("text"))
    exports.write_training_set(judged, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.line, r.reason, r.accepted in (True, "true")) for r in back.collect()) == [(1, "1.wav|s|en|hello", None, True), (2, None, "blank", False)]
    exports.write_index(rows, str(tmp_path / "csv"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_stream_of_updates(spark, tmp_path):
    start_archive(spark, spark.createDataFrame([("a", 1, 1)], "name string, at long, idx long"), str(tmp_path / "archive"))
    for batch in ([("a", 1), ("b", 2)], [("c", 3), ("b", 2)]):
        spark.createDataFrame(batch, "name string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("name string, at long").parquet(str(tmp_path / "in"))
        apply_updates(stream, str(tmp_path / "archive"), str(tmp_path / "check"), "name", "idx", "at").awaitTermination()
    assert sorted((r.name, r.idx) for r in spark.read.parquet(str(tmp_path / "archive")).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_side_tables_and_search(spark, tmp_path):
    (tmp_path / "s.csv").write_text("文件名,英文,中文文本,来源成员路径,name\na.wav,hello,你好,,no alias\na.wav,again,再见,x/a.wav,\n")
    rows = tables.read_rows(spark, str(tmp_path / "s.csv"))
    assert sorted(map(tuple, tables.side_table(rows).collect())) == [("a.wav", "hello", "你好"), ("x/a.wav", "again", "再见")]
    (tmp_path / "d.csv").write_text("filename,chinese\na.wav,1\na.wav,2\n")
    with pytest.raises(Exception, match="repeated_key"):
        tables.side_table(tables.read_rows(spark, str(tmp_path / "d.csv"))).collect()
    found = spark.createDataFrame([("Hu_Tao-01", ""), ("x", "HU TAO!"), ("hut ao", None), ("other", "tao hu")], "a string, b string")
    assert tables.search_compacted(found, "Hu Tao", ["a", "b"]).count() == 3
    with pytest.raises(ValueError):
        tables.search_compacted(found, " - ", ["a"])


def test_names_and_labs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entries": [{"filename": "x.wav"}, {"filename": "y.wav"}]}')
    (tmp_path / "b.json").write_text('["x.wav", {"filename": "z.wav"}]')
    (tmp_path / "c.csv").write_text("wav,other\nd\\e,1\nf.WAV,2\n,3\n")
    names = lambda f: sorted(r[0] for r in tables.candidate_names(spark, str(tmp_path / f)).collect())
    assert (names("a.json"), names("b.json"), names("c.csv")) == (["x.wav", "y.wav"], ["x.wav", "z.wav"], ["d/e.wav", "f.WAV"])
    for name, text in (("p/one.lab", "hello "), ("q/one.LAB", "hello"), ("p/two.lab", "a"), ("q/two.lab", "b"), ("q/no.txt", "c")):
        (tmp_path / "labs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "labs" / name).write_text(text)
    members, stems = tables.read_labs(spark, str(tmp_path / "labs"))
    assert sorted(map(tuple, members.collect())) == [("p/one.lab", "hello"), ("p/two.lab", "a"), ("q/one.LAB", "hello"), ("q/two.lab", "b")]
    assert [tuple(r) for r in stems.collect()] == [("one", "hello")]


def test_voice_maps_and_workbooks(spark, tmp_path):
    record = {"fileName": "voice\\EN\\Take_1.wem", "npcName": "Ann", "text": " hello "}
    (tmp_path / "m.json").write_text(json.dumps({"EN/1": record, "JP/2": {"sourceFileName": "x", "avatarName": "Bo"}, "EN/3": {"text": "no file"}, "EN/4": "no record"}))
    rows = tables.read_voice_map(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, rows.collect())) == [(0, "Take_1.wav", "EN/1", "Ann", "hello", "voice\\EN\\Take_1.wem", ""), (1, "x.wav", "JP/2", "Bo", "", "x", "Bo")]
    assert [r.ordinal for r in tables.read_voice_map(spark, str(tmp_path / "m.json"), "JP/").collect()] == [1]
    wanted = spark.createDataFrame([("a/TAKE_1.WAV",)], "filename string")
    assert [r.filename for r in tables.only_filenames(rows, wanted).collect()] == ["TAKE_1.WAV"]
    cells = {"语音哈希": "h", "语音文件名": "a", "角色": "Big Ann", "语音文本": "t"}
    sheet = spark.createDataFrame([("w", 0, cells), ("w", 1, {**cells, "角色": "Bo"})], "workbook string, ordinal long, cells map<string,string>")
    assert [tuple(r) for r in tables.workbook_voices(sheet, " ann").collect()] == [("a.wav", "h", "Big Ann", "t", "")]
    with pytest.raises(Exception, match="missing columns: 角色"):
        tables.workbook_voices(spark.createDataFrame([("w", 0, {k: v for k, v in cells.items() if k != "角色"})], sheet.schema), "ann").collect()


def test_members_are_read_whatever_their_case(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name in ("One/A.wav", "two/b.wav"):
            z.writestr(name, b"x")
    archives.register(spark)
    got = spark.read.format("zip_members").option("members", json.dumps(["one\\a.WAV"])).load(str(tmp_path / "p.zip"))
    assert [r.member for r in got.collect()] == ["One/A.wav"]
