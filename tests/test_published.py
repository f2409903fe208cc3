import glob

import pytest
from pyspark.sql import functions as F

from linewright.sources import published as p


def entries(spark, n=50):
    return spark.range(n).select(
        F.col("id").alias("index"), F.concat(F.lit("vo_mira_"), "id", F.when(F.col("id") % 3 == 0, "_F").otherwise(""), F.lit(".wav")).alias("filename"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("pack/"), "id")).alias("source_member_id"), F.lit("g").alias("group"), (F.col("id") * 70.0005).alias("start_seconds"),
        (F.col("id") * 70.0005 + 1).alias("audio_end_seconds"), (F.col("id") * 70.0005 - 2).alias("display_end_seconds"), F.lit('say "so",\nthen').alias("english"), F.lit(None).cast("string").alias("chinese"),
        F.when(F.col("id") % 2 == 0, "official_chs_lab").otherwise("machine").alias("chinese_source"), F.lit(None).cast("string").alias("reference_language"), F.lit(None).cast("string").alias("reference_text"),
        (F.col("id") / 3).alias("source_duration_seconds"), F.lit("ab").alias("sha256"),
    )


def test_columns_and_values(spark):
    made = p.manifest(entries(spark))
    assert tuple(p.corrected_index(made, identities=False).columns) == p.CORRECTED and len(p.CORRECTED) == 17
    index = p.corrected_index(made)
    assert tuple(index.columns) == p.AUGMENTED and len(p.AUGMENTED) == 19
    edits = spark.createDataFrame(
        [("pack/2", "", 0, "by member", True, 1), ("pack/2", "", 0, "by member, last", None, 2), ("", "vo_mira_1.wav", 9, "by name", True, 3), (None, None, 5, "by number", False, 4), ("", "", None, "nothing", True, 5)],
        "source_member_id string, filename string, id long, final_chs string, modified boolean, at int",
    )
    rows = {int(r["index"]): r for r in p.synced(index, edits, "at").collect()}
    assert len(rows) == 50 and rows[3].asDict()["logical_id"] == "vo_mira_3" and rows[3].variant == "f"
    assert [(rows[k].final_chs, rows[k].modified) for k in (2, 1, 5, 7)] == [("by member, last", "false"), ("by name", "true"), ("by number", "false"), ("", "")]
    assert rows[9].final_chs == "by name" and rows[0].final_chs == "by member, last"  # their numbers are also those of edits
    assert (rows[0].start, rows[0].display_end, rows[0].source_duration_seconds, rows[0].target_text_source, rows[1].target_text_source, rows[0].reference_language, rows[1].source_member_id) == ("00:00.000", "00:00.000", "0.000000", "official_target_lab", "machine", "auto", "")
    assert rows[49].start == "57:10.024" and spark.range(1).select(p.minutes_clock(F.lit(7384.0605))).first()[0] == "123:04.060"


def test_a_failed_write_leaves_the_former_version(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        p.published(spark, folder, "index")
    made = p.manifest(entries(spark))
    first = p.publish(spark, folder, {"manifest": made, "index": p.corrected_index(made)}, {"manifest": ["index"], "index": ["index"]}, {"entries": 50})
    assert p.report(spark, folder) == {"entries": 50}
    want = sorted(map(str, p.corrected_index(made).collect()))
    assert sorted(map(str, p.published(spark, folder, "index").collect())) == want
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/versions/{first}/index/csv").fillna("")
    assert sorted(map(str, csv.collect())) == want and tuple(csv.columns) == p.AUGMENTED
    bad = p.corrected_index(made).withColumn("sha256", F.when(F.col("index") == 30, F.raise_error(F.lit("lost"))).otherwise("cd"))
    with pytest.raises(Exception, match="lost"):  # the manifest of the new version is written, its index is not
        p.publish(spark, folder, {"manifest": made, "index": bad}, {"manifest": ["index"], "index": ["index"]})
    assert sorted(map(str, p.published(spark, folder, "index").collect())) == want
    assert len(glob.glob(f"{tmp_path}/out/versions/*")) == 2 and p.drop_old(spark, folder) == 1
    second = p.publish(spark, folder, {"index": p.corrected_index(made).limit(3)}, {"index": ["index"]})
    assert second != first and p.published(spark, folder, "index").count() == 3
    assert p.drop_old(spark, folder) == 1 and p.published(spark, folder, "index").count() == 3
    files = [line for f in sorted(glob.glob(f"{tmp_path}/out/versions/{second}/index/json/part-*")) for line in open(f)]
    assert len(files) == 3
