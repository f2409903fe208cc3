import pytest
from pyspark.sql import functions as F

from linewright.operators import audits, batches, changes, matching, summary
from linewright.plans import stages
from linewright.sources import exports


def test_stage_tables_are_made_once(spark, tmp_path):
    rows, made = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), []

    def make():
        made.append(1)
        return rows

    prints = {"rows": stages.fingerprint(rows)}
    assert stages.fingerprint(rows.repartition(3).orderBy(F.desc("k"))) == prints["rows"]
    for _ in range(2):
        assert stages.stage(spark, str(tmp_path), "s", prints, make).count() == 2
    assert len(made) == 1
    other = {"rows": stages.fingerprint(rows.filter("k = 1"))}
    assert other != prints and stages.stage(spark, str(tmp_path), "s", other, make).count() == 2 and len(made) == 2


def test_batches_are_joined_by_key(spark):
    def answer(records):
        out = [{"k": r["k"], "value": r["t"].upper()} for r in records if r["k"] != 3]
        return out + [{"k": 99, "value": "x"}] + [{"k": 4, "value": "again"} for r in records if r["k"] == 4]

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "k long, t string").repartition(2)
    got = batches.by_batch(rows, "k", ["t"], answer, "string", size=2)
    assert sorted((r.k, r.value, r.outcome) for r in got.collect()) == [(0, "T0", "ok"), (1, "T1", "ok"), (2, "T2", "ok"), (3, None, "missing"), (4, None, "duplicate"), (5, "T5", "ok")]
    assert sorted(r.k for r in batches.still_open(rows, got, "k").collect()) == [3, 4]


def test_review_and_recovery_round_trips(spark):
    rows = spark.createDataFrame([("a.1", "one\ntwo", "eins"), ("b", "", "")], "i string, s string, t string")
    text = rows.agg(F.array_join(F.collect_list(exports.review_block(F.col("i"), F.col("s"), F.col("t"))), "\n").alias("x"))
    assert sorted((r.line_id, r.target) for r in exports.read_review(text, "x").collect()) == [("a.1", "eins"), ("b", "")]
    files = spark.createDataFrame([("f", bytearray(b"abc")), ("g", bytearray(b""))], "n string, c binary")
    package = exports.recovery_package(files, "n", "c")
    right, wrong = exports.recovered(package.unionByName(spark.createDataFrame([("h", "00", "YWJj"), ("i", "00", "!")], "n string, sha256 string, data string")), "n")
    assert sorted(r.n for r in right.collect()) == ["f", "g"] and sorted(r.n for r in wrong.collect()) == ["h", "i"]


def test_hot_keys_and_nulls(spark):
    hot = spark.createDataFrame([(i, "same") for i in range(500)] + [(500, "one"), (501, ""), (502, None)], "i long, k string")
    assert [r.i for r in matching.alone(hot, "k").collect()] == [500]
    once, more = changes.drop_ambiguous(hot, "k")
    assert sorted(r.i for r in once.collect()) == [500, 501] and more.count() == 1
    numbered = changes.numbered(hot, "i", "n").collect()
    assert sorted((r.i, r.n) for r in numbered) == [(i, i + 1) for i in range(503)]
    assert changes.numbered(hot.filter("i < 0"), "i", "n").count() == 0
    nulls = spark.createDataFrame([(None, "x"), (5, "y"), (None, "z"), (1 << 40, "w")], "i long, k string")
    assert sorted((r.n, r.i) for r in changes.numbered(nulls, "i", "n").collect() if r.i) == [(1, 5), (2, 1 << 40)] and changes.numbered(nulls, "i", "n").count() == 4
    assert sorted(r.n for r in changes.numbered(nulls.filter("i is null"), "i", "n").collect()) == [1, 2]
    assert summary.majority(hot.withColumn("g", F.lit(1)), ["g"], ["k"], "i").first().votes == 500


def test_word_timing(spark):
    rows = spark.createDataFrame([([("Hello", 0.0, 0.4), ("there", 0.5, 0.9)], "Hello there!"), ([("a", 0.5, 0.7), ("b", 0.6, 0.8)], "ab cd"), ([("a", 0.0, 9.0)], ""), ([("a", None, 1.0), ("b", -1.0, 1.0)], "x"), ([], "x")], "w array<struct<word:string,start:double,end:double>>, t string")
    got = rows.select(audits.word_timing_problem(F.col("w"), F.lit(1.0)), audits.word_coverage(F.col("t"), F.col("w"))).collect()
    assert [r[0] for r in got] == [None, "non_monotonic", "outside", "no_number", None] and [r[1] for r in got] == [100.0, 50.0, 0.0, 100.0, 0.0]


def test_unique_join_fails_on_what_it_forbids(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    full, other = frame(("a", 1), ("b", 2)).withColumnRenamed("v", "x"), frame(("a", 10), ("b", 20))
    assert sorted(map(tuple, matching.unique_join(full, other, "k").collect())) == [("a", 1, 10), ("b", 2, 20)]
    for wrong, message in ((frame(("a", 1), ("a", 2)), "duplicate key: a"), (frame(("a", 1), ("c", 2)), "missing row: b"), (frame(("a", 1)), "row count differs")):
        with pytest.raises(Exception, match=message):
            matching.unique_join(full, wrong, "k").collect()


def test_ranges_in_two_steps(spark):
    bounds, step = list(range(0, 1000, 3)), 19
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    arrays = lambda xs: F.array(*map(F.lit, xs))
    number = changes.range_of(F.col("v"), arrays([x[0] for x in parts]), F.array(*map(arrays, parts)), step)
    rows = spark.range(-5, 1005).withColumnRenamed("id", "v").withColumn("b", number).collect()
    assert all(r.b == sum(b <= r.v for b in bounds) for r in rows)


def test_ranks_in_many_ranges(spark):
    """Long common beginnings, ties, nulls, a hot value, rows that are alike, and columns with the names of helpers."""
    rows = [(f"voices/chapter_{i % 997:04d}/line.wav" if i % 3 else "voices/chapter_hot", None if i % 50 == 0 else i % 7, "b", i % 2) for i in range(3000)]
    df = spark.createDataFrame([(p, v, b, g, "r", 1.5) for p, v, b, g in rows], "path string, v int, _b string, g int, _r string, `a.b` double").repartition(3)
    got = changes.ranked(df, ["g"], ["path", "v"], "n", range_rows=100)
    assert got.columns == [*df.columns, "n"]
    held = got.collect()
    last = lambda x: (x[0], x[1] is None, x[1] or 0)
    for g in (0, 1):
        mine = sorted((r for r in held if r.g == g), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, 1501)) and [last((r.path, r.v)) for r in mine] == sorted(last(x) for x in rows if x[3] == g)
    assert {r["_b"] for r in held} == {"b"} and {r["_r"] for r in held} == {"r"}
    place = summary.placed(df, "path", ["v"], range_rows=100).collect()
    assert sorted(r.place for r in place) == list(range(1, 3001)) and [last((r.path, r.v)) for r in sorted(place, key=lambda r: r.place)] == sorted(map(last, rows))
    # many tasks ranked them, none more than a few ranges' rows
    most = changes.ranked(df.withColumn("one", F.lit(1)), [], ["one"], "n", range_rows=100).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 3000


def test_names_of_helpers_and_null_keys(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "k long, _o string, _g int, _r int")
    got = changes.upsert(frame((1, "a", 1, 1), (None, "old", 1, 1), (3, "gone", 1, 1)), frame((None, "new", 2, 2), (2, "b", 2, 2), (None, "newer", 3, 2)), frame((3, "", 0, 0)), "k", "_g")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", 1, 1, "kept"), (2, "b", 2, 2, "inserted"), (None, "newer", 3, 2, "updated")], key=repr)
    assert changes.upsert(frame((None, "x", 1, 1)), frame(), frame((None, "", 0, 0)), "k").count() == 0
    more = changes.append_numbered(frame((1, "a", 5, 1)).withColumn("_k", F.lit(1)).withColumn("_top", F.lit(7)), frame((1, "a", 0, 1), (9, "z", 0, 1), (4, "y", 0, 1)).drop("_g"), "k", "_g", "k")
    assert sorted((r.k, r["_g"], r["_o"]) for r in more.collect()) == [(4, 6, "y"), (9, 7, "z")]
    capped = summary.capped(frame((1, "a", 1, 4), (1, "b", 2, 5), (None, "c", 3, 6)), ["k"], ["_g"], 1).collect()
    assert sorted(((r.k, r["_o"], r["_r"], r.issue_count) for r in capped), key=repr) == [(1, "a", 4, 2), (None, "c", 6, 1)]


def test_edits_of_what_has_changed_fail(spark):
    frame = lambda schema, *rows: spark.createDataFrame(rows, schema)
    base, over = frame("k long, v string", (1, "a"), (2, "b")), frame("k long, v string", (1, "c"))
    edit = lambda was: changes.edit_overrides(base, over, frame("k long, v string, was string", (1, "d", was), (9, "x", "x")), "k", "v", "was")
    assert [tuple(r) for r in edit("c").collect()] == [(1, "d", "set")]
    with pytest.raises(Exception, match="changed since"):
        edit("a").collect()


def test_lines_without_frames_fail(spark):
    from linewright.operators import timeline

    rows = spark.createDataFrame([(1, 1, "g", 5), (1, 2, "g", None)], "a int, i int, g string, n long")
    with pytest.raises(Exception, match="frames"):
        timeline.resolve(rows, ["a"], ["i"], "g", F.col("n"), 8000).collect()
    assert timeline.resolve(rows, ["a"], ["i"], "g", F.col("n"), 8000, strict=False).count() == 2


def test_disjoint_union_and_qualities(spark):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "k string")
    assert changes.disjoint_union(frame("a"), frame("b", "c"), "k").count() == 3
    with pytest.raises(Exception, match="already there: a"):
        changes.disjoint_union(frame("a"), frame("b", "a"), "k").collect()
    assert [r[0] for r in frame("Good", "", "b").select(audits.normal_quality(F.col("k"))).collect()] == ["A", "unrated", "B"]
    with pytest.raises(Exception, match="no such quality"):
        frame("D").select(audits.normal_quality(F.col("k"))).collect()


def test_a_hot_name_is_not_multiplied(spark):
    rows = spark.createDataFrame([(i, "same", f"h{i}") for i in range(300)] + [(900, "one", None), (901, "two", "x"), (902, "two", "y")], "r long, n string, h string")
    members = spark.createDataFrame([(i, "same", f"h{i % 290}") for i in range(300)] + [(900, "one", "z"), (901, "two", "x"), (902, "two", "q")], "m long, n string, g string")
    held, rest = matching.assign(rows, members, "r", "m", "n", [("h", "g")])
    got = {(r.r, r.m) for r in held.collect()}
    assert got == {(i, i) for i in range(10, 290)} | {(900, 900), (901, 901), (902, 902)}
    assert {r.m for r in rest.collect()} == set(range(10)) | set(range(290, 300))


def test_reviews_are_guarded_by_their_source(spark):
    lines = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, s string")
    text = lines.withColumn("s", F.when(F.col("id") == "b", "changed").otherwise(F.col("s"))).select(exports.review_block(F.col("id"), F.col("s"), F.when(F.col("id") == "c", "").otherwise("t")).alias("x"))
    answers = exports.read_review(text, "x").unionByName(spark.createDataFrame([("z", "0" * 64, "t")], "line_id string, source_hash string, target string"))
    assert {r.line_id: r.outcome for r in exports.import_review(lines, answers, "id", "s").collect()} == {"a": "ok", "b": "stale", "c": "blank", "z": "unknown"}


def test_confidence_and_hashes(spark):
    from linewright.functions import text as tx

    rows = spark.createDataFrame([([(0.5,), (None,), (2.0,), (1.0,)], "a b\n"), ([], None)], "w array<struct<confidence:double>>, t string")
    assert [r[0] for r in rows.select(audits.mean_confidence(F.col("w"))).collect()] == [0.75, None]
    one = spark.createDataFrame([(1, None, "é")], "b int, a string, c string").select(tx.canonical_json(["c", "b", "a"])).first()[0]
    assert one == '{"a":null,"b":1,"c":"é"}'
    got = [r[0] for r in rows.select(tx.bare_hash(F.col("t")) == F.sha2(F.lit("ab"), 256)).collect()]
    assert got == [True, False]
