from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewright.operators import batches


def model(folder, broken):
    """Notes each key it is asked for; answers wrongly once; fails on a key while a file says so."""

    def answer(records):
        import os
        import uuid

        if os.path.exists(broken) and any(r["k"] == 77 for r in records):
            raise RuntimeError("the model is away")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{r['k']}\n" for r in records)
        return [{"k": r["k"], "value": r["t"].upper() if r["problem"] == "lower" or r["k"] % 4 else r["t"]} for r in records]

    return answer


def asked(folder):
    return Counter(int(line) for f in folder.iterdir() for line in f.read_text().split())


def test_a_broken_run_goes_on_and_asks_nothing_twice(spark, tmp_path):
    folder, broken = tmp_path / "asked", tmp_path / "broken"
    folder.mkdir()
    broken.write_text("")
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("text "), "id").alias("t")).repartition(3)
    run = lambda: batches.answered_in_rounds(rows, "k", ["t"], model(str(folder), str(broken)), F.when(F.col("value") != F.upper("t"), "lower"), str(tmp_path / "rounds"), size=10, parts=8)
    with pytest.raises(Exception, match="the model is away"):
        run().collect()
    stored = list((tmp_path / "rounds").rglob("_SUCCESS"))
    assert 0 <= len(stored) < 8
    before = spark.read.parquet(*(str(p.parent) for p in stored)).select("k").collect() if stored else []
    broken.unlink()
    got = {r.k: r for r in run().collect()}
    assert all(r.outcome == "ok" and r.value == f"TEXT {k}" and r.asked == (2 if k % 4 == 0 else 1) for k, r in got.items()) and len(got) == 200
    times = asked(folder)
    assert all(times[r.k] == got[r.k].asked for r in before)
    total = sum(times.values())
    assert {r.k: r.value for r in run().collect()} == {k: r.value for k, r in got.items()} and sum(asked(folder).values()) == total  # a third run asks nothing


def test_budgets_and_empty_tables(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    right = lambda records: [{"k": r["k"], "value": "X"} for r in records]
    got = batches.answered_in_rounds(rows, "k", ["t"], right, F.lit(None).cast("string"), str(tmp_path / "a"), budget=101.0, cost=F.lit(3)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"ok": 33, "budget": 467}
    whole = batches.answered_in_rounds(rows, "k", ["t"], right, F.lit("never right"), str(tmp_path / "b"), budget=1e9, cost=F.lit(3)).collect()
    assert {(r.outcome, r.problem, r.asked) for r in whole} == {("review", "never right", 2)}  # the same answer again: a fixed point
    assert batches.answered_in_rounds(rows.limit(0), "k", ["t"], right, F.lit(None).cast("string"), str(tmp_path / "c")).count() == 0
