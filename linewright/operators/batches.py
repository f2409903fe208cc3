"""Row functions of the caller (a model client, an aligner) run over batches in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.operators.tables import apart, columns_of
from linewright.plans.stages import stage


def by_batch(rows: DataFrame, key: str, fields: list[str], answer: Callable[[list[dict]], list[dict]], output: str, size: int = 80, attempts: int = 2) -> DataFrame:
    """key, value, outcome: ``answer`` gets lists of at most ``size`` records and returns records with key and value.

    Answers are joined back by key: a key that an answer lacks or repeats is asked
    for again up to ``attempts`` times, then reported as missing or duplicate.
    Answers to other keys are dropped. The function must not mind being repeated.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            records = frame.to_dict("records")
            for at in range(0, len(records), size):
                open_, done = records[at : at + size], []
                for attempt in range(attempts):
                    wanted = {r[key] for r in open_}
                    got: dict = {}
                    for a in answer(open_):
                        if a.get(key) in wanted:
                            got.setdefault(a[key], []).append(a.get("value"))
                    last = attempt == attempts - 1
                    done += [(r[key], got[r[key]][0], "ok") for r in open_ if len(got.get(r[key], ())) == 1]
                    open_ = [r for r in open_ if len(got.get(r[key], ())) != 1]
                    if last:
                        done += [(r[key], None, "duplicate" if r[key] in got else "missing") for r in open_]
                    if not open_:
                        break
                yield pd.DataFrame(done, columns=[key, "value", "outcome"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *fields).mapInPandas(run, f"{key} {kind}, value {output}, outcome string")


def still_open(rows: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Rows without a good answer in a stored table of answers."""
    held = answered.filter("outcome = 'ok'").select(F.col(key).alias("_k")).distinct()
    return rows.join(held, F.col(key) == F.col("_k"), "left_anti")


#: Parts of the keys by which a budget is spent, in the order of their hashes.
SPENDING_PARTS = 1024


def affordable(rows: DataFrame, key: str, cost: str, budget: float | None) -> DataFrame:
    """The rows, in the order of their keys' hashes, whose costs together stay within a budget; all if there is none.

    Whole parts of the hashes are added up on the driver, and only the part in which
    the budget ends is summed row by row.
    """
    if budget is None:
        return rows
    p = apart(rows)
    hashed = rows.withColumn(f"{p}h", F.xxhash64(key)).withColumn(f"{p}part", F.pmod(f"{p}h", F.lit(SPENDING_PARTS)))
    sums = {r[0]: r[1] or 0 for r in hashed.groupBy(f"{p}part").agg(F.sum(cost)).collect()}
    whole, left, last = [], budget, None
    for part in sorted(sums):
        if sums[part] > left:
            last = part
            break
        whole.append(part)
        left -= sums[part]
    end = -1 if last is None else last
    running = F.sum(cost).over(Window.partitionBy(f"{p}part").orderBy(f"{p}h", key))
    partly = hashed.filter(F.col(f"{p}part") == end).withColumn(f"{p}sum", running).filter(F.col(f"{p}sum") <= left)
    fully = hashed.filter(F.col(f"{p}part") < F.lit(end)) if last is not None else hashed
    return fully.select(*columns_of(rows)).unionByName(partly.select(*columns_of(rows)))


def answered_in_rounds(rows: DataFrame, key: str, fields: list[str], answer: Callable[[list[dict]], list[dict]], check: Column, root: str, output: str = "string", rounds: int = 3, size: int = 80, parts: int = 4, budget: float | None = None, cost: Column | None = None) -> DataFrame:
    """Answer, check, and answer again until nothing is wrong, nothing changes, or rounds or budget are used up.

    ``answer`` gets records of the key, the fields, and the former value and its
    problem (none in the first round), as in ``by_batch``. ``check`` is a problem, or
    null, of the fields and the column ``value``; a missing or repeated answer is one
    too. ``cost`` of a row (tokens, say) is spent each time it is asked.

    Every round is stored below ``root`` in ``parts`` tables. A run that was broken off
    goes on where it was: lines of a stored part are not asked again. Returns key,
    value, problem, asked (times) and outcome: ok, review (a problem is left: a
    person's turn) or budget (never asked).
    """
    spark = rows.sparkSession
    given = rows.select(key, *fields)
    open_ = given.withColumns({"value": F.lit(None).cast(output), "problem": F.lit(None).cast("string"), "cost": F.lit(0.0) if cost is None else cost.cast("double")})
    left, tables = budget, []
    for k in range(rounds):
        asked = affordable(open_, key, "cost", left)

        def make(part: int, asked: DataFrame = asked) -> DataFrame:
            mine = asked.filter(F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)) == part)
            got = by_batch(mine, key, [*fields, "value", "problem"], answer, output, size, attempts=1)
            back = mine.select(F.col(key).alias("own"), *fields, "cost").join(got, F.col("own") == F.col(key))
            return back.withColumn("problem", F.when(F.col("outcome") == "ok", check).otherwise(F.col("outcome"))).select(key, "value", "problem", "cost")

        stored = [stage(spark, root, f"round{k}", {"part": f"{part}of{parts}"}, lambda part=part: make(part)) for part in range(parts)]
        table = reduce(DataFrame.unionByName, stored)
        tables.append(table.withColumn("round", F.lit(k)))
        if left is not None:
            left -= table.agg(F.sum("cost")).first()[0] or 0
        wrong = table.filter("problem is not null").select(F.col(key).alias("own"), F.col("value").alias("v"), F.col("problem").alias("p"))
        met = open_.join(wrong, F.col(key) == F.col("own"))
        changed = met.agg(F.count_if(~(F.col("v").eqNullSafe(F.col("value")) & F.col("p").eqNullSafe(F.col("problem"))))).first()[0]
        open_ = met.withColumns({"value": F.col("v"), "problem": F.col("p")}).select(*open_.columns)
        if not changed:
            break  # none is open, or the same would be asked again
    last = reduce(DataFrame.unionByName, tables).groupBy(F.col(key).alias("own")).agg(F.max_by(F.struct("value", "problem"), "round").alias("x"), F.count("*").alias("asked"))
    out = given.select(key).join(last, F.col(key) == F.col("own"), "left")
    outcome = F.when(F.col("x").isNull(), "budget").when(F.col("x.problem").isNull(), "ok").otherwise("review")
    return out.select(key, F.col("x.value").alias("value"), F.col("x.problem").alias("problem"), F.coalesce("asked", F.lit(0)).alias("asked"), outcome.alias("outcome"))
