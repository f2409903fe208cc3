"""Ordered operators: timelines, gaps, neighbours, and checks along an order.

Every operator takes the columns that name an archive and the place in it; rows
of one archive are ordered in one task, archives run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(archive: list[str], ordinal: list[str]):
    return Window.partitionBy(*archive).orderBy(*ordinal)


def samples(seconds: float, rate: int) -> int:
    """Half-even, like the rest of the engine."""
    return round(seconds * rate)


def resolve(lines: DataFrame, archive: list[str], ordinal: list[str], group: str, frames: Column, rate: int, intro: float = 10.0, same_gap: float = 2.5, group_gap: float = 5.0, strict: bool = True) -> DataFrame:
    """Add start_sample, end_sample, gap_after, next_start.

    A line without a positive number of frames fails the run; without ``strict`` it takes no time.

    The gap after a line depends on whether the next one changes group; the last
    line has none. Positions are running sums of whole samples.
    """
    by = _order(archive, ordinal)
    last = F.lead(F.lit(1)).over(by).isNull()
    gap = F.when(last, 0).when(F.lead(group).over(by).eqNullSafe(F.col(group)), samples(same_gap, rate)).otherwise(samples(group_gap, rate)).cast("long")
    n = F.coalesce(frames, F.lit(0)).cast("long")
    n = F.when(n <= 0, F.raise_error(F.lit("a line has no positive number of frames")).cast("long")).otherwise(n) if strict else F.greatest(n, F.lit(0).cast("long"))
    sized = lines.withColumn("_n", n).withColumn("gap_after", gap)
    before = F.coalesce(F.sum(F.col("_n") + F.col("gap_after")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = sized.withColumn("start_sample", (before + samples(intro, rate)).cast("long")).withColumn("end_sample", F.col("start_sample") + F.col("_n"))
    return timed.withColumn("next_start", F.col("end_sample") + F.col("gap_after")).drop("_n")


def segments(timed: DataFrame, archive: list[str], ordinal: list[str], same_samples: int, intro_samples: int) -> DataFrame:
    """Lines and the silences between them, one row each: kind, start_sample, n_samples."""
    first = F.row_number().over(_order(archive, ordinal)) == 1
    part = lambda kind, start, n: F.struct(kind.alias("kind"), start.cast("long").alias("start_sample"), n.cast("long").alias("n_samples"))
    rows = F.array(
        part(F.lit("intro"), F.lit(0), F.when(first, intro_samples).otherwise(0)),
        part(F.lit("voice"), F.col("start_sample"), F.col("end_sample") - F.col("start_sample")),
        part(F.when(F.col("gap_after") == same_samples, "between").otherwise("chapter"), F.col("end_sample"), F.col("gap_after")),
    )
    every = timed.withColumn("_s", rows).select(*archive, *ordinal, F.inline("_s"))
    return every.filter((F.col("kind") == "voice") | (F.col("n_samples") > 0))


def boundaries(lines: DataFrame, archive: list[str], ordinal: list[str], group: str) -> DataFrame:
    changed = F.row_number().over(_order(archive, ordinal)) > 1
    changed = changed & ~F.lag(group).over(_order(archive, ordinal)).eqNullSafe(F.col(group))
    return lines.withColumn("_c", changed).groupBy(*archive).agg(F.count_if("_c").alias("boundaries"), F.count("*").alias("lines"))


def gaps(lines: DataFrame, archive: list[str], ordinal: list[str], start: Column, end: Column) -> DataFrame:
    """Add gap_before: from the previous line's end to this start, never negative, null for the first."""
    by = _order(archive, ordinal)
    return lines.withColumn("gap_before", F.greatest(F.lit(0).cast("long"), start - F.lag(end).over(by))).withColumn("gap_before", F.when(F.row_number().over(by) > 1, F.col("gap_before")))


def fades(lines: DataFrame, archive: list[str], ordinal: list[str], start: Column, end: Column, fade_in: int, fade_out: int) -> DataFrame:
    """Add fade_in, fade_out and too_tight (the pair into the next line does not fit).

    The first fade in is held to what precedes it, the last fade out is free.
    """
    by = _order(archive, ordinal)
    begin = F.greatest(F.lit(0).cast("long"), start)
    first = F.row_number().over(by) == 1
    room = F.greatest(F.lit(0).cast("long"), F.lead(start).over(by) - end)
    has_next = F.lead(start).over(by).isNotNull()
    return lines.withColumn("fade_in", F.when(first, F.least(F.lit(fade_in).cast("long"), begin)).otherwise(fade_in).cast("long")).withColumn("fade_out", F.lit(fade_out).cast("long")).withColumn("too_tight", has_next & (F.lit(fade_in + fade_out) > room))


def envelope(lines: DataFrame, archive: list[str], ordinal: list[str], start: Column, end: Column, fade: int) -> DataFrame:
    """Add before and after: shares of the silence around a line, halved where two fades do not fit."""
    by = _order(archive, ordinal)
    gap_before = F.greatest(F.lit(0).cast("long"), start - F.coalesce(F.lag(end).over(by), F.lit(0)))
    gap_after = F.greatest(F.lit(0).cast("long"), F.lead(start).over(by) - end)
    half = lambda gap: F.when(gap < 2 * fade, F.floor(gap / 2)).otherwise(gap)
    before = F.least(F.lit(fade).cast("long"), F.when(F.row_number().over(by) == 1, gap_before).otherwise(half(gap_before)))
    after = F.when(F.lead(start).over(by).isNull(), fade).otherwise(F.least(F.lit(fade).cast("long"), half(gap_after)))
    return lines.withColumn("before", before.cast("long")).withColumn("after", after.cast("long"))


def neighbours(lines: DataFrame, archive: list[str], ordinal: list[str], text: str, related: str) -> DataFrame:
    """Add context_before and context_after: the adjacent texts where ``related`` is the same and not blank."""
    by = _order(archive, ordinal)
    near = lambda f: F.when((f(related).over(by) == F.col(related)) & (F.col(related) != ""), f(text).over(by))
    return lines.withColumn("context_before", near(F.lag)).withColumn("context_after", near(F.lead))


def non_monotonic(lines: DataFrame, archive: list[str], ordinal: list[str], start: str, valid: Column) -> DataFrame:
    """Valid rows whose start lies before that of the last valid row."""
    by = _order(archive, ordinal).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(valid, F.col(start)), ignorenulls=True).over(by)
    return lines.withColumn("last_valid", last).filter(valid & (F.col(start) < F.col("last_valid")))


def occurrences(lines: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """Add occurrence: 1 for the first row of a key in order."""
    return lines.withColumn("occurrence", F.row_number().over(_order(key, ordinal)))


def apportion(parts: DataFrame, within: list[str], ordinal: list[str], weight: str, units: int) -> DataFrame:
    """Add units: whole shares by the largest remainder, ties by order; all 0 where weights are."""
    total = F.sum(weight).over(Window.partitionBy(*within))
    floor = F.when(total > 0, F.floor(F.col(weight) * units / total)).otherwise(0).cast("long")
    rest = F.when(total > 0, F.col(weight) * units % total).otherwise(0)
    share = parts.withColumn("_f", floor).withColumn("_r", rest).withColumn("_t", total)
    left = F.when(F.col("_t") > 0, units - F.sum("_f").over(Window.partitionBy(*within))).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_r"), *ordinal))
    return share.withColumn("units", F.col("_f") + (rank <= left).cast("long")).drop("_f", "_r", "_t")
