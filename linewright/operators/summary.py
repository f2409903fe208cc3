"""Reports, samples and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import FAMILY_HINT, KINDS, VOICE_ANECDOTE, stem
from linewright.operators.changes import RANGE_ROWS, ranked
from linewright.operators.tables import apart, columns_of


def counters(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def majority(rows: DataFrame, by: list[str], value: list[str], order: str) -> DataFrame:
    """The most frequent value of each group, ties to the one met first in order."""
    counted = rows.groupBy(*by, *value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "first"))
    return counted.withColumn("_r", best).filter("_r = 1").drop("_r")


def token_share(rows: DataFrame, tokens: Column, k: int) -> DataFrame:
    """The k tokens in most rows, with their share of rows; ties by token."""
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(k)
    return top.join(F.broadcast(total), how="inner").select("token", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def pivot(rows: DataFrame, by: str, value: str, values: list[str]) -> DataFrame:
    """Counts of the given values by group and over all (a null group), zero where none."""
    return rows.rollup(by).agg(*(F.count_if(F.col(value) == v).alias(v) for v in values), F.count("*").alias("total"))


def batch_estimate(rows: DataFrame, by: list[str], order: list[str], chars: Column, size: int, overhead: int) -> DataFrame:
    """Batches of ``size`` rows in order: batches, and tokens = sum of ceil((characters + overhead) / 4).

    A group of any size is ranked in ranges.
    """
    p = apart(rows)
    sized = ranked(rows.select(*dict.fromkeys([*by, *order]), chars.alias(f"{p}n")), by, order, f"{p}r")
    each = sized.groupBy(*by, F.floor((F.col(f"{p}r") - 1) / size).alias(f"{p}b")).agg(F.ceil((F.sum(f"{p}n") + overhead) / 4).alias(f"{p}t"))
    return each.groupBy(*by).agg(F.count("*").alias("batches"), F.sum(f"{p}t").cast("long").alias("tokens"))


def ordered_digest(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """SHA-256 of a group's values in order, one to a line. A group's values must fit a task."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["v"]), "\n"), 256).alias("digest"), F.count("*").alias("rows"))


def stratified(rows: DataFrame, stratum: Column, key: Column, seed: str, n: int) -> DataFrame:
    """n rows in turn from the strata, within one by SHA-256 of seed and key: reproducible on any layout."""
    hashed = rows.withColumn("stratum", stratum).withColumn("_h", F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key), 256))
    ranked = hashed.withColumn("round", F.row_number().over(Window.partitionBy("stratum").orderBy("_h")).cast("long"))
    return ranked.filter(F.col("round") <= n).orderBy("round", "stratum").limit(n).drop("_h")


def retain(rows: DataFrame, active: Column, newest: list[Column], n: int) -> DataFrame:
    """All active rows, and the newest others up to n in all."""
    others = rows.filter(~active).orderBy(*newest).limit(n)  # no more than n can stay
    ranked = others.withColumn("_r", F.row_number().over(Window.orderBy(*newest)))  # at most n rows
    held = rows.filter(active).agg(F.greatest(F.lit(0), F.lit(n) - F.count("*")).alias("_room"))
    return rows.filter(active).unionByName(ranked.join(F.broadcast(held), how="inner").filter("_r <= _room").drop("_r", "_room"))


def capped(issues: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` issues of a group, each with the group's full count, which is an aggregate's and not a window's."""
    p = apart(issues)
    counts = issues.groupBy(*(F.col(c).alias(f"{p}{c}") for c in by)).agg(F.count("*").alias("issue_count"))
    first = issues.withColumn(f"{p}r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(f"{p}r") <= most)
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"{p}{c}"))
    return first.join(counts, met).select(*columns_of(issues), "issue_count")


def package_kind(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """kind, confidence, matched, total of each package by its file names; one anecdote name outweighs the other families."""
    given = F.trim(F.coalesce(F.col(name), F.lit(""))) != ""
    fits = lambda pattern: F.count_if(given & F.rlike(stem(F.col(name)), F.lit(pattern)))
    counted = rows.groupBy(*by).agg(F.count_if(given).alias("total"), fits(VOICE_ANECDOTE).alias("_a"), fits(FAMILY_HINT).alias("_b"))
    matched = F.when(F.col("_a") > 0, F.col("_a")).otherwise(F.col("_b"))
    kind = F.when(F.col("_a") > 0, KINDS[0]).when(F.col("_b") > 0, KINDS[1]).otherwise(KINDS[2])
    confidence = F.when(F.col("total") == 0, "none").when(matched == 0, "low").when(matched * 4 >= F.col("total") * 3, "high").otherwise("medium")
    return counted.select(*by, kind.alias("kind"), confidence.alias("confidence"), matched.alias("matched"), "total")


def covering(rows: DataFrame, key: str, name: str, group: str, n: int) -> DataFrame:
    """(key, tier) of n rows that cover an archive.

    Tier 1: two rows of each repeated name; 2: one row of each group without any
    of those; 3: rows spread over the order at 3 n even places; 4: the rest in order.
    """
    repeated = rows.groupBy(name).agg(F.count("*").alias("_c")).filter("_c > 1").select(F.col(name).alias("_n"))
    first = rows.join(repeated, F.col(name) == F.col("_n"), "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(key))).filter("_r <= 2")
    covered = first.select(F.col(group).alias("_g")).distinct()
    second = rows.join(covered, F.col(group) == F.col("_g"), "left_anti").groupBy(group).agg(F.min(key).alias(key))
    total = rows.agg(F.count("*").alias("_all"))
    placed = ranked(rows, [], [key], "_i").join(F.broadcast(total), how="inner").withColumn("_i", F.col("_i") - 1)
    # place i is one of floor(k * all / 3n) if the next k reaches it
    k = F.ceil(F.col("_i") * (3 * n) / F.col("_all"))
    third = placed.filter((k < 3 * n) & (F.floor(k * F.col("_all") / (3 * n)) == F.col("_i")))
    tiers = [first, second, third, rows]
    every = None
    for tier, part in enumerate(tiers, 1):
        one = part.select(key, F.lit(tier).alias("tier"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min("tier").alias("tier")).orderBy("tier", key).limit(n)


def placed(rows: DataFrame, outer: str, inner: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add place: 1, 2, ... by ``outer`` and then ``inner``; neither the rows of one outer value nor values with a common beginning pass one task."""
    return ranked(rows, [], [outer, *inner], "place", range_rows)


def classification_summary(rows: DataFrame, value: dict[str, str], total_if: Column, key: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(dimension, value, n, share) of each column in ``value`` (dimension -> column), and (dimension, value, key) of up to ``most`` examples in order.

    ``share`` is over the rows for which ``total_if`` holds, to four places.
    """
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in value.items()))
    long = rows.select(F.col(key), total_if.alias("_in"), F.inline(each))
    total = rows.agg(F.count_if(total_if).alias("_all"))
    counted = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if("_in").alias("_k"))
    counts = counted.join(F.broadcast(total), how="inner").select("dimension", "value", "n", F.bround(F.col("_k") / F.greatest(F.col("_all"), F.lit(1)), 4).alias("share"))
    place = F.row_number().over(Window.partitionBy("dimension", "value").orderBy(key))
    return counts, long.withColumn("_r", place).filter(F.col("_r") <= most).select("dimension", "value", key)


#: Names of a cue search's selectors, and what they ask of a cue's flags.
SELECTORS = {
    "modified": "modified", "modified_subtitles": "modified", "official": "official <> ''", "official_chinese": "official <> ''", "official_chs": "official <> ''",
    "api": "api <> ''", "api_translated": "api <> ''", "api_chs": "api <> ''", "overflow": "overflow", "layout_overflow": "overflow",
    "karaoke_ready": "aligned", "aligned": "aligned", "word_aligned": "aligned", "karaoke_missing": "not aligned", "unaligned": "not aligned", "word_alignment_missing": "not aligned",
    "unreviewed": "not confirmed", "needs_review": "not confirmed", "confirmed": "confirmed", "reviewed": "confirmed",
}


def search_cues(cues: DataFrame, needle: str = "", at: float | None = None, until: float | None = None, selector: str = "") -> DataFrame:
    """Cues (id, source, official, api, final, start, end, modified, overflow, aligned, confirmed) that a search asks for.

    The needle may stand in any of the four texts or the id, whatever its case; the
    interval is closed; a selector of an unknown name selects all.
    """
    found = cues
    if (condition := SELECTORS.get(selector.strip().lower())) is not None:
        found = found.filter(F.coalesce(F.expr(condition), F.lit("not" in condition)))
    if needle.strip():
        held = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle.strip().casefold())) for c in ("source", "official", "api", "final", "id")]
        found = found.filter(reduce(lambda a, b: a | b, held))
    if at is not None:
        found = found.filter(F.col("end") >= at)
    return found if until is None else found.filter(F.col("start") <= until)
