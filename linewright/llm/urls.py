"""URL filters: fixed host and path rules, then association rules from labels.

FP-growth over the tokens of labelled URLs finds token combinations; rules that
point to a bad label are kept if support, confidence and lift suffice and the
confidence's lower bound (Wilson, 95 %) stays over a half, and a rule is dropped
if a shorter one within it is as confident. URLs meet rules through
an inverted index on each rule's rarest token.

Mining is bounded. No rule of fewer than ``LEAST_ROWS`` rows can pass the lower
bound, so none is mined. Tokens of exactly the same rows are mined as one; each of
them then stands for it in the rules. FP-growth lists combinations of any size, so a
row that still has more than ``MOST_ITEMS`` items is mined as several: its items are
dealt into groups of ``GROUP``, and each union of as many groups as a rule has tokens
is a row. Every combination of that many items lies in one of them, so none that is
frequent is missed; as some are counted more than once, all that are found are
counted again in the rows as they are.

Only DataFrame operations and the FP-growth of Spark's own ML library run.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import ascii_lower, settle, small_side

BAD = "label=bad"
#: Square of the normal quantile of the confidence's lower bound, and the least such bound.
Z2, LEAST_BOUND = 1.96**2, 0.5
#: Z2 / (1 / LEAST_BOUND - 1) rows at least: fewer cannot reach the bound even if all are bad.
LEAST_ROWS, MOST_ITEMS, GROUP = 4, 16, 5


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` ("host/path", verdict) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Host labels and words between hyphens, file endings and path words; numbers are left out."""
    labels = F.split(host, r"\.")
    parts = F.split(host, r"[.-]")
    steps = F.split(ascii_lower(path), r"[^a-z0-9]+")
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: ~F.rlike(x, F.lit("^[0-9]*$"))), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(named("host:", labels), named("part:", parts), named("path:", steps)))


def subsets(items: Column, most: int) -> Column:
    """Sorted combinations of 1 to ``most`` of a sorted array's items."""
    every = one = F.transform(items, lambda x: F.array(x))
    for _ in range(most - 1):
        one = F.flatten(F.transform(one, lambda c: F.transform(F.filter(items, lambda x: x > F.element_at(c, -1)), lambda x: F.array_append(c, x))))
        every = F.concat(every, one)
    return every


def covering_rows(held: DataFrame, most: int) -> DataFrame:
    """(bad, items) rows of at most MOST_ITEMS or most x GROUP items: each combination of up to ``most`` items of a row lies in one of its own."""
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size("items") / GROUP).cast("int") - 1), lambda k: F.slice("items", k * GROUP + 1, F.lit(GROUP)))
    # sorted by group, so that a part begins with its first group: one group's parts are made at a time
    rest = lambda k: F.sequence(k + 1, F.size("groups") - 1)
    several = held.filter(F.size("items") > MOST_ITEMS).withColumn("groups", groups)
    single = several.filter(F.size("groups") < most).select("bad", "items")
    first = several.filter(F.size("groups") >= most).select("bad", "groups", F.explode(F.sequence(F.lit(0), F.size("groups") - most)).alias("k"))
    others = subsets(rest(F.col("k")), most - 1) if most > 1 else F.array(F.array().cast("array<int>"))
    chosen = first.select("bad", "groups", "k", F.explode(F.filter(others, lambda c: F.size(c) == most - 1)).alias("others"))
    parts = chosen.select("bad", F.flatten(F.transform(F.concat(F.array("k"), "others"), lambda k: F.get("groups", k))).alias("items"))
    return held.filter(F.size("items") <= MOST_ITEMS).select("bad", "items").unionByName(single).unionByName(parts)


def frequent(held: DataFrame, least: int, most: int) -> DataFrame:
    """(items, n, bad) of the combinations of up to ``most`` items in ``least`` bad rows or more, by FP-growth."""
    mined = settle(covering_rows(held, most).select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "mined")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, mined.count()))).fit(mined)
    said = F.array_contains("items", BAD) & F.size("items").between(2, most + 1)
    sets = settle(model.freqItemsets.filter(said).select(F.array_sort(F.array_remove("items", BAD)).alias("c")), "sets")
    # counted in the rows as they are: a combination meets the rows of its rarest item
    often = held.select(F.explode("items").alias("x")).groupBy("x").agg(F.count("*").alias("often"))
    key = sets.select("c", F.explode("c").alias("x")).join(often, "x").groupBy("c").agg(F.min(F.struct("often", "x"))["x"].alias("key"))
    met = held.select("bad", "items", F.explode("items").alias("x")).join(small_side(settle(key, "keys")), F.col("x") == F.col("key"))
    counted = met.filter(F.size(F.array_except("c", "items")) == 0).groupBy("c").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
    return counted.filter(F.col("b") >= least).select(F.col("c").alias("items"), "n", F.col("b").alias("bad"))


def mine(labelled: DataFrame, support: float, confidence: float, lift: float, most_tokens: int) -> DataFrame:
    """(rule_id, tokens, confidence) from rows of (tokens, bad)."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double")
    rows = settle(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    least = max(LEAST_ROWS, math.ceil(support * total - 1e-9))
    if bad < least:
        return empty
    # tokens of the same rows: equal counts, and equal sums of two hashes of the rows' numbers
    seal = lambda k: F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}")
    tokens = rows.select("row", "bad", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), seal(1), seal(2)).filter(F.col("b") >= least)
    tokens = settle(tokens.withColumn("item", F.min("t").over(Window.partitionBy("n", "s1", "s2"))).select("t", "item"), "tokens")
    held = rows.select("row", "bad", F.explode("tokens").alias("t")).join(small_side(tokens.filter("t = item")), "t").groupBy("row", "bad").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = settle(held, "items")
    sets = frequent(held, least, most_tokens)
    n, p = F.col("n"), F.col("bad") / F.col("n")
    bound = (p + Z2 / (2 * n) - F.sqrt(Z2 * (p * (1 - p) / n + Z2 / (4 * n * n)))) / (1 + Z2 / n)
    good = sets.filter((p >= confidence) & (p / (bad / total) >= lift) & (bound >= LEAST_BOUND))
    rules = settle(good.select(F.col("items").alias("tokens"), p.alias("confidence")).withColumn("rule_id", F.xxhash64("tokens")), "rules")
    # a longer rule goes if a part of it is a rule as confident: parts are looked up whole
    parts = rules.select("rule_id", "confidence", F.explode(F.filter(subsets(F.col("tokens"), most_tokens - 1), lambda c: F.size(c) < F.size("tokens"))).alias("part")) if most_tokens > 1 else None
    if parts is not None:
        short = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c2"))
        rules = rules.join(parts.join(short, "part").filter(F.col("c2") >= F.col("confidence")).select("rule_id").distinct(), "rule_id", "left_anti")
    return rules.select("rule_id", "tokens", "confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id) pairs reduced to the best rule of each distinct url: url, rule_tokens, confidence."""
    held = urls.select("url", F.explode("tokens").alias("t"))
    counts = held.groupBy("t").agg(F.count("*").alias("n"))
    spread = rules.select("rule_id", F.col("tokens").alias("rule_tokens"), "confidence", F.explode("tokens").alias("t")).join(counts, "t")
    # the index has each rule under its rarest token only
    index = settle(spread.groupBy("rule_id", "rule_tokens", "confidence").agg(F.min(F.struct("n", "t"))["t"].alias("key")), "rule-index")
    side = small_side(index)
    fit = urls.select("url", "tokens", F.explode("tokens").alias("t")).join(side, F.col("t") == F.col("key")).filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = fit.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("rule_tokens", " ").alias("rule_tokens"))).alias("best"))
    return best.select(F.col("url").alias("m_url"), F.col("best.rule_tokens").alias("rule_tokens"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], support: float = 0.002, confidence: float = 0.8, lift: float = 2.0, most_tokens: int = 3) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, rule_tokens, confidence.

    ``labelled``: url and bad (boolean). A page takes its fixed rule's verdict,
    else block if a mined rule fits it, else allow. Null urls and urls without
    "://" have an empty host and path and are allowed. Without labels nothing is
    mined. Repeated rows each give a row; an empty table gives none. Very long
    urls are read whole. Columns but page_id and url are not read.
    """
    parts = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    mined = mine(parts(labelled).select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), support, confidence, lift, most_tokens)
    named = parts(pages.select("page_id", "url"))
    distinct = named.select("url", tokens_of(F.col("host"), F.col("path")).alias("tokens")).dropDuplicates(["url"])
    found = matched(distinct, mined)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    out = named.withColumn("rule", rule).withColumn("fixed", verdict).join(found, F.col("url") == F.col("m_url"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "rule_tokens", "confidence")
