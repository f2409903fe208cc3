"""Audits and roll-ups over lines, their words, their reviews and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import first_filled
from linewright.operators.tables import apart


def word_timing_problem(words: Column, duration: Column, slack: float = 0.05) -> Column:
    """The first word's problem of an array of (word, start, end), else null; no shuffle.

    A word has no_number, negative_span, outside (before 0 or after the duration) or
    non_monotonic (it starts before the last one ends).
    """
    start = F.struct(F.lit(0.0).alias("end"), F.lit(None).cast("string").alias("problem"))

    def step(acc: Column, w: Column) -> Column:
        bad = F.when(w["start"].isNull() | w["end"].isNull() | F.isnan(w["start"]) | F.isnan(w["end"]), "no_number").when(w["end"] < w["start"], "negative_span").when((w["start"] < 0) | (w["end"] > duration + slack), "outside").when(w["start"] < acc["end"], "non_monotonic")
        return F.struct(F.coalesce(w["end"], acc["end"]).alias("end"), F.coalesce(acc["problem"], bad).alias("problem"))

    return F.aggregate(words, start, step, lambda acc: acc["problem"])


def word_coverage(text: Column, words: Column) -> Column:
    """Share of a text's letters and digits that its timed words hold, in percent, at most 100."""
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    spoken = F.aggregate(words, F.lit(0), lambda a, w: a + letters(w["word"]))
    return F.when(letters(text) == 0, 0.0).otherwise(F.least(F.lit(100.0), F.bround(spoken * 100.0 / letters(text), 2)))


def mean_confidence(words: Column) -> Column:
    """Mean of the words' confidences that are numbers from 0 to 1, to four places; null if there are none."""
    known = F.filter(F.transform(words, lambda w: w["confidence"].cast("double")), lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0, 1))
    return F.when(F.size(known) > 0, F.bround(F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known), 4))


def review_rollup(answers: DataFrame, line: str, verdict: str) -> DataFrame:
    """One verdict a line: no over unclear over missing over yes; anything else is missing."""
    v = F.lower(F.coalesce(F.trim(verdict), F.lit("")))
    counts = answers.groupBy(line).agg(F.count("*").alias("answers"), F.count_if(v == "no").alias("no"), F.count_if(v == "unclear").alias("unclear"), F.count_if(~v.isin("yes", "no", "unclear")).alias("open"))
    return counts.withColumn("status", F.when(F.col("no") > 0, "no").when(F.col("unclear") > 0, "unclear").when(F.col("open") > 0, "missing").otherwise("yes"))


def multiset_difference(rows: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """(key, token, missing, extra): how often each token is in one array more than in the other.

    A key's only row is settled within the row: its tokens are sorted and their runs
    summed up, so no task holds a table of tokens. Keys of several rows are grouped.
    """
    p = apart(rows)
    token = lambda x, n: F.transform(F.coalesce(x, F.array()), lambda t: F.struct(t.alias("token"), F.lit(n).alias("s")))
    counted = rows.withColumn(f"{p}n", F.count("*").over(Window.partitionBy(*key))).select(*key, F.col(f"{p}n"), token(a, 1).alias(f"{p}a"), token(b, -1).alias(f"{p}b"))

    def runs(ts: Column) -> Column:
        first = F.transform(ts, lambda t, k: F.when((k == 0) | ~t["token"].eqNullSafe(F.get(ts, k - 1)["token"]), k))
        return F.element_at(F.transform(F.array(F.array_compact(first)), lambda at: F.transform(at, lambda k, i: summed(ts, k, F.coalesce(F.get(at, i + 1), F.size(ts))))), 1)

    def summed(ts: Column, k: Column, end: Column) -> Column:
        return F.struct(F.get(ts, k)["token"].alias("token"), F.aggregate(F.slice(ts, k + 1, end - k), F.lit(0).cast("long"), lambda d, t: d + t["s"]).alias("d"))

    tokens = F.concat(f"{p}a", f"{p}b")
    alone = counted.filter(F.col(f"{p}n") == 1).select(*key, F.inline(F.element_at(F.transform(F.array(F.sort_array(tokens)), runs), 1)))
    several = counted.filter(F.col(f"{p}n") > 1).select(*key, F.inline(tokens)).groupBy(*key, "token").agg(F.sum("s").alias("d"))
    both = alone.unionByName(several).filter("d <> 0")
    return both.select(*key, "token", F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def group_coverage(lines: DataFrame, archive: list[str], group: str, ordinal: str, source: str, target: str) -> DataFrame:
    """Lines, and those with source and target text, by group; first is the group's first place."""
    filled = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return lines.groupBy(*archive, group).agg(F.count("*").alias("lines"), filled(source).alias("with_source"), filled(target).alias("with_target"), F.min(ordinal).alias("first"))


def candidate_scores(records: DataFrame, voices: DataFrame, candidate: str, name: str, text: str, bonus: Column) -> DataFrame:
    """Index candidates by the voices they name: score = 1000 coverage + matched texts + bonus; rank 1 is best.

    Ranks are over the candidates, a row each, with ties by the candidate's name.
    """
    total = voices.agg(F.count_distinct(name).alias("_all"))
    known = voices.select(F.col(name).alias("_v")).distinct()
    matched = records.join(known, F.col(name) == F.col("_v"), "left")
    each = matched.groupBy(candidate).agg(F.count_distinct("_v").alias("covered"), F.count_if(F.col("_v").isNotNull() & (F.trim(text) != "")).alias("texts"))
    scored = each.join(F.broadcast(total), how="inner")
    score = F.col("covered") / F.greatest(F.col("_all"), F.lit(1)) * 1000 + F.col("texts") + bonus
    ranked = scored.select(candidate, "covered", "texts", score.alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), candidate)).cast("long"))


def reference_pairs(rows: DataFrame, locale: str, path: str, ordinal: str, base: str, other: str) -> DataFrame:
    """Each line of the base locale with the other locale's first line of the same path."""
    first = rows.filter(F.col(locale) == other).groupBy(path).agg(F.min(ordinal).alias("pair")).withColumnRenamed(path, "_p")
    return rows.filter(F.col(locale) == base).join(first, F.col(path) == F.col("_p"), "left").drop("_p")


def training_rows(corrected: DataFrame, manifest: DataFrame, member: str, index: str, fields: list[str], order: str) -> DataFrame:
    """Corrected rows with the manifest's fields: by member, by index only if a row has no member.

    A field the manifest has overwrites the corrected one, even if it is blank. Of
    manifest rows with one member or index the last in ``order`` holds.
    """
    held = F.struct(*fields)
    with_member = manifest.filter(F.coalesce(member, F.lit("")) != "").groupBy(F.col(member).alias("_member")).agg(F.max_by(held, order).alias("_m"), F.lit(True).alias("_by_member"))
    by_index = manifest.groupBy(F.col(index).alias("_index")).agg(F.max_by(held, order).alias("_i"), F.lit(True).alias("_by_index"))
    blank = F.coalesce(F.col(member), F.lit("")) == ""
    joined = corrected.join(with_member, F.col(member) == F.col("_member"), "left").join(by_index, blank & (F.col(index) == F.col("_index")), "left")
    picked = [F.when(F.col("_by_member"), F.col(f"_m.{f}")).when(F.col("_by_index"), F.col(f"_i.{f}")).otherwise(F.col(f) if f in corrected.columns else F.lit(None)).alias(f) for f in fields]
    return joined.select(*(c for c in corrected.columns if c not in fields), *picked, F.when(F.col("_by_member"), "member").when(F.col("_by_index"), "index").otherwise("none").alias("route"))


def page_buckets(rows: DataFrame, index: str, size: int = 100) -> DataFrame:
    """One request a page of ``size`` positions: page start, wanted positions."""
    page = (F.floor(F.col(index) / size) * size).cast("long")
    return rows.withColumn("page", page).groupBy("page").agg(F.array_sort(F.collect_set(index)).alias("positions"))


def usage_ledger(calls: DataFrame, by: list[str], usage: str) -> DataFrame:
    """Token sums of JSON usage objects in several dialects; incomplete if any call has none."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(usage, p).try_cast("long") for p in paths))
    read = calls.withColumn("_in", at("$.prompt_tokens", "$.input_tokens", "$.usage.input")).withColumn("_out", at("$.completion_tokens", "$.output_tokens", "$.usage.output"))
    return read.groupBy(*by).agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("_out"), F.lit(0)).alias("output_tokens"), F.bool_or(F.col("_in").isNull() | F.col("_out").isNull()).alias("incomplete"), F.count("*").alias("calls"))


def cost(input_tokens: Column, output_tokens: Column, input_price: float | None, output_price: float | None) -> Column:
    """Dollars of a ledger's tokens at prices a million tokens; null without prices."""
    if input_price is None or output_price is None:
        return F.lit(None).cast("double")
    return (input_tokens * F.lit(float(input_price)) + output_tokens * F.lit(float(output_price))) / 1_000_000.0


def duration_of(start: Column, end: Column, samples: Column, rate: Column) -> Column:
    """The first finite, positive one of end - start and samples / rate."""
    a, b = end.try_cast("double") - start.try_cast("double"), samples.try_cast("double") / F.nullif(rate.try_cast("double"), F.lit(0.0))
    fit = lambda x: F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)
    return F.coalesce(fit(a), fit(b))


def normal_value(value: Column, legacy: dict[str, str], default: str) -> Column:
    """An enum's value in its present spelling; blank becomes the default."""
    x = F.lower(F.trim(first_filled(value)))
    known = F.create_map(*(F.lit(v) for pair in legacy.items() for v in pair))
    return F.when(x == "", default).otherwise(F.coalesce(known[x], x))


# The codes of a structural audit.
STRUCTURE_CODES = ("duplicate_entry_id", "duplicate_source_member", "source_member_missing", "source_text_missing", "target_text_missing", "source_audio_hash_missing", "invalid_source_timeline", "non_monotonic_timeline")


def structure_issues(entries: DataFrame, archive: list[str], ordinal: list[str], id_: str, member: str, source: str, target: str, sha256: str, start: str, end: str, shown: str) -> DataFrame:
    """A row for each of eight faults of an archive's entries: archive, ordinal, code.

    An id or member is a duplicate from its second row on. Times must be numbers,
    start at 0 or later and end after the start; a valid row that starts before the
    last valid one is non_monotonic.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    # a blank value repeats nothing: its rows are told apart by their place, so that they don't meet in one task
    again = lambda c: F.row_number().over(Window.partitionBy(*archive, c, F.when(empty(c), F.struct(*ordinal))).orderBy(*ordinal)) > 1
    a, b, c = (F.col(x).try_cast("double") for x in (start, end, shown))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    until = F.coalesce(c, b)
    valid = F.coalesce(number(a) & number(b) & number(until) & (a >= 0) & (b > a) & (until > a), F.lit(False))
    order = Window.partitionBy(*archive).orderBy(*ordinal)
    before = F.last(F.when(F.col("_valid"), a), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = entries.withColumn("_valid", valid).withColumn("_before", before).withColumn("_id2", F.row_number().over(Window.partitionBy(*archive, id_).orderBy(*ordinal)) > 1).withColumn("_m2", again(member))
    digest = F.rlike(F.trim(F.coalesce(F.col(sha256), F.lit(""))), F.lit("^[0-9a-fA-F]{64}$"))
    failed = (F.col("_id2"), ~empty(member) & F.col("_m2"), empty(member), empty(source), empty(target), ~digest, ~F.col("_valid"), F.col("_valid") & (a < F.col("_before") - 0.000001))
    codes = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(code)) for code, x in zip(STRUCTURE_CODES, failed))))
    return seen.select(*archive, *ordinal, F.explode(codes).alias("code"))


def alignment_diagnostics(lines: DataFrame, by: list[str], available: Column, valid: Column, provider: Column) -> DataFrame:
    """total, usable, invalid, missing, usable_percent, and a map of the usable lines' providers, by group."""
    provided = lines.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_there", F.coalesce(available, F.lit(False))).withColumn("_p", F.coalesce(F.nullif(provider, F.lit("")), F.lit("unknown")))
    each = provided.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.count_if("_valid").alias("_u"), F.count_if(F.col("_there") & ~F.col("_valid")).alias("_i"))
    held = F.filter(F.collect_list(F.when(F.col("_u") > 0, F.struct("_p", "_u"))), lambda x: x.isNotNull())  # a row a provider
    sums = each.groupBy(*by).agg(F.sum("_n").alias("total"), F.sum("_u").alias("usable"), F.sum("_i").alias("invalid"), F.map_from_entries(F.array_sort(held)).alias("providers"))
    return sums.select(*by, "total", "usable", "invalid", (F.col("total") - F.col("usable") - F.col("invalid")).alias("missing"), F.bround(F.col("usable") * 100.0 / F.col("total"), 2).alias("usable_percent"), "providers")


def official_rows(lines: DataFrame, source: str, target: str, origin: str) -> DataFrame:
    """Lines with both texts whose target did not come from a model's interface."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return lines.filter(filled(source) & filled(target) & ~F.coalesce(F.col(origin), F.lit("")).startswith("api:"))


#: Fixed value: the least share of an archive's voices that an index must name.
LEAST_COVERAGE = 0.5


def preflight(voices: DataFrame, index: DataFrame, archive: list[str], name: str, text: str, own_text: str) -> DataFrame:
    """A row for each finding before a build: archive, level (blocker or warning), code, n.

    ``voices``: a row a voice file, with the text packed beside it if any
    (``own_text``). ``index``: archive, name and text. A name that several rows of the
    index have counts as not named. Complete packed texts stand in for an index that
    names too few voices; else that blocks the build.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    keys = [*archive, name]
    once = index.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_rows"), F.max(filled(text)).alias("_text"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = voices.join(once, met, "left")
    named = F.col("_rows") == 1
    voice = F.col(name).isNotNull()
    sums = joined.groupBy(*archive).agg(
        F.count_if(voice).alias("total"), F.count_if(named).alias("named"), F.count_if(named & F.col("_text")).alias("texts"),
        F.count_if(F.col("_rows") > 1).alias("shared"), F.count_if(voice & filled(own_text)).alias("packed"),
    )
    total, known = F.col("total"), F.col("named")
    few = known / F.greatest(total, F.lit(1)) < LEAST_COVERAGE
    packed = (total > 0) & (F.col("packed") == total)
    finding = lambda when, level, code, n: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.alias("n")))
    found = F.array_compact(F.array(
        finding(total == 0, "blocker", "no_voices", total),
        finding((total > 0) & (known == 0) & ~packed, "blocker", "no_index", known),
        finding((known > 0) & few & ~packed, "blocker", "coverage_below_minimum", known),
        finding(few & packed, "warning", "packed_texts_used", known),
        finding(~few & (known < total), "warning", "voices_not_in_index", total - known),
        finding(~few & (F.col("texts") < known), "warning", "no_source_text", known - F.col("texts")),
        finding(~few & (F.col("shared") > 0), "warning", "shared_names", F.col("shared")),
    ))
    return sums.select(*archive, F.inline(found))


# Reference qualities by their present and earlier spellings.
QUALITIES = {"": "unrated", "unrated": "unrated", "good": "A", "ok": "B", "poor": "C", "a": "A", "b": "B", "c": "C"}


def normal_quality(value: Column) -> Column:
    """A reference's quality in its present spelling; the run fails on any other value."""
    x = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.create_map(*(F.lit(v) for pair in QUALITIES.items() for v in pair))[x]
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("no such quality: "), x)).cast("string")).otherwise(known)
