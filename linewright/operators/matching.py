"""Guarded joins: which text, member or label belongs to which line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alone(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose non-blank key no other row has. Keys are counted before the join, so a hot key is one row."""
    single = rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") == 1) & (F.col(key) != "")).select(F.col(key).alias("_k"))
    return rows.join(single, F.col(key) == F.col("_k"), "left_semi")


def unique_join_problems(full: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, problem) of what forbids a row-for-row join: duplicate, missing or surplus keys, and unequal counts (a null key)."""
    counted = other.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    duplicate = counted.filter("_n > 1").select(F.col("_k").alias(key), F.lit("duplicate").alias("problem"))
    met = full.select(key).join(counted, F.col(key) == F.col("_k"), "left")
    missing = met.filter("_k is null").select(key, F.lit("missing").alias("problem")).distinct()
    size = lambda rows, name: rows.agg(F.count("*").alias(name))
    unequal = size(full, "_a").join(F.broadcast(size(other, "_b")), how="inner").filter("_a <> _b").select(F.lit(None).cast(full.schema[key].dataType).alias(key), F.lit("unequal_counts").alias("problem"))
    return duplicate.unionByName(missing).unionByName(unequal)


def unique_join(full: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Each row of ``full`` with its one row of ``other``; the run fails on a duplicate or missing key or unequal counts.

    Keys are counted before the join, so a hot key fails without being multiplied.
    """
    clashing = [c for c in other.columns if c != key and c in full.columns]
    if clashing:
        raise ValueError(f"both sides have {clashing}")
    columns = [c for c in other.columns if c != key]
    single = other.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.min_by(F.struct(*columns), F.lit(0)).alias("_row"))
    sizes = full.agg(F.count("*").alias("_a")).join(F.broadcast(other.agg(F.count("*").alias("_b"))), how="inner")
    met = full.join(single, F.col(key) == F.col("_k"), "left").join(F.broadcast(sizes), how="inner")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    checked = (
        F.when(F.col("_a") != F.col("_b"), F.raise_error(F.concat(F.lit("row count differs: "), F.col("_a").cast("string"), F.lit(" and "), F.col("_b").cast("string"))))
        .when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), name)))
        .when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("missing row: "), name)))
        .otherwise(F.col("_row"))
    )
    return met.withColumn("_row", checked).select(*full.columns, *(F.col(f"_row.{c}").alias(c) for c in columns))


def _texts(right: DataFrame, value: str) -> DataFrame:
    """A blank text is none."""
    return right.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")


def cascade(left: DataFrame, right: DataFrame, left_id: str, exact: tuple[str, str], structural: tuple[str, str], value: str, order: str, reduce_right: bool = True) -> DataFrame:
    """left_id, value, tier of the lines that find a text: by exact name, else by a structural key.

    Of texts with one name the last in ``order`` holds; blank texts are none. The
    structural key counts only if it is alone on both sides among what is left.
    With ``reduce_right`` a text taken by name is out of the second pass; without
    it all texts stay in.
    """
    first, a, b = _cascade_sides(left, right, left_id, exact, structural, value, order, reduce_right)
    a = alone(a, structural[0]).select(left_id, F.col(structural[0]).alias("_a"))
    b = alone(b, structural[1]).select(F.col(structural[1]).alias("_b"), value)
    return first.unionByName(a.join(b, F.col("_a") == F.col("_b")).select(left_id, value, F.lit("structural").alias("tier")))


def _cascade_sides(left: DataFrame, right: DataFrame, left_id: str, exact: tuple[str, str], structural: tuple[str, str], value: str, order: str, reduce_right: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = _texts(right, value)
    named = texts.groupBy(exact[1]).agg(F.max_by(value, order).alias("_v")).withColumnRenamed(exact[1], "_name")
    first = left.join(named, F.col(exact[0]) == F.col("_name")).select(left_id, F.col("_v").alias(value), F.lit("exact").alias("tier"))
    rest = left.join(first.select(F.col(left_id).alias("_id")), F.col(left_id) == F.col("_id"), "left_anti")
    if reduce_right:
        # one text a name, as an index by name holds it; those taken are out
        single = texts.groupBy(exact[1]).agg(F.max_by(F.struct(*texts.columns), order).alias("_r")).select("_r.*")
        texts = single.join(left.select(F.col(exact[0]).alias("_taken")), F.col(exact[1]) == F.col("_taken"), "left_anti")
    return first, rest, texts


def cascade_report(left: DataFrame, right: DataFrame, left_id: str, exact: tuple[str, str], structural: tuple[str, str], value: str, order: str) -> DataFrame:
    """One row: exact, structural, total, unmatched, and conflicts (left keys that meet texts but not one to one)."""
    first, a, b = _cascade_sides(left, right, left_id, exact, structural, value, order, True)
    count = lambda rows, key, name: rows.filter(F.col(key) != "").groupBy(F.col(key).alias(f"_{name}k")).agg(F.count("*").alias(name))
    met = count(a, structural[0], "_l").join(count(b, structural[1], "_r"), F.col("__lk") == F.col("__rk"))
    single = (F.col("_l") == 1) & (F.col("_r") == 1)
    tiers = met.agg(F.count_if(single).alias("structural"), F.count_if(~single).alias("conflicts"))
    sums = first.agg(F.count("*").alias("exact")).join(F.broadcast(tiers), how="inner").join(F.broadcast(left.agg(F.count("*").alias("_all"))), how="inner")
    return sums.select("exact", "structural", (F.col("exact") + F.col("structural")).alias("total"), (F.col("_all") - F.col("exact") - F.col("structural")).alias("unmatched"), "conflicts")


def member_or_name(rows: DataFrame, members: DataFrame, member: str, name: str, member_col: str, name_col: str) -> DataFrame:
    """Add resolved and outcome: the row's member if it exists, else the only member of its name.

    outcome: member, name, ambiguous or missing.
    """
    own = members.select(F.col(member_col).alias("_m")).distinct()
    by_name = members.groupBy(name_col).agg(F.count("*").alias("_n"), F.min(member_col).alias("_only")).withColumnRenamed(name_col, "_name")
    joined = rows.join(own, F.col(member) == F.col("_m"), "left").join(by_name, F.col(name) == F.col("_name"), "left")
    outcome = F.when(F.col("_m").isNotNull(), "member").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return joined.withColumn("outcome", outcome).withColumn("resolved", F.when(F.col("outcome") == "member", F.col("_m")).when(F.col("outcome") == "name", F.col("_only"))).drop("_m", "_name", "_n", "_only")


def assign(rows: DataFrame, members: DataFrame, row_id: str, member_id: str, name: str, traits: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(assigned row and member pairs, members left over).

    Rows and members meet by name. A pair's score is the place, from the end, of the
    first of ``traits`` (row column, member column) in which both agree; names with
    no agreement score 1 less. A pair holds if its score is the best of both sides and
    no other pair of either has it. Values are counted within a name before they are
    joined, and a pair is made only where it is the one of its value, so a name that
    many rows share is not multiplied.
    """
    # a trait per tier, none in the last; within a tier only single values can be single pairs
    free_rows, free_members = rows, members
    held = None
    for a, b in [*traits, (None, None)]:
        keys_a, keys_b = [name, *([a] if a else [])], [name, *([b] if b else [])]
        filled = lambda df, c: df if c is None else df.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
        count = lambda df, keys, c, side: filled(df, c).groupBy(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias(f"_{side}"), F.min(row_id if side == "r" else member_id).alias(f"_id{side}"))
        on = [f"_k{i}" for i in range(len(keys_a))]
        met = count(free_rows, keys_a, a, "r").join(count(free_members, keys_b, b, "m"), on)
        one = met.filter("_r = 1 and _m = 1").select(F.col("_idr").alias(row_id), F.col("_idm").alias(member_id))
        held = one if held is None else held.unionByName(one)
        # rows and members that meet in this tier are settled by it, one pair or none
        drop = lambda df, keys: df.join(met.select(*(F.col(o).alias(f"_d{i}") for i, o in enumerate(on))), [F.col(k).cast("string") == F.col(f"_d{i}") for i, k in enumerate(keys)], "left_anti")
        free_rows, free_members = drop(free_rows, keys_a), drop(free_members, keys_b)
    taken = held.select(F.col(member_id).alias("_t"))
    return held, members.join(taken, F.col(member_id) == F.col("_t"), "left_anti")


def by_priority(targets: DataFrame, candidates: DataFrame, target_id: str, candidate_order: str, tiers: list[tuple[str, str]]) -> DataFrame:
    """target_id, candidate_order, method: each candidate goes to its lowest tier's target, each target takes its first candidate.

    ``tiers`` are (target column, candidate column) pairs in order of priority; a
    candidate that meets several targets of its tier takes the least.
    """
    met = None
    for k, (a, b) in enumerate(tiers):
        one = targets.select(target_id, F.col(a).alias("_k")).filter("_k is not null").join(candidates.select(candidate_order, F.col(b).alias("_c")), F.col("_k") == F.col("_c")).select(target_id, candidate_order, F.lit(k).alias("tier"))
        met = one if met is None else met.unionByName(one)
    chosen = met.groupBy(candidate_order).agg(F.min(F.struct("tier", target_id)).alias("_x")).select(candidate_order, "_x.*")
    return chosen.groupBy(target_id).agg(F.min(F.struct(candidate_order, "tier")).alias("_x")).select(target_id, f"_x.{candidate_order}", "_x.tier")


def layered(base: DataFrame, layers: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add the value of the last layer of a row's key over its own."""
    last = layers.groupBy(key).agg(F.max_by(value, order).alias("_v")).withColumnRenamed(key, "_k")
    return base.join(last, F.col(key) == F.col("_k"), "left").withColumn("resolved", F.coalesce("_v", value)).withColumn("overridden", F.col("_v").isNotNull()).drop("_v", "_k")


def guarded_overrides(entries: DataFrame, overrides: DataFrame, value: str, order: str) -> DataFrame:
    """Add the column ``value`` of the override that an entry takes, null if none, and its tier.

    Entries have id, filename, logical_id, member, of one row an id; overrides have
    the same, value and an order. Tier 0: the override of the entry's id, unless
    one of its names is another. Tier 1: the first in order of those that share the
    file name, where the members agree, or neither side has one and no other entry
    has the file name; or, of another file name, the logical id, if no other entry
    has the file name. Each tier is looked up by key, so no two groups are multiplied.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = ("filename", "logical_id", "member")
    held = entries.select("id", *(text(c).alias(c) for c in names))
    over = overrides.select(F.col("id").alias("o_id"), *(text(c).alias(f"o_{c}") for c in names), F.col(order).alias("_o"), F.col(value).alias("_v"))
    agree = lambda c: (F.col(c) == "") | (F.col(f"o_{c}") == "") | (F.col(c) == F.col(f"o_{c}"))
    last = over.groupBy("o_id").agg(F.max_by(F.struct("o_filename", "o_logical_id", "o_member", "_o", "_v"), "_o").alias("x")).select("o_id", "x.*")
    pick = lambda rows, tier: rows.select("id", F.struct(F.lit(tier).alias("tier"), F.col("_o").alias("o"), F.col("_v").alias("v")).alias("x"))
    exact = pick(held.join(last, F.col("id") == F.col("o_id")).filter(agree("filename") & agree("logical_id") & agree("member")), 0)

    many = held.groupBy("filename").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("filename").alias("_f"))
    single = held.join(many, F.col("filename") == F.col("_f"), "left_anti")
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct("_o", "_v")).alias("y")).select(*by, "y.*")
    member = first(over.filter("o_filename <> '' and o_member <> ''"), "o_filename", "o_member")
    by_member = pick(held.join(member, (F.col("filename") == F.col("o_filename")) & (F.col("member") == F.col("o_member"))), 1)
    plain = first(over.filter("o_filename <> '' and o_member = ''"), "o_filename")
    by_name = pick(single.filter("member = ''").join(plain, F.col("filename") == F.col("o_filename")), 1)
    # of one logical id the first override of each file name; the first two serve every entry
    each = first(over.filter("o_logical_id <> ''"), "o_logical_id", "o_filename")
    two = each.withColumn("_r", F.row_number().over(Window.partitionBy("o_logical_id").orderBy("_o"))).filter("_r <= 2")
    by_logical = pick(single.join(two, (F.col("logical_id") == F.col("o_logical_id")) & ((F.col("filename") != F.col("o_filename")) | (F.col("filename") == ""))), 1)
    best = exact.unionByName(by_member).unionByName(by_name).unionByName(by_logical).groupBy(F.col("id").alias("_id")).agg(F.min("x").alias("x"))
    return entries.join(best, F.col("id") == F.col("_id"), "left").select(*entries.columns, F.col("x.v").alias(value), F.col("x.tier").alias("tier"))


def reuse(rows: DataFrame, stored: DataFrame, key: str, fingerprints: list[str], passes: Column | None = None) -> DataFrame:
    """Add reusable: a stored row of the same key has the same fingerprints (input, glossary ...) and passes its checks again.

    ``passes`` is a condition over the stored row's columns.
    """
    kept = stored if passes is None else stored.filter(F.coalesce(passes, F.lit(False)))
    held = kept.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fingerprints)).distinct()
    met = F.col(key) == F.col("_k")
    for f in fingerprints:
        met = met & (F.col(f) == F.col(f"_{f}"))
    return rows.join(held, met, "left").withColumn("reusable", F.col("_k").isNotNull()).drop("_k", *(f"_{f}" for f in fingerprints))


def within_tolerance(left: DataFrame, right: DataFrame, on: Column, a: Column, b: Column, least: float, share: float, texts: tuple[Column, Column] | None = None) -> DataFrame:
    """Inner join of rows whose values differ by at most max(least, share of the first), and whose texts' hashes are equal."""
    same = F.lit(True) if texts is None else F.sha2(F.coalesce(texts[0], F.lit("")), 256) == F.sha2(F.coalesce(texts[1], F.lit("")), 256)
    return left.join(right, on & same).filter(F.abs(a - b) <= F.greatest(F.lit(least), a * share))


def dedupe_answers(answers: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Answers without whole repeats (the first in order stays), and without blank ones of a key that has one answer with a text."""
    columns = [c for c in answers.columns if c != order]
    once = answers.groupBy(*columns).agg(F.min(order).alias(order))
    filled = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    single = once.groupBy(F.col(key).alias("_k")).agg(F.count_if(filled).alias("_n")).filter("_n = 1")
    joined = once.join(single, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.filter(filled | F.col("_n").isNull()).select(*answers.columns)


def strict_response(wanted: DataFrame, got: DataFrame, key: str, value: str) -> DataFrame:
    """Each wanted row once, with outcome ok, missing or duplicate; answers to nothing wanted are dropped."""
    counted = got.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).withColumnRenamed(key, "_k")
    joined = wanted.join(counted, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("outcome", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("ok")).drop("_k", "_n")


def containing_terms(texts: DataFrame, terms: DataFrame, text: str, term: str, most_terms: int = 10_000) -> DataFrame:
    """Terms contained in any text. The glossary is checked to hold at most ``most_terms``, then broadcast."""
    if terms.count() > most_terms:
        raise ValueError(f"a glossary holds at most {most_terms} terms")
    held = F.broadcast(terms.distinct())
    return texts.join(held, F.contains(F.lower(text), F.lower(term))).select(term).distinct()


def by_routes(records: DataFrame, lines: DataFrame, record_id: str, line_id: str, routes: list[tuple[str, str]], order: str, only_alone: tuple[str, ...] = ()) -> DataFrame:
    """record_id, line_id, route: each record by its first route that meets a line.

    ``routes`` are (record column, line column). Of lines with one value the last in
    order holds, but on the line columns of ``only_alone`` a repeated value meets none.
    """
    met = None
    for k, (a, b) in enumerate(routes):
        lookup = lines.filter(F.coalesce(F.col(b).cast("string"), F.lit("")) != "").groupBy(F.col(b).cast("string").alias("_v")).agg(F.max_by(line_id, order).alias(line_id), F.count("*").alias("_n"))
        if b in only_alone:
            lookup = lookup.filter("_n = 1")
        one = records.select(record_id, F.col(a).cast("string").alias("_a")).join(lookup, F.col("_a") == F.col("_v")).select(record_id, F.struct(F.lit(k).alias("route"), line_id).alias("_x"))
        met = one if met is None else met.unionByName(one)
    return met.groupBy(record_id).agg(F.min("_x").alias("_x")).select(record_id, f"_x.{line_id}", "_x.route")
