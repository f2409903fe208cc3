"""What changed between two states of an archive, and how to bring them together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.operators.tables import apart, columns_of, stored


def classify(existing: DataFrame, candidates: DataFrame, name: str, logical: str, order: str, member: str | None = None) -> DataFrame:
    """The first candidate in order of each name, with kind exact, variant, ambiguous, new or invalid.

    A name without a folder is exact if one line has it, ambiguous if several have,
    a variant if a line of another name has its logical id, else new. A name with a
    folder is exact if it is a member of the archive (column ``member``), else new. A
    name that is empty, absolute or has a step . or .. is invalid; each is kept.
    """
    names = existing.groupBy(F.col(name).alias("_n")).agg(F.count("*").alias("_c"))
    lines = existing.select(F.col(logical).alias("_l")).distinct()
    path = F.trim(F.translate(F.coalesce(F.col(name).cast("string"), F.lit("")), "\\", "/"))
    cleaned = candidates.withColumn(name, path).withColumn("_bad", (path == "") | F.rlike(path, F.lit(r"^/|(^|/)\.\.?(/|$)")))
    one = cleaned.filter("not _bad").groupBy(name).agg(F.min_by(F.struct(*(c for c in cleaned.columns if c != name)), order).alias("_x")).select(name, "_x.*").select(*cleaned.columns)
    joined = one.join(names, F.col(name) == F.col("_n"), "left").join(lines, F.col(logical) == F.col("_l"), "left")
    folder = F.contains(F.col(name), F.lit("/"))
    if member is None:
        held = F.lit(False)
    else:
        members = existing.select(F.translate(member, "\\", "/").alias("_m")).filter("_m <> ''").distinct()
        joined, held = joined.join(members, F.col(name) == F.col("_m"), "left"), F.col("_m").isNotNull()
    kind = F.when(folder & held, "exact").when(folder, "new").when(F.col("_c") > 1, "ambiguous").when(F.col("_c") == 1, "exact").when(F.col("_l").isNotNull(), "variant").otherwise("new")
    return joined.withColumn("kind", kind).select(*candidates.columns, "kind").unionByName(cleaned.filter("_bad").withColumn("kind", F.lit("invalid")).select(*candidates.columns, "kind"))


def update_plan(existing: DataFrame, incoming: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """key, action (conflict, new, changed, same, removed) and the changed fields.

    Incoming rows of one key with different values are a conflict and nothing else.
    ``values``: column -> name of the change.
    """
    cols = list(values)
    grouped = incoming.groupBy(key).agg(F.count_distinct(F.struct(*cols)).alias("_n"), *(F.min(c).alias(f"_{c}") for c in cols))
    old = existing.groupBy(key).agg(*(F.min(c).alias(f"o_{c}") for c in cols), F.lit(True).alias("_old")).withColumnRenamed(key, "_k")
    joined = grouped.join(old, F.col(key) == F.col("_k"), "full")
    changes = F.array_compact(F.array(*(F.when(F.col("_old") & F.col("_n").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(f"o_{c}")), F.lit(label)) for c, label in values.items())))
    action = F.when(F.col("_n").isNull(), "removed").when(F.col("_n") > 1, "conflict").when(F.col("_old").isNull(), "new").when(F.size(changes) > 0, "changed").otherwise("same")
    return joined.select(F.coalesce(key, "_k").alias(key), action.alias("action"), F.when(action == "changed", F.array_join(changes, ",")).otherwise("").alias("changes"))


def subtract(plan: DataFrame, applied: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to apply, rows already applied)."""
    done = applied.select(F.col(key).alias("_k")).distinct()
    return plan.join(done, F.col(key) == F.col("_k"), "left_anti"), plan.join(done, F.col(key) == F.col("_k"), "left_semi")


def set_difference(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Ids on one side only: id, side. A null is on no other side.

    Both sides are reduced together to a row an id, so nothing is joined or sorted.
    """
    one = lambda rows, key, n: rows.select(F.col(key).alias("id"), F.lit(n).alias("sides"))
    met = one(a, key_a, 1).unionByName(one(b, key_b, 2)).groupBy("id").agg(F.bit_or("sides").alias("sides")).filter("sides < 3 or id is null")
    there = lambda n, side: F.when(F.col("sides").bitwiseAND(n) > 0, F.lit(side))
    return met.select("id", F.explode(F.array_compact(F.array(there(1, "left"), there(2, "right")))).alias("side"))


def disjoint_union(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both sides' rows; the run fails on a new row whose key an old one has."""
    held = old.select(F.col(key).alias("_k")).distinct()
    met = new.join(held, F.col(key) == F.col("_k"), "left")
    checked = F.when(F.col("_k").isNotNull(), F.raise_error(F.concat(F.lit("already there: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return old.unionByName(met.withColumn(key, checked).select(*old.columns))


def drop_ambiguous(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, keys that occur more often with their counts)."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    once = counted.filter("n = 1").select(F.col(key).alias("_k"))
    return rows.join(once, F.col(key) == F.col("_k"), "left_semi"), counted.filter("n > 1")


def first_of_equal(rows: DataFrame, value: list[str], order: str) -> DataFrame:
    """Of equal rows the first in order."""
    return rows.groupBy(*value).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def upsert(old: DataFrame, new: DataFrame, deleted: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows over old ones, one row a key; a deleted key stays deleted. A null key is a key like any other.

    Of several rows of a key on one side the last in ``order`` holds (without an
    order the greatest). The order's column stays as it is; ``origin`` is added.
    """
    p = apart(old, new)
    gone = deleted.select(F.col(key).alias(f"{p}d")).distinct()

    def last(rows: DataFrame) -> DataFrame:
        row = F.struct(*columns_of(rows))
        return rows.groupBy(F.col(key).alias(f"{p}g")).agg((F.max_by(row, order) if order else F.max(row)).alias(f"{p}r")).select(f"{p}r.*")

    before, after = last(old), last(new)
    known = before.select(F.col(key).alias(f"{p}o"), F.lit(True).alias(f"{p}held"))
    fresh = after.join(known, F.col(key).eqNullSafe(F.col(f"{p}o")), "left").withColumn("origin", F.when(F.col(f"{p}held"), "updated").otherwise("inserted")).drop(f"{p}o", f"{p}held")
    kept = before.join(after.select(F.col(key).alias(f"{p}n")), F.col(key).eqNullSafe(F.col(f"{p}n")), "left_anti").withColumn("origin", F.lit("kept"))
    return kept.unionByName(fresh).join(gone, F.col(key).eqNullSafe(F.col(f"{p}d")), "left_anti")


def edit_overrides(base: DataFrame, overrides: DataFrame, edits: DataFrame, key: str, value: str, expected: str | None = None) -> DataFrame:
    """key, value, state of the overrides after edits: kept, set, or removed where an edit says what the base says.

    Edits of unknown keys are left out. With ``expected``, a column of the edits,
    the run fails where the value in force (override, else base) is another one.
    """
    text = base.select(F.col(key).alias("_b"), F.col(value).alias("_base"))
    now = overrides.select(F.col(key).alias("_k"), F.col(value).alias("_over"))
    wanted = edits.select(key, F.col(value).alias("_new"), (F.col(expected) if expected else F.lit(None).cast("string")).alias("_was"), F.lit(True).alias("_edit")).join(text, F.col(key) == F.col("_b")).drop("_b")
    both = now.join(wanted, F.col("_k") == F.col(key), "full")
    force = F.coalesce("_over", "_base")
    stale = F.col("_was").isNotNull() & ~F.col("_was").eqNullSafe(force)
    id_ = F.coalesce(F.col("_k"), F.col(key))
    state = F.when(F.col("_edit").isNull(), "kept").when(stale, F.raise_error(F.concat(F.lit("text changed since it was read: "), id_.cast("string")))).when(F.col("_new").eqNullSafe(F.col("_base")), "removed").otherwise("set")
    return both.select(id_.alias(key), F.when(F.col("_edit").isNull(), F.col("_over")).otherwise(F.col("_new")).alias(value), state.alias("state"))


def fill_only(existing: DataFrame, recovered: DataFrame, key: str, value: str) -> DataFrame:
    """Recovered values where the existing one is blank, never over another."""
    other = recovered.groupBy(key).agg(F.min(value).alias("_v")).withColumnRenamed(key, "_k")
    joined = existing.join(other, F.col(key) == F.col("_k"), "left")
    filled = (F.coalesce(F.col(value), F.lit("")) == "") & F.col("_v").isNotNull()
    return joined.withColumn("recovered", filled).withColumn(value, F.when(filled, F.col("_v")).otherwise(F.col(value))).drop("_k", "_v")


def append_numbered(existing: DataFrame, incoming: DataFrame, key: str, index: str, order: str) -> DataFrame:
    """Incoming rows of unknown keys, numbered on from the existing rows' greatest index."""
    p = apart(existing, incoming)
    fresh = incoming.join(existing.select(F.col(key).alias(f"{p}k")), F.col(key).eqNullSafe(F.col(f"{p}k")), "left_anti")
    top = existing.agg(F.coalesce(F.max(index), F.lit(0)).alias(f"{p}top"))
    return numbered(fresh, order, f"{p}index").join(F.broadcast(top), how="inner").select(*columns_of(incoming), (F.col(f"{p}index") + F.col(f"{p}top")).alias(index))


#: Rows and bytes that one task ranks, the most ranges of an order, and the keys sampled for each.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES, SAMPLED = 1_000_000, 64 << 20, 4096, 32


def _row_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row: its texts as they are, nested values as text, 8 for any other."""

    def size(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        return F.octet_length(column.cast("string")) if nested else F.lit(8)

    sizes = [F.coalesce(size(c, f.dataType), F.lit(0)).cast("long") for c, f in zip(columns_of(rows), rows.schema.fields)]
    return sum(sizes, F.lit(8).cast("long"))


def range_of(value: Column, firsts: Column, parts: Column, step: int) -> Column:
    """The number of bounds at or below a value, found in two steps: among the parts' first bounds, then in one part of ``step`` bounds."""
    at_or_below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= value))
    coarse = at_or_below(firsts)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_or_below(F.get(parts, coarse - 1)))


def ranked(rows: DataFrame, by: list[str], order: list[str], index: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add index 1, 2, ... in each group, nulls last, without sorting a group in one task.

    The order's columns may be of any kind that sorts. The rows are stored once, each
    with a number of its own as the last part of its key, so even rows that are
    alike are told apart. Ranks are counted within ranges of about ``range_rows``
    rows, or RANGE_BYTES if that is less, between sampled keys, and the sizes of a
    group's earlier ranges added.
    """
    p = apart(rows)
    held = stored(rows.withColumn(f"{p}row", F.monotonically_increasing_id()), "ranked")
    key = F.struct(*(x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))), F.col(f"{p}row").alias("row"))
    keyed = held.withColumn(f"{p}key", key)
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(held)), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(n // range_rows, size // RANGE_BYTES) + 1, max(n, 1))
    sample = keyed.select(f"{p}key").sample(min(1.0, SAMPLED * ranges / n), seed=1).orderBy(f"{p}key").collect() if ranges > 1 else []
    bounds = [sample[k * len(sample) // ranges][0] for k in range(1, ranges)] if len(sample) >= ranges else []
    place = lambda *groups: F.row_number().over(Window.partitionBy(*groups).orderBy(f"{p}key")).cast("long")
    if not bounds:  # all rows are one task's
        return keyed.withColumn(index, place(*by)).select(*columns_of(rows), F.col(index))
    step = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    kind = keyed.schema[f"{p}key"].dataType
    table = rows.sparkSession.createDataFrame([([b[0] for b in parts], parts)], T.StructType([T.StructField(f"{p}firsts", T.ArrayType(kind)), T.StructField(f"{p}parts", T.ArrayType(T.ArrayType(kind)))]))
    dealt = keyed.join(F.broadcast(table), how="inner").withColumn(f"{p}range", range_of(F.col(f"{p}key"), F.col(f"{p}firsts"), F.col(f"{p}parts"), step)).drop(f"{p}firsts", f"{p}parts")
    spread = dealt.repartition(ranges, f"{p}range")  # as many tasks as ranges, however few the session's shuffles have
    sizes = dealt.groupBy(*(F.col(c).alias(f"{p}by{k}") for k, c in enumerate(by)), F.col(f"{p}range").alias(f"{p}of")).agg(F.count("*").alias(f"{p}n"))  # at most MOST_RANGES rows a group
    earlier = Window.partitionBy(*(f"{p}by{k}" for k in range(len(by)))).orderBy(f"{p}of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn(f"{p}before", F.coalesce(F.sum(f"{p}n").over(earlier), F.lit(0))).drop(f"{p}n")
    met = F.col(f"{p}range") == F.col(f"{p}of")
    for k, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"{p}by{k}"))
    inner = spread.withColumn(f"{p}index", place(*by, f"{p}range"))
    return inner.join(before if by else F.broadcast(before), met).select(*columns_of(rows), (F.col(f"{p}index") + F.col(f"{p}before")).cast("long").alias(index))


def numbered(rows: DataFrame, order: str, index: str) -> DataFrame:
    """Add index 1, 2, ... in the order of a column, nulls last."""
    return ranked(rows, [], [order], index)


def freshness(inputs: DataFrame, receipts: DataFrame, key: str, fingerprint: str, state: str = "state", output: str | None = None, recorded: str | None = None) -> DataFrame:
    """Add state: unverified without a receipt, stale where its inputs are others or its output is not the recorded one, else pending, failed or current as it says.

    ``output``, a column of the inputs, is the hash of what is there now, ``recorded``
    that of the receipts.
    """
    held = receipts.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_f"), F.lower(state).alias("_s"), (F.col(recorded) if recorded else F.lit(None).cast("string")).alias("_o"))
    changed = ~F.col("_o").eqNullSafe(F.col(output)) if output else F.lit(False)
    known = F.col("_s").isin("pending", "failed", "current")
    said = F.when(F.col("_k").isNull() | ~F.coalesce(known, F.lit(False)), "unverified").when(~F.col("_f").eqNullSafe(F.col(fingerprint)), "stale").when((F.col("_s") == "current") & changed, "stale").otherwise(F.col("_s"))
    return inputs.join(held, F.col(key) == F.col("_k"), "left").withColumn("state", said).drop("_k", "_f", "_s", "_o")


def violations(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """A row for each failed check of a row: code added."""
    return rows.withColumn("code", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in checks)))))
