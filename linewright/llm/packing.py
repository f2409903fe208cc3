"""Best-fit packing: a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program
(fewest sequences that cover every length's count) is solved by multiplicative
weights: a length's weight falls exponentially with the share of its demand met
so far, and a knapsack dynamic program prices the configuration of largest
weight. The solution is rounded down, the rest is solved again, and a last small
rest is filled sequence by sequence with the same knapsack. Only the histogram
(at most one row for each length up to the capacity) reaches the driver; pieces
are then placed by their rank within their length, in parallel.

While more than ``last_rest`` pieces are left the program is solved again for
them; the last ones are filled one sequence at a time. Both hold every piece.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import BROADCAST_BYTES, apart, columns_of, settle, small_side

#: Pieces of one length ranked by one task; a length of more is dealt over more tasks.
RANK_ROWS = 100_000


def knapsack(values: np.ndarray, capacity: int, most: np.ndarray) -> dict[int, int]:
    """Lengths (index + 1) of the largest total value that fit, at most ``most`` of each.

    Copies of a length are split into powers of two, so each subset of the lots
    is a number of copies and each lot is taken once or not at all.
    """
    lots = []
    for length in (np.flatnonzero((values > 0) & (most > 0)) + 1)[::-1]:
        left, lot = min(int(most[length - 1]), capacity // int(length)), 1
        while left > 0:
            lot = min(lot, left)
            lots.append((int(length), lot))
            left, lot = left - lot, lot * 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(lots), capacity + 1), dtype=bool)
    for k, (length, lot) in enumerate(lots):
        size = length * lot
        with_lot = best[:-size] + values[length - 1] * lot
        np.greater(with_lot, best[size:] + 1e-12, out=taken[k, size:])
        np.maximum(best[size:], with_lot, out=best[size:])
    config: dict[int, int] = {}
    room = capacity
    for k in range(len(lots) - 1, -1, -1):
        if taken[k, room]:
            length, lot = lots[k]
            config[length] = config.get(length, 0) + lot
            room -= length * lot
    return config


def weigh(demand: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """Fractional configurations by multiplicative weights."""
    lengths = np.arange(1, capacity + 1)
    wanted = demand > 0
    share = np.zeros(capacity)
    total = max(1.0, float((demand * lengths).sum()) / capacity)
    rate = math.log(max(2, int(wanted.sum()))) * 2
    mass: dict[tuple, float] = {}
    left = total * 1.02
    for _ in range(rounds):
        if left <= 0:
            break
        # weight of a unit of a length: its size, raised while its demand is unmet
        values = np.where(wanted & (share < 1), lengths * (1 + lengths / capacity / 8) * np.exp(-rate * share), 0.0)
        config = knapsack(values, capacity, demand)
        if not config:
            break
        step = min(total / rounds * 4, left, *((1 - share[k - 1]) * demand[k - 1] / n for k, n in config.items()))
        step = max(step, min(1.0, left))
        key = tuple(sorted(config.items(), reverse=True))
        mass[key] = mass.get(key, 0.0) + step
        left -= step
        for k, n in config.items():
            share[k - 1] += step * n / demand[k - 1]
    return mass


def plan(histogram: dict[int, int], capacity: int, rounds: int = 120, last_rest: int = 800) -> list[tuple[tuple, int]]:
    """[(configuration, times)] that hold exactly the histogram's pieces."""
    rest = np.zeros(capacity, dtype=np.int64)
    for length, n in histogram.items():
        rest[length - 1] = n
    found: list[tuple[tuple, int]] = []

    def take(config, times: int) -> int:
        config = [(k, n) for k, n in config if n]
        times = min(times, *(int(rest[k - 1]) // n for k, n in config)) if config else 0
        if times > 0:
            found.append((tuple(config), times))
            for k, n in config:
                rest[k - 1] -= n * times
        return times

    take([(capacity, 1)], int(rest[capacity - 1]))
    waste = 1
    while rest.sum() > last_rest:
        # a rounded configuration counts only if it is nearly full; what is left is solved anew
        before = int(rest.sum())
        mass = weigh(rest, capacity, rounds)
        for config, x in sorted(mass.items(), key=lambda z: (-sum(k * n for k, n in z[0]), -z[1], z[0])):
            if capacity - sum(k * n for k, n in config) <= waste:
                take(config, math.floor(x))
        if before - rest.sum() < before / 8:
            if waste > capacity:
                break
            waste *= 4
    sizes = np.arange(1, capacity + 1, dtype=float)
    while rest.any():
        # the largest piece opens a sequence; the knapsack fills what is left, larger pieces first
        top = int(np.flatnonzero(rest)[-1]) + 1
        open_rest = rest.copy()
        open_rest[top - 1] -= 1
        room = capacity - top
        config = knapsack(np.where(open_rest > 0, sizes + sizes**2 / capacity / 1e3, 0.0)[:room], room, open_rest[:room]) if room else {}
        config[top] = config.get(top, 0) + 1
        take(sorted(config.items(), reverse=True), 1)
    return found


def slots(found: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times in a sequence, first sequence, offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for config, times in found:
        offset = 0
        for length, n in config:
            first = used.get(length, 0)
            out.append((length, first, first + n * times, n, sequence, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a table that is cheap to read twice. Every row is placed;
    equal rows are placed apart; an empty table stays empty. A piece of the full
    capacity is a sequence of its own and needs no rank. Other columns are kept,
    whatever they are called.
    """
    spark, p = pieces.sparkSession, apart(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    part = {k: n for k, n in histogram.items() if k < capacity}
    planned = slots(plan(part, capacity))
    names = [p + x for x in ("length", "first", "end", "times", "sequence", "offset")]
    table = spark.createDataFrame(planned, ", ".join(f"`{n}` long" for n in names))
    buckets = spark.createDataFrame([(k, n // RANK_ROWS + 1) for k, n in part.items()], f"`{p}l` long, `{p}k` long")
    short = pieces.filter(F.col("length") < capacity)
    # the one broadcast of capacity rows at most
    dealt = short.join(F.broadcast(buckets), F.col("length") == F.col(f"{p}l")).withColumn(f"{p}bucket", F.pmod(F.xxhash64(*keys), F.col(f"{p}k"))).drop(f"{p}l", f"{p}k")
    sizes = dealt.groupBy(F.col("length").alias(f"{p}l"), F.col(f"{p}bucket").alias(f"{p}b")).agg(F.count("*").alias(f"{p}n"))
    before = F.coalesce(F.sum(f"{p}n").over(Window.partitionBy(f"{p}l").orderBy(f"{p}b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = settle(sizes.select(f"{p}l", f"{p}b", before.alias(f"{p}before")), "before")
    order = [F.col(c) for c in (*keys, "start", "ids_crc32") if c in pieces.columns]
    ranked = dealt.withColumn(f"{p}rank", F.row_number().over(Window.partitionBy("length", f"{p}bucket").orderBy(*order)) - 1)
    placed = ranked.join(small_side(before), (F.col("length") == F.col(f"{p}l")) & (F.col(f"{p}bucket") == F.col(f"{p}b"))).withColumn(f"{p}rank", F.col(f"{p}rank") + F.col(f"{p}before"))
    placed = placed.join(F.broadcast(table) if len(planned) * 48 <= BROADCAST_BYTES else table, (F.col("length") == F.col(names[0])) & (F.col(f"{p}rank") >= F.col(names[1])) & (F.col(f"{p}rank") < F.col(names[2])))
    at, times, sequence, offset = F.col(f"{p}rank") - F.col(names[1]), F.col(names[3]), F.col(names[4]), F.col(names[5])
    out = placed.select(*columns_of(pieces), (sequence + F.floor(at / times)).cast("long").alias("sequence_id"), (offset + at % times * F.col("length")).cast("long").alias("offset"))
    full = pieces.filter(F.col("length") == capacity)
    return out.unionByName(full.select(*columns_of(pieces), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, ranks: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: a row a piece, with its ids as little-endian bytes if asked for.

    Null texts count as empty: one closing id. Repeated rows are packed each; an
    empty table stays empty. Columns but doc_id and text are not read; a very long
    text becomes many pieces. Full pieces have negative sequence numbers.
    """
    from linewright.llm.bpe import token_pieces

    return pack(settle(token_pieces(docs, vocabulary, capacity, end_id, with_ids, ranks=ranks, pattern=pattern), "pieces"), capacity)
