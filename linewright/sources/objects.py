"""A reader that splits huge JSON objects, one line or not, by byte ranges.

From the middle of a file nobody knows whether a quote opens or closes a string.
So each range is first summed up for both cases: does it end inside a string, how
much deeper does it end, and how many members begin at each relative depth. Those
few numbers, put together range after range, give every range its true state and
the ordinal of its first member. Then the ranges are read side by side, each from
its first member to the end of its last one. A member is a key and its value's
text, so a filter on keys comes before any value is parsed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
#: Bytes read on at a time to the end of a range's last member.
MORE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

_QUOTE, _SLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]
_STEP = np.zeros(256, dtype=np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_TELLS = _STEP != 0
_TELLS[[_QUOTE, _SLASH, _COMMA]] = True


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def _telling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bytes) of unescaped quotes, brackets and commas. ``data`` must not begin after an odd run of backslashes."""
    at = np.flatnonzero(_TELLS[data])
    kind = data[at]
    slash = kind == _SLASH
    if slash.any():
        # in a run of backslashes every second one is itself escaped; what follows an odd run is
        where = at[slash]
        first = np.ones(len(where), dtype=bool)
        first[1:] = where[1:] != where[:-1] + 1
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
        escaped = where[(np.arange(len(where)) - run_start) % 2 == 0] + 1
        kept = ~slash & ~np.isin(at, escaped, assume_unique=True)
        at, kind = at[kept], kind[kept]
    return at, kind


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places, bytes, depth after each, whether it ends in a string) of what stands outside strings."""
    at, kind = _telling(data)
    quote = kind == _QUOTE
    within = (np.cumsum(quote) + inside) % 2 == 1
    ends_inside = bool(within[-1]) if len(within) else inside
    plain = ~quote & ~within
    at, kind = at[plain], kind[plain]
    return at, kind, np.cumsum(_STEP[kind], dtype=np.int64), ends_inside


def _range(source, start: int, end: int) -> tuple[np.ndarray, int]:
    """Bytes from start to end, or from before a run of backslashes that stands before start, and where they begin."""
    back = 0
    while True:
        source.seek(start - back)
        data = source.read(end - start + back)
        before = data[:back]
        if back == 0 and start:
            back = min(start, 64)
            continue
        run = len(before) - len(before.rstrip(b"\\"))
        if run == back and back < start:
            back = min(start, back * 16)
            continue
        return np.frombuffer(data, dtype=np.uint8)[back - run :], start - run


def _summary(data: np.ndarray, skip: int, inside: bool) -> tuple[bool, int, list[tuple[int, int]]]:
    """(ends in a string, change of depth, [(relative depth, members begun there)])."""
    at, kind, depth, ends = _outside(data, inside)
    at, kind, depth = at[at >= skip], kind[at >= skip], depth[at >= skip]
    begins = depth[(kind == _COMMA) | (_STEP[kind] > 0)]
    levels, n = np.unique(begins, return_counts=True)
    return ends, int(depth[-1]) if len(depth) else 0, list(zip(levels.tolist(), n.tolist()))


def _members(source, size: int, start: int, end: int, inside: bool, depth: int) -> Iterator[tuple[str, str]]:
    """(key, value's text) of the members that begin between start and end at depth 1."""
    to = end
    while True:
        data, base = _range(source, start, to)
        at, kind, after, _ = _outside(data, inside)
        after = after + depth
        begin = ((kind == _COMMA) | (_STEP[kind] > 0)) & (after == 1)
        close = (_STEP[kind] < 0) & (after == 0)
        edges, opens = at[begin | close], begin[begin | close]
        owned = np.flatnonzero(opens & (edges >= start - base) & (edges < end - base))
        if len(owned) and owned[-1] + 1 == len(edges) and to < size:
            to = min(size, to + max(MORE_BYTES, to - end))  # the last member goes on
            continue
        break
    whole = data.tobytes()
    for k in owned.tolist():
        if k + 1 == len(edges):
            raise ValueError("the JSON object is cut short")
        text = whole[edges[k] + 1 : edges[k + 1]].decode("utf-8").strip()
        if not text:
            continue  # an empty object
        if text[0] != '"':
            raise ValueError("the file holds no JSON object")
        key, at_end = scanstring(text, 1)
        colon = text.find(":", at_end)
        if colon < 0:
            raise ValueError("a member without a value")
        yield key, text[colon + 1 :].strip()


def read_members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, ordinal, key, value) of the members of the JSON objects in files; the ordinal counts a file's members.

    Values are their JSON texts. A file may hold several objects one after another.
    Repeated keys are members each; an empty file has none.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    cuts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = cuts.select("path", "length", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, length, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path_) as source:
                    data, base = _range(source, start, end)
                told = [_summary(data, start - base, inside) for inside in (False, True)]
                yield pa.RecordBatch.from_pylist([{"path": path_, "length": length, "start": start, "end": end, "told": json.dumps(told)}])

    n = max(1, ranges.count())
    told = ranges.repartition(n, "path", "start").mapInArrow(sum_up, "path string, length long, start long, end long, told string")
    states, held = [], {}
    for r in sorted(told.collect(), key=lambda r: (r.path, r.start)):  # a row for each range_bytes of the files
        inside, depth, ordinal = held.get(r.path, (False, 0, 0))
        states.append((r.path, r.length, r.start, r.end, inside, depth, ordinal))
        ends, change, begun = json.loads(r.told)[inside]
        # an object's opening counts as a member here; those of empty objects leave gaps
        held[r.path] = (ends, depth + change, ordinal + sum(m for level, m in begun if level + depth == 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "key", "value"]
        for batch in batches:
            for path_, length, start, end, inside, depth, ordinal in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                with _open(path_) as source:
                    for k, (key, value) in enumerate(_members(source, length, start, end, inside, depth)):
                        rows.append((path_, ordinal + k, key, value))
                        size += len(value)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    known = spark.createDataFrame(states, "path string, length long, start long, end long, inside boolean, depth long, ordinal long")
    return known.repartition(n, "path", "start").mapInArrow(read, "path string, ordinal long, key string, value string")
