"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits agree on one whole segment
(pigeonhole) and differ in at most two bits on each other one. Every segment,
padded to 23 bits, decodes in the perfect (23, 12) Golay code to one codeword
within three bits; taking the codewords of all words one bit away too gives one
or six indices, and words two bits apart share an index, that of a word between
them. A key is a whole segment with an index of the next one. Fingerprints with
a common key are joined and verified.

Keys that more than ``SMALL_BUCKET`` different fingerprints share are not joined
among themselves; their fingerprints meet, exactly, at the words between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import apart, columns_of, settle, small_side

SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101
SMALL_BUCKET = 64
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """Bits set in over half the XXH64 (seed 42) hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        shingles = map(b" ".join, zip(*(parts[at + k : end + k] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64, count=end - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the text) and fp (the fingerprint as a signed long). Texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fps = np.fromiter((fingerprint(t or "", words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(fps.view(np.int64))], ["id", "h", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, fp long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Index (the 12 leading bits) of the codeword nearest to each 23-bit word."""

    def __init__(self):
        # the remainder is linear: tables for the upper 12 and the lower 11 bits
        self.upper = np.array([_remainder(x << 11) for x in range(1 << 12)], dtype=np.int64)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        for a in range(24):
            for b in range(a, 24):
                for c in range(b, 24):
                    error = 0
                    for bit in {a, b, c} - {23}:
                        error |= 1 << bit
                    self.error[_remainder(error)] = error

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.upper[words >> 11] ^ (words & 0x7FF)]) >> 11

    def indices(self, words: np.ndarray, bits: int) -> np.ndarray:
        """One row for each word: sorted, with -1 where an index repeats."""
        near = [self.index(words)] + [self.index(words ^ (1 << b)) for b in range(bits)]
        found = np.sort(np.stack(near, axis=1), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp) for each distinct fingerprint of the column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(every), BLOCK):
                fps = every[at : at + BLOCK]
                parts = [(fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1) for shift, bits in SEGMENTS]
                keys, owners = [], []
                for k, part in enumerate(parts):
                    nxt = (k + 1) % len(parts)
                    index = golay.indices(parts[nxt], SEGMENTS[nxt][1])
                    row, _ = held = np.nonzero(index >= 0)
                    keys.append((k << 34) | (part[row] << 12) | index[held])
                    owners.append(fps[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links (a < b) between distinct fingerprints that join up every pair within two bits."""
    keys = settle(golay_keys(nodes), "golay")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settle(keys.join(sizes, "key"), "golay-shared")
    small = shared.filter(F.col("n") <= small_bucket)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    near = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    hot = shared.filter(F.col("n") > small_bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)))
    between = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    # at most 65 fingerprints are within a bit of a word, so these groups are small
    star = between.select("fp", F.min("fp").over(Window.partitionBy("middle")).alias("low")).filter("low < fp").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for nodes that have links.

    Alternating large-star and small-star rounds to the fixed point, which they
    reach in a number of rounds that grows with the logarithm of the links; each
    result is a table in the shared folder, and only a count and a checksum reach
    the driver.
    """
    edges, seen, now = settle(edges.select("a", "b"), "edges"), None, ()
    while now != seen:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        # each link now runs from the smaller a to b: small-star looks at b's smaller neighbours
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        small = large.join(low, F.col("b") == F.col("u"))
        small = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        edges = settle(small, "edges")
        seen, now = now, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def roots_of(fps: DataFrame) -> DataFrame:
    """(node, root) of every distinct fingerprint of the column fp; a lone one is its own root."""
    nodes = settle(fps.select("fp").distinct(), "nodes")
    return nodes.join(components(links(nodes)), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (least id reachable).

    Fingerprints within two bits link. Null and wordless texts have fingerprint 0
    and link like any other. Repeated rows stay; a null id gets its component's
    least id, null if none has one. An empty table gives an empty result. Columns
    but the id and the text are not read; very long texts are hashed in blocks.
    """
    fps = settle(fingerprints(docs, words, id_col, text_col), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    labelled = settle(roots_of(fps).join(first, F.col("node") == F.col("fp")).select("node", "root", "first"), "roots")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = labelled.join(least, F.col("root") == F.col("r")).select("node", "component_id")
    return fps.join(named, F.col("fp") == F.col("node")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts, columns unchanged, whatever they are called.

    It is the row of the least id, a null one after all others, then of the least
    hash of its text, then of the least of its columns as JSON: of rows equal in
    all columns any one, which is the same. Rows of one id with other texts are
    other documents. An empty table stays empty. Only the keys of rows that go are
    joined with the documents; texts are not shuffled while those keys can be
    broadcast.
    """
    p = apart(docs)
    fps = settle(fingerprints(docs, words, id_col, text_col), "fingerprints")
    # a document is an id with a text; whole copies of one are counted
    keys = fps.groupBy("id", "h", "fp").agg(F.count("*").alias("n"))
    keys = settle(keys.join(roots_of(fps), F.col("fp") == F.col("node")).select("id", "h", "n", "root"), "keys")
    # only groups of several documents have one to choose; they are few beside the documents
    best = keys.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"), F.count("*").alias("k")).filter("k > 1")
    judged = keys.join(small_side(settle(best.drop("k"), "best")), F.col("root") == F.col("r"), "left")
    judged = judged.withColumn("stays", F.col("best").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))))
    # the other documents, and those that stay once of several rows
    marks = settle(judged.filter("n > 1 or not stays").select(F.col("id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.col("stays").alias(f"{p}stays")), "marks")
    hashed = docs.withColumn(f"{p}own", F.xxhash64(text_col))
    met = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}own") == F.col(f"{p}h"))
    single = hashed.join(small_side(marks), met, "left_anti").select(*columns_of(docs))
    whole = F.struct(*columns_of(docs))
    once = hashed.join(small_side(marks.filter(f"{p}stays")), met, "left_semi").groupBy(id_col, f"{p}own").agg(F.min_by(whole, F.to_json(whole)).alias(f"{p}row"))
    return single.unionByName(once.select(f"{p}row.*").select(*columns_of(docs)))
