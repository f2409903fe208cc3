"""Token ids and token counts of whole texts with a byte-level BPE vocabulary.

Texts are cut before single spaces into chunks whose encodings do not depend on
their surroundings, so a worker remembers the encodings of chunks it has seen.
A text where a space stands between two white-space characters or ends a run of them, or that holds a
special string, is not cut. The memory is emptied when it holds CACHE_ENTRIES.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000
#: Bytes of ids in a batch that goes back to the JVM.
BATCH_BYTES = 4 << 20
#: Longer chunks are encoded each time: they rarely come back.
CACHE_CHARS = 64

_uncuttable = re.compile(r"\s \s|\s \Z").search


def cut(text: str) -> list[str]:
    """Chunks, each but the first with its leading space taken off."""
    return text.split(" ")


class Remembered(dict):
    """chunk -> value, filled by ``make`` on first use."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = value
        return value


class IdEncoder:
    """Little-endian unsigned 32-bit ids of a text, as bytes.

    With ``ranks``, a file of the same vocabulary as ranks, and its ``pattern``,
    chunks are encoded by the faster library; texts that cannot be cut into
    chunks always go to the library of ``path``.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.whole = lambda text: array("I", ids(text)).tobytes()
        part = ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            part = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held, special_tokens={}).encode_ordinary
        self.inner = Remembered(lambda chunk: array("I", part(" " + chunk)).tobytes())

    def __call__(self, text: str) -> bytes:
        if _uncuttable(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = cut(text)
        return self.whole(first) + b"".join(map(self.inner.__getitem__, rest))


@functools.cache
def id_encoder(path: str, ranks: str | None, pattern: str | None) -> IdEncoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return IdEncoder(path, ranks, pattern)


def byte_symbols() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Number of tokens of a text: symbols at the start less the merges made."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = regex.compile(pattern)
        self.symbols = byte_symbols()
        self.pieces = Remembered(self.piece)
        self.inner = Remembered(lambda chunk: self.plain(" " + chunk))

    def piece(self, word: str) -> int:
        """Heap of adjacent pairs over a doubly linked list of symbols.

        The lowest rank, then the leftmost pair, is popped; a pair whose symbols
        have changed since it was pushed is skipped.
        """
        part = [self.symbols[b] for b in word.encode()]
        n = count = len(part)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return count

    def plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.words.findall(text)))

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.at_special.split(text)
            return len(parts) - 1 + sum(self.plain(p) for p in parts)
        if _uncuttable(text):
            return self.plain(text)
        first, *rest = cut(text)
        return self.plain(first) + sum(map(self.inner.__getitem__, rest))


@functools.cache
def merge_counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. Null texts count as empty.

    An empty text has no tokens. Repeated rows, ties and null ids give one row
    each, an empty table none; other columns are ignored, so their names cannot
    clash. A text of any length is counted whole, in memory in proportion to its
    longest word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary, pattern)
        for batch in batches:
            texts = texts_of(batch, "text")
            tokens = np.fromiter(map(counter, texts), dtype=np.int64, count=len(texts))
            size = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, with_ids: bool = False, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each text's ids, closed by ``end_id``, into pieces of at most ``size``.

    Only the first piece may be shorter. Columns: id, piece, start, length,
    ids_crc32, and the ids themselves as little-endian bytes if asked for.
    """

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(vocabulary, ranks, pattern)
        closing = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            found: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                row, *columns = zip(*found) if found else [()] * len(names)
                found.clear()
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names)

            for k, text in enumerate(batch.column("text")):
                stream = encode(text.as_py() or "") + closing
                n, at, p = len(stream) // 4, 0, 0
                step = (n - 1) % size + 1
                while at < n:
                    part = stream[4 * at : 4 * (at + step)]
                    found.append((k, p, at, step, zlib.crc32(part)) + (part,) * with_ids)
                    at, p, step = at + step, p + 1, size
                held += len(stream)
                if held >= BATCH_BYTES:
                    yield flush()
                    held = 0
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)
