"""Interpolated modified Kneser-Ney trigram model, counted in Spark.

Words are named by 64-bit hashes. A first pass counts them; each range of hashes
becomes a file of sorted hashes with running counts in the shared folder, and a
word's place among all hashes is its number. A second pass counts the triples of
each block of texts, as sorted arrays of those numbers, and deals them out by the
middle word. A bucket then holds whole contexts (left, middle, .) and whole
followers (., middle, right), so the counts of both orders come from one shuffle;
a middle word that fills more than a bucket is dealt out further by its left word
and the numbers of its left words are added up in a small second shuffle. Buckets
become files of sorted arrays; scoring tasks map them into memory, a bounded
number at a time, and look up sorted, distinct keys.

Each text starts with two start marks and ends with an end mark, which counts as a
token. Counting is exact: numbers, not hashes, are compared.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import WordHashes, new_path, settle

#: Tokens counted or scored at a time; tokens of a bucket of triples; bytes of text a range of words; the most ranges.
COUNT_BLOCK, SCORE_BLOCK, BUCKET_TOKENS, RANGE_BYTES, MOST_RANGE_BITS = 2_000_000, 500_000, 4_000_000, 64 << 20, 10
#: Files mapped at a time by a scoring task. Contexts of more followers have their sums stored.
MOST_MAPS, LONG_RUN = 512, 8
SMALLEST = 0.1


def _ends() -> tuple[int, int]:
    """Hashes of the start and the end; no word holds a space."""
    return WordHashes()[b" start"], WordHashes()[b" end"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def token_hashes(text: str | None, hashes: WordHashes, end: int) -> np.ndarray:
    words = words_of(text)
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    out[-1] = end
    return out


def triples(tokens: np.ndarray, starts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, middle, right) of every token of the texts laid end to end; texts begin at ``starts``."""
    middle, left = np.empty_like(tokens), np.empty_like(tokens)
    middle[1:], left[2:] = tokens[:-1], tokens[:-2]
    middle[starts] = start
    left[starts] = start
    second = starts + 1
    left[second[second < len(tokens)]] = start
    return left, middle, tokens


def runs(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted keys change, the first included."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def lengths_of(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def ordered(first: np.ndarray, second: np.ndarray, third: np.ndarray | None = None) -> np.ndarray:
    """Order by up to three number columns; two of 32 bits are sorted as one."""
    if first.dtype != np.uint32:
        return np.lexsort((second, first) if third is None else (third, second, first))
    pair = (first.astype(np.uint64) << np.uint64(32)) | second
    order = np.argsort(pair)
    if third is None:
        return order
    # equal pairs stand together now: their place and the third column make the second key
    place = np.zeros(len(pair), dtype=np.uint64)
    place[runs(pair[order])[1:]] = 1
    return order[np.argsort((np.cumsum(place, dtype=np.uint64) << np.uint64(32)) | third[order])]


def counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(left, middle, right, times) of each distinct triple by middle, left, right; the words are numbered below ``size``."""
    bits = np.uint64(max(1, int(size - 1).bit_length()))
    if 3 * bits <= 64:
        key = np.sort((((v.astype(np.uint64) << bits) | u.astype(np.uint64)) << bits) | w.astype(np.uint64))
        first = runs(key)
        times, key, low = lengths_of(first, len(key)), key[first], np.uint64((1 << int(bits)) - 1)
        return ((key >> bits) & low).astype(np.int64), (key >> (bits + bits)).astype(np.int64), (key & low).astype(np.int64), times
    order = np.lexsort((w, u, v))
    u, v, w = u[order], v[order], w[order]
    first = runs(v, u, w)
    return u[first], v[first], w[first], lengths_of(first, len(w))


def by_number(small_numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers that are mostly small: two bytes are sorted by counting."""
    if len(small_numbers) and int(small_numbers.max()) < 1 << 16:
        return np.argsort(small_numbers.astype(np.uint16), kind="stable")
    return np.argsort(small_numbers, kind="stable")


def small(a: np.ndarray) -> np.ndarray:
    """The array in the least unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: the leading bytes of numbers are much alike."""
    codec, out = pa.Codec("zstd", 1), []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        body = codec.compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<BQQ", a.itemsize, len(a), len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd", 1), [], 0
    while at < len(blob):
        width, n, size = struct.unpack_from("<BQQ", blob, at)
        at += struct.calcsize("<BQQ")
        planes = codec.decompress(blob[at : at + size], decompressed_size=n * width, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += size
    return out


class Folder:
    """Files of named arrays in the shared folder; each is written under another name and then moved, so a repeated task does no harm."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self.open: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()

    def put(self, name: str, **arrays: np.ndarray) -> None:
        self.fs.create_dir(self.root, recursive=True)
        head, at = {}, 0
        for k, a in arrays.items():
            head[k] = (a.dtype.str, at, len(a))
            at += -(-a.nbytes // 8) * 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        draft = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(struct.pack("<Q", len(text)) + text)
            for a in arrays.values():
                out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        self.fs.move(draft, f"{self.root}/{name}")

    def _map(self, name: str) -> np.ndarray:
        path = f"{self.root}/{name}"
        if self.local:
            return np.memmap(path, dtype=np.uint8, mode="r")
        copy = tempfile.TemporaryFile()  # an unnamed copy on the worker's disk, gone with its mapping
        with self.fs.open_input_stream(path) as source:
            while part := source.read(1 << 24):
                copy.write(part)
        copy.flush()
        return np.memmap(copy, dtype=np.uint8, mode="r")

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        """The file's arrays, mapped; None if there is no such file. Those used longest ago are let go."""
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        try:
            held = np.asarray(self._map(name))  # a plain view: it keeps the mapping
        except FileNotFoundError:
            self.open[name] = None
        else:
            size = struct.unpack_from("<Q", held, 0)[0]
            head, base = json.loads(bytes(held[8 : 8 + size])), 8 + size
            self.open[name] = {k: held[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in head.items()}
        while len(self.open) > MOST_MAPS:
            self.open.popitem(last=False)
        return self.open[name]


def range_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def edges_of(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; plain halves where the counts don't give any."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


@dataclass
class Words:
    """Where the words' files are, and for each range the numbers of words and tokens before it."""

    uri: str
    bits: int
    before: list[tuple[int, int]]
    tokens: int
    words: int
    #: Tokens of a bucket of triples; a word of more is dealt out over several.
    room: int

    @property
    def kind(self) -> str:
        return "<u4" if self.before[-1][0] < 2**32 - 1 else "<u8"


@dataclass
class Model:
    words: Words
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_types: int
    word_rest: float


class Vocabulary:
    """Looks words up in the mapped files."""

    def __init__(self, words: Words):
        self.w, self.folder = words, Folder(words.uri)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, tokens of all words before) of sorted hashes."""
        number, count, before = (np.full(len(hashes), fill, dtype=np.int64) for fill in (-1, 0, 0))
        edge = edges_of(range_of(hashes, self.w.bits), 1 << self.w.bits)
        for r in np.flatnonzero(np.diff(edge)):
            held = self.folder.get(f"word-{r}")
            if held is None or not len(held["hash"]):
                continue
            wanted = hashes[edge[r] : edge[r + 1]]
            at = np.minimum(np.searchsorted(held["hash"], wanted), len(held["hash"]) - 1)
            place = np.flatnonzero(held["hash"][at] == wanted)
            at = at[place]
            place += edge[r]
            words, tokens = self.w.before[r]
            number[place] = at + words
            upto = held["upto"]
            count[place] = upto[at + 1] - upto[at]
            before[place] = upto[at] + tokens
        return number, count, before

    def stats(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of (left neighbours' types, followers' sum, of 1, 2, and more) of sorted numbers; -1 gives zeros."""
        out = np.zeros((len(numbers), 5), dtype=np.int64)
        firsts = np.array([w for w, _ in self.w.before])
        edge = np.searchsorted(numbers, firsts)
        for r in range(len(firsts) - 1):
            held = self.folder.get(f"stats-{r}") if edge[r] < edge[r + 1] else None
            if held is not None:
                out[edge[r] : edge[r + 1]] = held["stats"].reshape(-1, 5)[numbers[edge[r] : edge[r + 1]] - firsts[r]]
        return out


def part_of(number: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each word, evenly spread."""
    mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53


def bucket_of(count: np.ndarray, before: np.ndarray, other: np.ndarray, room: int) -> np.ndarray:
    """Bucket of a word beside another: by the tokens before it, and within a word of more tokens than a bucket by the other."""
    extra = np.where(count > room, count * part_of(other), 0.0)
    return ((before + extra) // room).astype(np.int64)


def count_words(train: DataFrame, uri: str) -> Words:
    """Count the words of the column text and write their files."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_RANGE_BITS, int(size // RANGE_BYTES).bit_length())
    start, end = _ends()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, texts = WordHashes(), Counter(), 0

        def flush() -> pa.RecordBatch:
            key = np.fromiter([*map(hashes.__getitem__, held), start, end], dtype=np.uint64, count=len(held) + 2)
            n = np.fromiter([*held.values(), texts, texts], dtype=np.int64, count=len(held) + 2)
            held.clear()
            order = np.argsort(key)
            key, n = key[order], n[order]
            edge = edges_of(range_of(key, bits), 1 << bits)
            used = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed(key[edge[r] : edge[r + 1]], small(n[edge[r] : edge[r + 1]])) for r in used], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                texts += 1
                if len(held) >= COUNT_BLOCK // 4:
                    yield flush()
                    texts = 0
        if texts:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("bucket")[0].as_py()
        parts = [unpacked(b) for b in table.column("blob").to_pylist()]
        key, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        first = runs(key)
        key, n = key[first], np.add.reduceat(n, first)
        Folder(uri).put(f"word-{r}", hash=key, upto=np.concatenate([[0], np.cumsum(n)]))
        return pa.table({"bucket": pa.array([r], pa.int32()), "words": pa.array([len(key)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "starts": pa.array([int(n[key == np.uint64(start)].sum())], pa.int64())})

    rows = train.mapInArrow(count, "bucket int, blob binary").groupBy("bucket").applyInArrow(merge, "bucket int, words long, tokens long, starts long").collect()  # a row a range
    by_range = {r["bucket"]: r for r in rows}
    before, starts = [(0, 0)], sum(r["starts"] for r in rows)
    for r in range(1 << bits):
        row = by_range.get(r)
        before.append((before[-1][0] + (row["words"] if row else 0), before[-1][1] + (row["tokens"] if row else 0)))
    # the start has a number and room in the buckets, but is no token
    return Words(uri, bits, before, before[-1][1] - starts, before[-1][0] - (starts > 0), BUCKET_TOKENS)


def learn(train: DataFrame, text_col: str = "text") -> Model:
    """Count the texts of ``train`` (null: empty) and write the model's files."""
    texts, uri = train.select(F.col(text_col).alias("text")), new_path(train.sparkSession, "kneser-ney")
    words = count_words(texts, uri)
    kind, (start, end) = words.kind, _ends()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, vocabulary, held, n = WordHashes(), Vocabulary(words), [], 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]]).astype(np.int64)
            word, at = np.unique(np.concatenate([*held, np.array([start], dtype=np.uint64)]), return_inverse=True)
            held.clear()
            number, count, before = vocabulary.numbers(word)
            # numbers follow the hashes' order, so sorting by places in ``word`` sorts by number
            u, v, w, times = counted(*triples(at[:-1], starts, at[-1]), len(word))
            bucket = bucket_of(count[v], before[v], number[u], words.room)
            order = by_number(bucket)
            u, v, w, times, bucket = u[order], v[order], w[order], times[order], bucket[order]
            cut = np.append(runs(bucket), len(bucket))
            number, blobs = number.astype(kind), []
            for a, b in zip(cut, cut[1:]):
                mine = runs(v[a:b])
                blobs.append(packed(number[v[a:b][mine]], small(lengths_of(mine, b - a)), number[u[a:b]], number[w[a:b]], small(times[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(token_hashes(text, hashes, end))
                n += len(held[-1])
                if n >= COUNT_BLOCK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    schema = "bucket long, kind int, blob binary, sums array<long>"

    def table_of(rows: list[tuple]) -> pa.Table:
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary()), "sums": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    def followers(name: str, v: np.ndarray, w: np.ndarray, types: np.ndarray) -> list[tuple]:
        """Write the followers (v, w) with their numbers of left words, and give what they add to both words' sums, by range."""
        first = runs(v)
        Folder(uri).put(name, middle=v[first], offset=small(np.append(first, len(v))), right=w, types=small(types))
        sums = np.stack([np.zeros(len(first), dtype=np.int64), *(np.add.reduceat(x.astype(np.int64), first) for x in (types, types == 1, types == 2, types > 2))], axis=1) if len(v) else np.zeros((0, 5), dtype=np.int64)
        right, kinds = np.unique(w, return_counts=True)
        left = np.zeros((len(right), 5), dtype=np.int64)
        left[:, 0] = kinds
        number, add = np.concatenate([v[first], right]), np.concatenate([sums, left])
        order = np.argsort(number, kind="stable")
        number, add = number[order], add[order]
        edge = np.searchsorted(number, np.array([n for n, _ in words.before]))
        return [(r, 1, packed(number[a:b], *(small(add[a:b, k]) for k in range(5))), None) for r, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]

    def merge(table: pa.Table) -> pa.Table:
        """A bucket's contexts and followers become files; followers of a word of several buckets go on to be added up."""
        bucket, parts = table.column("bucket")[0].as_py(), []
        for blob in table.column("blob").to_pylist():
            mid, n, u, w, c = unpacked(blob)
            parts.append((np.repeat(mid, n), u, w, c.astype(np.int64)))
        v, u, w, c = (np.concatenate([p[k] for p in parts]) for k in range(4))
        del parts
        order = ordered(v, u, w)
        v, u, w, c = v[order], u[order], w[order], c[order]
        first = runs(v, u, w)
        v, u, w, c = v[first], u[first], w[first], np.add.reduceat(c, first)
        context = runs(v, u)
        size = lengths_of(context, len(w))
        middle = runs(v[context])
        long = np.flatnonzero(size > LONG_RUN)
        totals = [np.add.reduceat(x.astype(np.int64), context)[long] for x in (c, c == 1, c == 2)]
        Folder(uri).put(f"triple-{bucket}", middle=v[context][middle], offset=small(np.append(middle, len(context))), left=u[context], size=small(np.append(context, len(w))), right=w, count=small(c), long=small(long), total=small(totals[0]), ones=small(totals[1]), twos=small(totals[2]))
        # of each follower (v, w) how many left words it has here
        order = ordered(v, w)
        v, w = v[order], w[order]
        first = runs(v, w)
        types = lengths_of(first, len(w))
        v, w = v[first], w[first]
        hashes_of = Numbers(words)
        count, before = hashes_of.mass(v)
        home = bucket_of(count, before, w, words.room)
        hot = count > words.room
        sums = [int(c.sum()), len(c), *count_of_counts(c)]
        out = [(bucket, 2, None, [*sums, *([0] * 11)])]
        if not hot.all():
            own = ~hot
            out += [(0, 3, None, [0] * 6 + [int(own.sum()), *count_of_counts(types[own]), *([0] * 6)])]
            out += followers(f"pair-{bucket}", v[own], w[own], types[own])
        for b in np.unique(home[hot]):
            mine = hot & (home == b)
            out.append((int(b), 0, packed(v[mine], w[mine], small(types[mine])), None))
        return table_of(out)

    def add_up(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpacked(b) for b in table.column("blob").to_pylist()]
        v, w, types = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = ordered(v, w)
        v, w, types = v[order], w[order], types[order].astype(np.int64)
        first = runs(v, w)
        v, w, types = v[first], w[first], np.add.reduceat(types, first)
        return table_of([(0, 3, None, [0] * 6 + [len(v), *count_of_counts(types), *([0] * 6)]), *followers(f"hot-{bucket}", v, w, types)])

    def finish(table: pa.Table) -> pa.Table:
        """A range of words: its sums are added up."""
        r = table.column("bucket")[0].as_py()
        low, high = words.before[r][0], words.before[r + 1][0]
        stats = np.zeros((high - low, 5), dtype=np.int64)
        for blob in table.column("blob").to_pylist():
            number, *add = unpacked(blob)
            at = number.astype(np.int64) - low
            # a word stands at most twice in a blob: as a middle and as a right word
            for k in range(5):
                np.add.at(stats[:, k], at, add[k].astype(np.int64))
        Folder(uri).put(f"stats-{r}", stats=small(stats.reshape(-1)))
        types = stats[:, 0]
        return table_of([(r, 4, None, [0] * 11 + [*count_of_counts(types), int((types > 2).sum()), 0])])

    dealt = texts.mapInArrow(count, "bucket long, blob binary")
    first = settle(dealt.groupBy("bucket").applyInArrow(merge, schema), "followers")
    second = settle(first.filter("kind = 0").groupBy("bucket").applyInArrow(add_up, schema), "followers")
    adds = first.unionByName(second)
    third = adds.filter("kind = 1").groupBy("bucket").applyInArrow(finish, schema)
    row = adds.unionByName(third).filter("sums is not null").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(f"s{i}") for i in range(17))).first()
    triple_d, pair_d, word_d = discounts(list(row[2:6])), discounts(list(row[7:11])), discounts(list(row[11:15]))
    rest = (word_d[0] * row[11] + word_d[1] * row[12] + word_d[2] * row[15]) / row[6] if row[6] else 1.0
    return Model(words, triple_d, pair_d, word_d, row[6], rest)


class Numbers(Vocabulary):
    """Looks up what is known of words by their numbers."""

    def mass(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, tokens of all words before) of sorted numbers."""
        firsts = np.array([w for w, _ in self.w.before])
        count, before = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
        edge = np.searchsorted(numbers, firsts)
        for r in np.flatnonzero(np.diff(edge)):
            at = numbers[edge[r] : edge[r + 1]].astype(np.int64) - firsts[r]
            upto = self.folder.get(f"word-{r}")["upto"]
            count[edge[r] : edge[r + 1]], before[edge[r] : edge[r + 1]] = upto[at + 1] - upto[at], upto[at] + self.w.before[r][1]
        return count, before


def sought(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in its own sorted stretch values[low:high], -1 if it is not there."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    found, at = np.full(len(wanted), -1, dtype=np.int64), np.flatnonzero(low < high)
    low, high, wanted = low[at], high[at], wanted[at]
    while len(at):
        middle = (low + high) >> 1
        here = values[middle]
        hit, less = here == wanted, here < wanted
        found[at[hit]] = middle[hit]
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        more = np.flatnonzero(~hit & (low < high))
        if len(more) < len(at):
            at, low, high, wanted = at[more], low[more], high[more], wanted[more]
    return found


class Scorer:
    def __init__(self, model: Model):
        self.m, self.vocabulary = model, Vocabulary(model.words)
        self.start, self.end = _ends()

    def word_probability(self, types: np.ndarray) -> np.ndarray:
        m = self.m
        if not m.pair_types:
            return np.full(len(types), 1.0 / (m.words.words + 1))
        d = np.array([0.0, *m.word_discounts])[np.minimum(types, 3)]
        return (types - d) / m.pair_types + m.word_rest / (m.words.words + 1)

    def by_bucket(self, prefix: str, bucket: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """(places, mapped file) of each bucket among the ``wanted`` places."""
        order = wanted[by_number(bucket[wanted])]
        cut = np.append(runs(bucket[order]), len(order))
        for a, b in zip(cut, cut[1:]):
            held = self.vocabulary.folder.get(f"{prefix}-{bucket[order[a]]}")
            if held is not None:
                yield order[a:b], held

    @staticmethod
    def stretch(held: dict[str, np.ndarray], middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a middle word's entries lie in a file; an empty stretch if there are none."""
        at = np.minimum(np.searchsorted(held["middle"], middle), len(held["middle"]) - 1)
        there = held["middle"][at] == middle
        return np.where(there, held["offset"][at], 0), np.where(there, held["offset"][at + 1], 0)

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each text's token hashes."""
        m, tokens = self.m, np.concatenate([*texts, np.array([self.start], dtype=np.uint64)])
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        word, at = np.unique(tokens, return_inverse=True)
        number, count, before = self.vocabulary.numbers(word)
        known = np.flatnonzero(number >= 0)
        stats = np.zeros((len(word), 5), dtype=np.int64)
        stats[known] = self.vocabulary.stats(number[known])
        base = np.log10((count + SMALLEST) / (m.words.tokens + SMALLEST * (m.words.words + 1)))
        _, v, w = triples(at[:-1], starts, at[-1])
        size = np.int64(len(word))

        # two words: distinct (v, w)
        pair, of_pair = np.unique(v * size + w, return_inverse=True)
        pv, pw = pair // size, pair % size
        types = np.zeros(len(pair), dtype=np.int64)
        bucket = bucket_of(count[pv], before[pv], number[pw], m.words.room)
        both, hot = (number[pv] >= 0) & (number[pw] >= 0), count[pv] > m.words.room
        for prefix, wanted in (("pair", both & ~hot), ("hot", both & hot)):
            for place, held in self.by_bucket(prefix, bucket, np.flatnonzero(wanted)):
                found = sought(held["right"], *self.stretch(held, number[pv[place]]), number[pw[place]])
                hit = found >= 0
                types[place[hit]] = held["types"][found[hit]]
        d = np.array([0.0, *m.pair_discounts])
        total, kinds = stats[pv, 1], stats[pv, 2:]
        uni = self.word_probability(stats[:, 0])[pw]
        two = np.divide(types - d[np.minimum(types, 3)], total, out=np.zeros(len(pair)), where=total > 0) + np.divide(kinds @ d[1:], total, out=np.ones(len(pair)), where=total > 0) * uni

        # three words: distinct contexts (u, v), then each token in its context; a context is the pair that ends before it
        of_context = np.empty_like(of_pair)
        of_context[1:] = of_pair[:-1]
        of_context[starts] = len(pair)
        cu, cv = np.append(pv, at[-1]), np.append(pw, at[-1])
        context = np.arange(len(pair) + 1)
        bucket = bucket_of(count[cv], before[cv], number[cu], m.words.room)
        sums = np.zeros((len(context), 4), dtype=np.int64)
        times = np.zeros(len(w), dtype=np.int64)
        by_context = np.argsort(of_context)
        edge = edges_of(of_context[by_context], len(context))
        for place, held in self.by_bucket("triple", bucket, np.flatnonzero((number[cu] >= 0) & (number[cv] >= 0))):
            found = sought(held["left"], *self.stretch(held, number[cv[place]]), number[cu[place]])
            place, found = place[found >= 0], found[found >= 0]
            low, high = held["size"][found].astype(np.int64), held["size"][found + 1].astype(np.int64)
            sums[place] = self.sums_of(held, found, low, high)
            # the tokens of these contexts
            n = edge[place + 1] - edge[place]
            token = by_context[np.repeat(edge[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            where = sought(held["right"], np.repeat(low, n), np.repeat(high, n), number[w[token]])
            hit = where >= 0
            times[token[hit]] = held["count"][where[hit]]
        d = np.array([0.0, *m.triple_discounts])
        total, rest = sums[:, 0], sums[:, 1:] @ d[1:]
        total, rest = total[of_context], rest[of_context]
        p = np.where(total > 0, np.divide(times - d[np.minimum(times, 3)] + rest * two[of_pair], total, out=np.zeros(len(w)), where=total > 0), two[of_pair])
        fold = lambda x: np.add.reduceat(x, starts)
        return fold((count[w] > 0).astype(np.int64)), fold(base[w]), fold(np.log10(p))

    @staticmethod
    def sums_of(held: dict[str, np.ndarray], found: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of (count, followers of 1, 2 and more) of contexts; long ones have theirs stored."""
        out, n = np.zeros((len(found), 4), dtype=np.int64), high - low
        short = np.flatnonzero(n <= LONG_RUN)
        if len(short):
            m = n[short]
            first = np.cumsum(m) - m
            c = held["count"][np.repeat(low[short] - first, m) + np.arange(m.sum())].astype(np.int64)
            out[short] = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)], axis=1)
        long = np.flatnonzero(n > LONG_RUN)
        if len(long):
            at = np.searchsorted(held["long"], found[long].astype(held["long"].dtype))
            total, ones, twos = (held[k][at].astype(np.int64) for k in ("total", "ones", "twos"))
            out[long] = np.stack([total, ones, twos, n[long] - ones - twos], axis=1)
        return out


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: str = "held_out") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hashes = Scorer(model), WordHashes()
        for batch in batches:
            texts, n, known, base, score, size = [], 0, [], [], [], []

            def flush() -> None:
                for out, part in zip((known, base, score), scorer.score(texts)):
                    out.append(part)
                size.append([len(t) for t in texts])

            for text in batch.column("text").to_pylist():
                texts.append(token_hashes(text, hashes, scorer.end))
                n += len(texts[-1])
                if n >= SCORE_BLOCK:
                    flush()
                    texts, n = [], 0
            if texts:
                flush()
            if not size:
                continue
            tokens, logs = np.concatenate(size).astype(np.int64), np.concatenate(score)
            columns = [batch.column("id"), batch.column("held_out"), pa.array(tokens), pa.array(np.concatenate(known)), pa.array(np.full(len(tokens), model.words.tokens, dtype=np.int64)), pa.array(np.concatenate(base)), pa.array(logs), pa.array(10 ** (-logs / tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(held_out).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def fold_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Learn from nine folds in ten and score every document.

    A fold is crc32 of the id's text modulo ``folds``; fold 0 is held out, and so
    is a null id. Null texts are empty: one end. Repeated rows each count and give
    a row; an empty table gives none. Without training texts every probability is
    that of an unknown word. Columns but doc_id and text are not read; a very long
    text is counted and scored whole.
    """
    split = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True)).alias("held_out"))
    return score_texts(split, learn(split.filter(~F.col("held_out"))))
