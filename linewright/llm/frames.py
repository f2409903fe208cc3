"""Token ids as binary files: a zstandard frame for each document, and a seek table at the end.

A file is a plain seekable-zstandard file: independent frames, one a document
(its ids as little-endian unsigned 32-bit integers), then a skippable frame with
the documents' own numbers, then the skippable seek table: compressed size, size
and XXH64 checksum (low 32 bits) of each frame, and the footer. So ``zstd -d``
restores all ids, and a reader finds any document from the table alone.

The data source ``token_frames`` writes such a file for each task. The folder's
manifest is moved into place when all tasks have ended and names the files that
count; until then, and when a write fails, the former manifest holds. Reading
takes filters on doc_id: other files are not opened, other frames not read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from linewright.llm.bpe import BATCH_BYTES, id_encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE_NUMBERS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, FOOTER, HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
MOST_FRAME = (1 << 32) - 1

MANIFEST = "manifest.json"
#: Bytes of ids that one reading task takes.
SPLIT_BYTES = 32 << 20
#: Bytes read at once from frames side by side.
SPAN_BYTES = 4 << 20


def _checksum(body: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(body) & 0xFFFFFFFF


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Appends documents to an open stream, in ascending order of their numbers (null first)."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.numbers, self.nulls, self.tokens = stream, [], 0, 0
        self.table = bytearray()
        self.frame = zstandard.ZstdCompressor(level=level).compress
        self.checked_frame = zstandard.ZstdCompressor(level=level, write_checksum=True).compress

    def _put(self, data: bytes, size: int, checksum: int) -> None:
        if max(size, len(data)) > MOST_FRAME:
            raise ValueError("a frame of 4 GB or more does not fit the seek table")
        self.stream.write(data)
        self.table += ENTRY.pack(len(data), size, checksum)

    def append(self, number: int | None, ids: bytes) -> None:
        if number is None:
            if self.numbers:
                raise ValueError("documents must come in ascending order, null first")
            self.nulls += 1
        else:
            if self.numbers and number < self.numbers[-1]:
                raise ValueError("documents must come in ascending order")
            self.numbers.append(number)
        self._put(self.frame(ids), len(ids), _checksum(ids))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        numbers = self.checked_frame(struct.pack("<Q", self.nulls) + np.array(self.numbers, dtype="<i8").tobytes())
        self._put(HEAD.pack(SKIPPABLE_NUMBERS, len(numbers)) + numbers, 0, _checksum(b""))
        frames = len(self.table) // ENTRY.size
        self.stream.write(HEAD.pack(SKIPPABLE_TABLE, len(self.table) + FOOTER.size) + self.table + FOOTER.pack(frames, CHECKSUMS, SEEKABLE))


class FrameReader:
    """A file's documents, by their place in it: only the seek table, the numbers and asked frames are read."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompress, self.fault = source, zstandard.ZstdDecompressor().decompress, zstandard.ZstdError
        frames, descriptor, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not descriptor & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table_at = size - FOOTER.size - frames * ENTRY.size
        head, _ = HEAD.unpack(self._at(table_at - HEAD.size, HEAD.size))
        if head != SKIPPABLE_TABLE:
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self._at(table_at, frames * ENTRY.size), dtype="<u4").reshape(-1, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        if frames == 0 or ends[-1] != table_at - HEAD.size:
            raise ValueError("the seek table is damaged")
        self.packed, self.sizes, self.checksums = table[:-1].T
        self.offsets = ends[:-1] - self.packed
        #: ids before each document within this file
        self.starts = (np.cumsum(self.sizes) - self.sizes) // 4
        body = self.decompress(self._at(int(ends[-1] - table[-1, 0]) + HEAD.size, int(table[-1, 0]) - HEAD.size))
        self.nulls = struct.unpack_from("<Q", body)[0]
        self.numbers = np.frombuffer(body, dtype="<i8", offset=8)
        if self.nulls + len(self.numbers) != len(self.sizes):
            raise ValueError("the documents' numbers are damaged")

    def _at(self, offset: int, size: int) -> bytes:
        if offset < 0:
            raise ValueError("the file is cut short")
        self.source.seek(offset)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("the file is cut short")
        return data

    def number(self, k: int) -> int | None:
        return int(self.numbers[k - self.nulls]) if k >= self.nulls else None

    def places(self, wanted: np.ndarray | None, first: int, end: int) -> np.ndarray:
        """Places of the wanted numbers (all if None) from first to end."""
        if wanted is None:
            return np.arange(first, end)
        found = np.flatnonzero(np.isin(self.numbers, wanted)) + self.nulls
        return found[(found >= first) & (found < end)]

    def ids(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of ascending places; frames side by side are read together, up to SPAN_BYTES."""
        at = 0
        while at < len(places):
            first, to, size = int(places[at]), at + 1, int(self.packed[places[at]])
            while to < len(places) and places[to] == places[to - 1] + 1 and size + self.packed[places[to]] <= SPAN_BYTES:
                size += int(self.packed[places[to]])
                to += 1
            span, base = memoryview(self._at(int(self.offsets[first]), size)), int(self.offsets[first])
            for k in places[at:to].tolist():
                offset = int(self.offsets[k]) - base
                try:
                    body = self.decompress(span[offset : offset + int(self.packed[k])], max_output_size=int(self.sizes[k]))
                except self.fault as e:
                    raise ValueError(f"frame {k} is damaged") from e
                if len(body) != self.sizes[k] or _checksum(body) != self.checksums[k]:
                    raise ValueError(f"frame {k} is damaged")
                yield k, body
            at = to


@dataclass
class _File(WriterCommitMessage):
    part: int
    name: str
    documents: int
    tokens: int
    least: int | None
    most: int | None
    nulls: int


class TokenFrames(DataSource):
    """(doc_id, text) or (doc_id, ids) written as files of frames; read as (doc_id, start, n_tokens, ids).

    Texts are encoded as they are written, by the options vocabulary, end_id and, if
    given, ranks and pattern.
    """

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        kinds = [(f.name, f.dataType.simpleString()) for f in schema]
        if kinds not in ([("doc_id", "bigint"), ("ids", "binary")], [("doc_id", "bigint"), ("text", "string")]):
            raise ValueError("write doc_id long and ids binary or text string")
        return _Writer(dict(self.options), kinds[1][0], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, column: str, overwrite: bool):
        self.path, self.options, self.column, self.overwrite = options["path"], options, column, overwrite

    def _ids(self):
        """What makes ids, as bytes, of a value that is written."""
        if self.column == "ids":
            return lambda ids: ids
        encode = id_encoder(self.options["vocabulary"], self.options.get("ranks"), self.options.get("pattern"))
        closing = np.array([int(self.options["end_id"])], dtype="<u4").tobytes()
        return lambda text: encode(text or "") + closing

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _File:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.zst"  # its own name: a repeated task overwrites nothing
        with fs.open_output_stream(f"{root}/{name}", compression=None) as stream:
            file, ids = FrameWriter(stream), self._ids()
            for batch in iterator:
                for number, value in zip(batch.column("doc_id"), batch.column(self.column)):
                    file.append(number.as_py(), ids(value.as_py()))
            file.close()
        numbers = file.numbers
        return _File(part, name, file.nulls + len(numbers), file.tokens, numbers[0] if numbers else None, numbers[-1] if numbers else None, file.nulls)

    def commit(self, messages: list[_File]) -> None:
        from pyarrow import fs as pafs

        fs, root = _file_system(self.path)
        former = fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound
        if former and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds ids already; write with mode overwrite")
        files, start, last = [], 0, None
        for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.part):
            if m.least is not None:
                if last is not None and m.least < last:
                    raise ValueError("tasks must hold ascending ranges of doc_id")
                last = m.most
            files.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "least": m.least, "most": m.most, "nulls": m.nulls, "start": start})
            start += m.tokens
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"tokens": start, "files": files}).encode())
        fs.move(draft, f"{root}/{MANIFEST}")

    def abort(self, messages: list[_File | None]) -> None:
        fs, root = _file_system(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class _Part(InputPartition):
    def __init__(self, name: str, start: int, first: int, end: int):
        self.name, self.start, self.first, self.end = name, start, first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = set(f.value) if isinstance(f, In) and f.attribute == ("doc_id",) else {f.value} if isinstance(f, EqualTo) and f.attribute == ("doc_id",) else None
            if values is None:
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
            files = json.loads(source.read())["files"]
        parts = []
        for f in files:
            if self.wanted is not None and not any(f["least"] is not None and f["least"] <= w <= f["most"] for w in self.wanted):
                continue
            n, pieces = f["documents"], f["tokens"] * 4 // SPLIT_BYTES + 1
            parts += [_Part(f["name"], f["start"], n * k // pieces, n * (k + 1) // pieces) for k in range(pieces)]
        return parts or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        if not partition.name:
            return
        fs, root = _file_system(self.path)
        path = f"{root}/{partition.name}"
        with fs.open_input_file(path) as source:
            file = FrameReader(source, fs.get_file_info(path).size)
            wanted = None if self.wanted is None else np.array(sorted(self.wanted), dtype=np.int64)
            rows, held = [], 0
            for k, ids in file.ids(file.places(wanted, partition.first, partition.end)):
                rows.append((file.number(k), partition.start + int(file.starts[k]), len(ids) // 4, ids))
                held += len(ids)
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFrames)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, ranks: str | None = None, pattern: str | None = None, file_bytes: int = 256 << 20, mode: str = "append", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts to ``path``, in ascending order of their numbers, a file for each ``file_bytes`` of text.

    Null texts count as empty: one end id. Null numbers come first; of equal
    numbers the text with the smaller hash; repeated rows are written each. An empty
    table gives a manifest without files. A text of any length is one frame (up to
    4 GB of ids). Other columns are ignored.
    """
    spark = docs.sparkSession
    register(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(size // file_bytes + 1, min(2 * spark.sparkContext.defaultParallelism, (size >> 20) + 1))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    known = {k: v for k, v in {"vocabulary": vocabulary, "end_id": end_id, "ranks": ranks, "pattern": pattern}.items() if v is not None}
    ranged.write.format("token_frames").options(**known).mode(mode).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents at ``path``; filters on doc_id reach the files."""
    register(spark)
    return spark.read.format("token_frames").load(path)
