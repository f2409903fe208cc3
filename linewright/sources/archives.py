"""Readers for packages of voice files: folders and ZIP archives, WAV headers, XLSX indexes.

Both are Python data sources, so members and rows are read in parallel by file
and a filter on names reaches the reader.
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from linewright.functions.text import basename, stem

# Limits of one archive.
MOST_MEMBERS, MOST_BYTES = 100_000, 32 << 30


class _OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(options: dict) -> list[str]:
    return [p for p in options.get("path", "").split(",") if p]


def _safe(name: str) -> str:
    plain = name.replace("\\", "/")
    if plain.startswith("/") or ".." in plain.split("/") or ":" in plain.split("/")[0]:
        raise ValueError(f"unsafe member name: {name}")
    return plain


class ZipMembers(DataSource):
    """Members of ZIP archives: archive, member, size, content (null unless option content is true).

    Option ``members``, a JSON list of names, reads only those, whatever their case.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, ordinal long, member string, size long, content binary"

    def reader(self, schema):
        return _ZipReader(self.options)


class _Wanted(DataSourceReader):
    """Takes filters on one column of names from Spark."""

    column = ""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = set(f.value) if isinstance(f, In) and f.attribute == (self.column,) else {f.value} if isinstance(f, EqualTo) and f.attribute == (self.column,) else None
            if values is None:
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self):
        return [_OneFile(p) for p in _files(self.options)]


class _ZipReader(_Wanted):
    column = "member"

    def read(self, partition: _OneFile) -> Iterator[tuple]:
        with_content = self.options.get("content", "false").lower() == "true"
        asked = {m.replace("\\", "/").casefold() for m in json.loads(self.options["members"])} if "members" in self.options else None
        with zipfile.ZipFile(partition.path) as z:
            members = [m for m in z.infolist() if not m.is_dir()]
            if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_BYTES:
                raise ValueError("the archive is larger than the limits")
            for k, m in enumerate(members):
                name = _safe(m.filename)
                if (self.wanted is None or name in self.wanted) and (asked is None or name.casefold() in asked):
                    yield partition.path, k, name, m.file_size, z.read(m) if with_content else None


class XlsxIndex(DataSource):
    """Rows of the first sheet of XLSX workbooks as (workbook, ordinal, filename, cells).

    The header row names the cells; option ``filename_header`` says which one is the file name.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx_index"

    def schema(self) -> str:
        return "workbook string, ordinal long, filename string, cells map<string,string>"

    def reader(self, schema):
        return _XlsxReader(self.options)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_rows(path: str) -> Iterator[list[str]]:
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, item in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if _local(item.tag) == "si":
                    shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
                    item.clear()
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if _local(row.tag) != "row":
                continue
            cells: list[str] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells.extend([""] * (at + 1 - len(cells)))
                texts = [x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")]
                value = "".join(texts)
                cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
            yield cells
            row.clear()


class _XlsxReader(_Wanted):
    column = "filename"

    def read(self, partition: _OneFile) -> Iterator[tuple]:
        named = self.options.get("filename_header", "filename")
        rows = _sheet_rows(partition.path)
        header = [h.strip() for h in next(rows, [])]
        if named not in header:
            raise ValueError(f"{partition.path} has no column {named}")
        for k, cells in enumerate(rows):
            record = dict(zip(header, cells + [""] * (len(header) - len(cells))))
            name = record[named].strip()
            if name and not name.lower().endswith(".wav"):
                name += ".wav"
            if name and (self.wanted is None or name in self.wanted):
                yield partition.path, k, name, record


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(XlsxIndex)


def wav_header(content: bytes | None) -> dict:
    """Fields of a PCM WAV or RF64 header, or the reason why it is none."""
    none = {"sample_rate": None, "channels": None, "sample_bits": None, "frames": None, "problem": None}
    b = content or b""
    if len(b) < 12 or b[:4] not in (b"RIFF", b"RF64") or b[8:12] != b"WAVE":
        return none | {"problem": "not_wave"}
    at, fmt, large = 12, None, None
    while at + 8 <= len(b):
        name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        body = at + 8
        if name == b"ds64" and size >= 16:
            large = struct.unpack_from("<Q", b, body + 8)[0]
        elif name == b"fmt " and size >= 16:
            code, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", b, body)
            if code == 0xFFFE and size >= 40:
                code = struct.unpack_from("<H", b, body + 24)[0]
            fmt = (code, channels, rate, align, bits)
        elif name == b"data":
            size = large if size == 0xFFFFFFFF and large is not None else size
            if fmt is None:
                return none | {"problem": "data_before_format"}
            code, channels, rate, align, bits = fmt
            if code != 1:
                return none | {"problem": "not_pcm"}
            if not align or size % align:
                return none | {"problem": "misaligned"}
            return {"sample_rate": rate, "channels": channels, "sample_bits": bits, "frames": size // align, "problem": None}
        at = body + size + size % 2
    return none | {"problem": "no_data"}


WAV_HEADER = T.StructType([*(T.StructField(c, T.LongType()) for c in ("sample_rate", "channels", "sample_bits", "frames")), T.StructField("problem", T.StringType())])


@F.pandas_udf(WAV_HEADER)
def wav_header_of(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wav_header(x) for x in content], columns=["sample_rate", "channels", "sample_bits", "frames", "problem"]).astype({c: "Int64" for c in ("sample_rate", "channels", "sample_bits", "frames")})


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: member (path below it), size, content. Content is read only where used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(folder.rstrip("/") + "/"), F.lit("\\E"))), -1).alias("member"), F.col("length").alias("size"), "content")


def inventory(members: DataFrame, member: str = "member", size: str = "size") -> tuple[DataFrame, DataFrame]:
    """(one row of counts, a row for each voice file whose name others share: name, member).

    pairs: voices with a label of their own path; member_pairs: those, and voices whose
    stem only one label has; stem_pairs and unlabelled: stems of voices with and without
    a label. digest does not depend on the order of the members.
    """
    kind, path = F.lower(F.substring_index(member, ".", -1)), F.col(member)
    own = F.lower(F.concat(F.substring(path, F.lit(1), F.length(member) - F.length(basename(path))), stem(path)))
    rows = members.withColumn("_kind", kind).withColumn("_path", own).withColumn("_stem", stem(path))
    both = lambda by: rows.groupBy(by).agg(F.count_if(F.col("_kind") == "wav").alias("w"), F.count_if(F.col("_kind") == "lab").alias("l"))
    at, stems = both("_path"), both("_stem")
    paired = at.agg(F.count_if((F.col("w") > 0) & (F.col("l") > 0)).alias("pairs"))
    single = stems.filter("l = 1").select(F.col("_stem").alias("_s"))
    voices = rows.filter("_kind = 'wav'").join(at.filter("l > 0").select(F.col("_path").alias("_p"), F.lit(True).alias("_own")), F.col("_path") == F.col("_p"), "left").join(single, F.col("_stem") == F.col("_s"), "left")
    by_member = voices.agg(F.count_if(F.col("_own").isNotNull() | F.col("_s").isNotNull()).alias("member_pairs"))
    by_stem = stems.agg(F.count_if((F.col("w") > 0) & (F.col("l") > 0)).alias("stem_pairs"), F.count_if((F.col("w") > 0) & (F.col("l") == 0)).alias("unlabelled"))
    each = F.conv(F.substring(F.sha2(F.concat_ws("\n", path, F.col(size).cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    counts = rows.agg(F.count("*").alias("members"), F.count_if(F.col("_kind") == "wav").alias("voices"), F.count_if(F.col("_kind") == "lab").alias("labels"), F.sum(size).alias("bytes"), F.sha2(F.coalesce(F.sum(each), F.lit(0)).cast("string"), 256).alias("digest"))
    for one in (paired, by_member, by_stem):
        counts = counts.join(F.broadcast(one), how="inner")  # one row each
    name = F.lower(basename(path))
    repeated = rows.filter("_kind = 'wav'").groupBy(name.alias("name")).agg(F.count("*").alias("_n")).filter("_n > 1").select("name")
    return counts, rows.filter("_kind = 'wav'").select(name.alias("_name"), path.alias("member")).join(repeated, F.col("_name") == F.col("name")).select("name", "member")


def source_outcome(expected: Column, content: Column, ambiguous: Column | None = None, moved: Column | None = None, normalized: Column | None = None) -> Column:
    """What a byte audit says of a file against its recorded SHA-256.

    unverifiable without a proper hash, ambiguous where several files could be meant,
    missing, changed_during_verify where it moved while it was read, verified, and of
    other bytes mismatch, or normalization_ambiguous in archives whose audio was converted.
    """
    no = F.lit(False)
    fits = F.rlike(F.trim(F.coalesce(expected, F.lit(""))), F.lit("^[0-9a-fA-F]{64}$"))
    return (
        F.when(~fits, "unverifiable")
        .when(no if ambiguous is None else ambiguous, "ambiguous")
        .when(content.isNull(), "missing")
        .when(no if moved is None else moved, "changed_during_verify")
        .when(F.sha2(content, 256) == F.lower(F.trim(expected)), "verified")
        .when(no if normalized is None else normalized, "normalization_ambiguous")
        .otherwise("mismatch")
    )
