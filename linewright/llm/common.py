"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

#: A side of a join is broadcast only if its rows hold no more bytes.
BROADCAST_BYTES = 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, for a worker; emptied when it holds ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none (tests) gets one made; elsewhere that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[app]


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables, to be removed when its results have been used."""
    return f"{shared_folder(spark)}/linewright/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts lineage, computes the frame once however often it is used, and
    survives lost executors. Texts are written beside what was found in them, so
    the tables are compressed well.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this application's tables; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(*frames: DataFrame) -> str:
    """A prefix that no column of the frames has, whatever its case: names made with it clash with none."""
    names, prefix = [c.lower() for f in frames for c in f.columns], "_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def columns_of(df: DataFrame) -> list[Column]:
    """A frame's columns; names with dots too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def bytes_of(table: DataFrame) -> int:
    """Bytes of a settled table's rows, written out: a bound of what a broadcast of it holds."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct(*columns_of(table)))))).first()[0] or 0


def small_side(table: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table marked for broadcast if its size allows; if not, a join that Spark may split."""
    return F.broadcast(table) if bytes_of(table) <= most_bytes else table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
