"""Stored intermediate tables and names that clash with none."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def apart(*frames: DataFrame) -> str:
    """A prefix that no column of the frames has, whatever its case."""
    names, prefix = [c.lower() for f in frames for c in f.columns], "_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def columns_of(df: DataFrame) -> list[Column]:
    """A frame's columns; names with dots too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; a local session without one gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_folder:
            _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        named = _own_folder[app]
    return f"{named.rstrip('/')}/linewright/{app}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to many tasks: for rows of few bytes and much work, which files and merged shuffles leave to a few."""
    return df.repartition(max(48, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once and read back, so that it is computed once however often it is used, and alike each time."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
