"""Stage tables: a step's result is kept by the fingerprint of what it was made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, *columns: Column) -> str:
    """A fingerprint of rows whatever their order and partitions: their count and the sum of their hashes.

    Rows are hashed to 64 bits and summed as decimals, so the sum is exact and only one row comes back.
    """
    hashed = F.xxhash64(*(columns or [F.col(c) for c in rows.columns]))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n:x}-{int(total) % (1 << 128):x}"


def stage(spark: SparkSession, root: str, name: str, inputs: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if these inputs made it before, else made and written.

    A folder that a broken run left without _SUCCESS does not count.
    """
    key = "-".join(f"{k}={v}" for k, v in sorted(inputs.items()))
    path = f"{root}/stage={name}/{key}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

