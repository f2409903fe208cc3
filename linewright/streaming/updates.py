"""An extension without a counterpart: incremental updates as a stream of files.

Each micro-batch of incoming rows is classified against the archive table and
appended under new indexes. The table is kept as immutable generations, one
folder a batch, so a repeated batch overwrites its own folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linewright.operators.changes import append_numbered


def apply_updates(incoming: DataFrame, archive: str, checkpoint: str, key: str, index: str, order: str) -> StreamingQuery:
    """Append the stream's unknown keys to the archive below ``archive`` (folders batch=N)."""
    schema = incoming.schema

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{index}` long, batch long").parquet(archive).filter(f"batch < {number}")
        fresh = append_numbered(held, batch.dropDuplicates([key]), key, index, order)
        fresh.select(*schema.names, index).write.mode("overwrite").parquet(f"{archive}/batch={number}")

    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_archive(spark: SparkSession, rows: DataFrame, archive: str) -> None:
    """The first generation, before any batch."""
    rows.write.mode("overwrite").parquet(f"{archive}/batch=-1")
