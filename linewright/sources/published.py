"""The index outputs of an archive, published as versions: a reader sees a whole version or the one before.

``publish`` writes every table of a version into a folder of its own by Spark's
writers, whose commit protocol leaves no half-written task, and then replaces the
pointer file in one move. A write that fails or is killed leaves the pointer, and so
the former version, as it was; what it left behind is removed by ``drop_old``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.text import logical_id, stem, variant
from linewright.operators.tables import stored

# The columns of the corrected index, as built, with identities, and what a sync of edits adds.
CORRECTED = ("index", "start", "audio_end", "display_end", "group", "filename", "source_member_id", "target_text_source", "target_text", "source_text", "chinese_source", "chinese", "english", "reference_language", "reference_text", "source_duration_seconds", "sha256")
AUGMENTED = ("index", "start", "audio_end", "display_end", "group", "filename", "source_member_id", "logical_id", "variant", "target_text_source", "target_text", "source_text", "reference_language", "reference_text", "chinese_source", "chinese", "english", "source_duration_seconds", "sha256")
SYNCED = ("final_chs", "modified")
# The former name of a text source and its present one.
FORMER_SOURCE, PRESENT_SOURCE = "official_chs_lab", "official_target_lab"
POINTER = "current.json"


def minutes_clock(seconds: Column) -> Column:
    """MM:SS.mmm, the minutes beyond 99 if need be, half-even; never before 0."""
    ms = F.greatest(F.lit(0).cast("long"), F.bround(seconds * 1000).cast("long"))
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def manifest(entries: DataFrame) -> DataFrame:
    """Entries with source_text, target_text, target_text_source, logical_id, variant; a missing reference language is auto."""
    name = stem(_text("filename"))
    return entries.withColumns(
        {
            "source_text": _text("english"), "target_text": _text("chinese"), "target_text_source": F.when(_text("chinese_source") == FORMER_SOURCE, PRESENT_SOURCE).otherwise(_text("chinese_source")),
            "logical_id": logical_id(name), "variant": variant(name), "reference_text": _text("reference_text"), "reference_language": F.coalesce(F.nullif(_text("reference_language"), F.lit("")), F.lit("auto")),
        }
    )


def corrected_index(entries: DataFrame, identities: bool = True) -> DataFrame:
    """The corrected index of ``manifest``'s rows: 17 columns, or 19 with identities; times as clocks, all else as texts."""
    clocks = {"start": minutes_clock(F.col("start_seconds")), "audio_end": minutes_clock(F.col("audio_end_seconds")), "display_end": minutes_clock(F.col("display_end_seconds"))}
    clocks["source_duration_seconds"] = F.format_string("%.6f", F.col("source_duration_seconds").cast("double"))
    return entries.select(*(clocks.get(c, _text(c)).alias(c) for c in (AUGMENTED if identities else CORRECTED)))


def synced(index: DataFrame, edits: DataFrame, order: str) -> DataFrame:
    """The index with final_chs and modified of the edit of a row's member, else of its file name, else of its number.

    Edits have source_member_id, filename, id, final_chs and modified; the last in
    order holds, blank keys hold nothing, and rows without an edit get blanks. Edits are
    reduced to one a key before each join.
    """
    edits = edits.select(_text("source_member_id").alias("source_member_id"), _text("filename").alias("filename"), _text("id").alias("index"), F.struct(_text("final_chs").alias("final_chs"), F.when(F.coalesce(F.col("modified"), F.lit(False)), "true").otherwise("false").alias("modified")).alias("edit"), F.col(order).alias("at"))
    rows, found = index, []
    for k, key in enumerate(("source_member_id", "filename", "index")):
        last = edits.filter(F.col(key) != "").groupBy(F.col(key).alias(f"edit_key_{k}")).agg(F.max_by("edit", "at").alias(f"edit_{k}"))
        rows = rows.join(last, F.col(key) == F.col(f"edit_key_{k}"), "left")
        found.append(F.col(f"edit_{k}"))
    edit = F.coalesce(*found)
    return rows.select(*index.columns, *(F.coalesce(edit[c], F.lit("")).alias(c) for c in SYNCED))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there in one step, over a former one."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    draft, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(text.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(hadoop.Path(path)), options)


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    where, fs = _fs(spark, f"{folder}/{POINTER}")
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def _ordered(table: DataFrame, order: list[str]) -> DataFrame:
    return table.repartitionByRange(*order).sortWithinPartitions(*order)


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], order: dict[str, list[str]], report: dict | None = None) -> str:
    """Write tables as one new version and point to it; the version's name.

    A table is computed once, and written as CSV with a header and as JSON lines, both
    in files that follow its order. Nothing points to the version before all of it is there.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        at = f"{folder}/versions/{version}/{name}"
        # stored first: ranges are sampled by a run of their own, and a table that can't be computed twice alike has the same rows in both
        held = stored(table, "publish")
        _ordered(held, order[name]).write.option("ignoreNullFields", False).json(f"{at}/json")
        texts = _ordered(held, order[name]).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in table.columns))
        texts.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{at}/csv")
    _replace(spark, f"{folder}/{POINTER}", json.dumps({"version": version, "tables": {name: table.schema.json() for name, table in tables.items()}, "report": report or {}}))
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that the pointer names."""
    from pyspark.sql.types import StructType

    current = _pointer(spark, folder)
    if current is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.schema(StructType.fromJson(json.loads(current["tables"][name]))).json(f"{folder}/versions/{current['version']}/{name}/json")


def report(spark: SparkSession, folder: str) -> dict:
    return (_pointer(spark, folder) or {}).get("report", {})


def drop_old(spark: SparkSession, folder: str) -> int:
    """Remove the versions that nothing points to, once nobody reads or writes them; how many there were."""
    current = (_pointer(spark, folder) or {}).get("version")
    where, fs = _fs(spark, f"{folder}/versions")
    old = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() != current] if fs.exists(where) else []
    for path in old:
        fs.delete(path, True)
    return len(old)
