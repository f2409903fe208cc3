"""Readers of index tables: CSV with header aliases, JSON object maps, name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions.text import basename, blank, compacted, first_filled, inferred_group, stem
from linewright.sources.objects import read_members

# Header names under which a field may stand, in order of precedence.
ALIASES = {
    "index": ["index", "序号", "编号"],
    "group": ["group", "分组", "major_group"],
    "filename": ["filename", "文件名", "file", "wav", "wav_filename"],
    "source": ["source", "来源"],
    "source_detail": ["source_detail", "来源细分"],
    "english": ["english", "ENGLISH", "英文", "英文文本", "lab_text_escaped", "语音文本"],
    "sha256": ["sha256", "SHA-256", "sha-256"],
    "reference_text": ["reference_text", "REFERENCE_TEXT", "参考文本"],
    "reference_language": ["reference_language", "REFERENCE_LANGUAGE", "参考语言"],
    "official_target_text": ["official_target_text", "OFFICIAL_TARGET_TEXT", "官方目标文本"],
    "official_target_language": ["official_target_language", "OFFICIAL_TARGET_LANGUAGE", "官方目标语言"],
    "official_target_source": ["official_target_source", "OFFICIAL_TARGET_SOURCE", "官方目标来源"],
    "source_member_id": ["source_member_id", "SOURCE_MEMBER_ID", "来源成员路径", "member_path"],
}
SIDE_ALIASES = {
    "filename": ALIASES["filename"],
    "english": ALIASES["english"],
    "chinese": ["chinese", "CHINESE", "中文", "中文文本", "translation"],
    "source_member_id": ALIASES["source_member_id"],
}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: strings only, with ordinal, the row's place in its file.

    Spark keeps a file's rows in order; a file is read in one piece so that the
    place is exact.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False).csv(path)
    strings = raw.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in raw.columns))
    # multiLine files are one partition each, so the id counts rows within a file
    return strings.withColumn("_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id()).withColumn("ordinal", F.row_number().over(Window.partitionBy("_file").orderBy("_id")).cast("long")).drop("_id", "_file")


def pick(rows: DataFrame, field: str, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The first non-blank value among a field's aliases, row by row. Headers count as they are spelled."""
    held = [F.col(f"`{a}`") for a in aliases[field] if a in rows.columns]
    return first_filled(*held) if held else F.lit("")


def _keyed(rows: DataFrame) -> DataFrame:
    """Add key (the member, else the file name) and problems (no_filename, repeated_key)."""
    named = rows.withColumn("key", first_filled(F.col("source_member_id"), F.col("filename")))
    again = named.groupBy("key").agg(F.count("*").alias("_n")).withColumnRenamed("key", "_k")
    return named.join(again, F.col("key") == F.col("_k")).withColumn("problems", F.array_compact(F.array(F.when(F.col("filename") == "", "no_filename"), F.when(F.col("_n") > 1, "repeated_key")))).drop("_k", "_n")


def normal_index(rows: DataFrame) -> DataFrame:
    """Index rows of thirteen fixed columns and a key: the member, else the file name.

    A missing index is the row's place, a missing group the one its name tells,
    hashes are lower-cased. ``problems`` says what is wrong, empty if nothing.
    """
    read = rows.select("ordinal", *(pick(rows, f).alias(f) for f in ALIASES))
    group = F.coalesce(blank(F.col("group")), inferred_group(stem(F.col("filename"))))
    return _keyed(read.withColumn("index", F.coalesce(blank(F.col("index")), F.col("ordinal").cast("string"))).withColumn("group", group).withColumn("sha256", F.lower("sha256")))


def side_table(rows: DataFrame) -> DataFrame:
    """key, english, chinese of a bilingual table; the run fails on a row without a file name or a repeated key."""
    read = _keyed(rows.select("ordinal", *(pick(rows, f, SIDE_ALIASES).alias(f) for f in SIDE_ALIASES)))
    wrong = F.concat(F.array_join("problems", ", "), F.lit(": row "), F.col("ordinal").cast("string"), F.lit(" "), F.col("key"))
    return read.select(F.when(F.size("problems") > 0, F.raise_error(wrong)).otherwise(F.col("key")).alias("key"), "english", "chinese")


def search_compacted(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the needle, comparing only letters and digits whatever their case."""
    wanted = "".join(c for c in needle.casefold() if c.isalnum())
    if not wanted:
        raise ValueError("a search needs a letter or digit")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(compacted(F.col(c)), F.lit(wanted))
    return rows.filter(hit)


def read_object_map(spark: SparkSession, path: str, fields: str, filenames: DataFrame | None = None, name: Column | None = None, prefix: str = "") -> DataFrame:
    """A JSON object of records: ordinal, key and the fields of ``fields`` (a schema).

    Large files are read in ranges; keys that do not start with ``prefix`` are dropped before their records are parsed.
    With ``filenames`` (column filename) only records of those names stay, whatever their case.
    """
    members = read_members(spark, path).filter(F.col("key").startswith(prefix) if prefix else F.lit(True))
    parsed = members.select("ordinal", "key", F.from_json("value", f"struct<{fields}>").alias("record")).select("ordinal", "key", "record.*")
    if filenames is None:
        return parsed
    asked = filenames.select(F.lower("filename").alias("_want"), F.col("filename").alias("asked")).dropDuplicates(["_want"])
    found = name if name is not None else basename(F.col("key"))
    return parsed.withColumn("_name", F.lower(F.regexp_replace(found, r"(?i)\.wem$", ".wav"))).join(asked, F.col("_name") == F.col("_want")).drop("_name", "_want")


# The fields of a voice record in order of precedence, and the columns of a voice workbook.
RECORD_FIELDS = {"source_path": ("sourceFileName", "fileName", "inGameFilename"), "character": ("talkName", "npcName", "speaker", "avatarName"), "english": ("voiceContent", "text", "transcription"), "avatar_name": ("avatarName",)}
WORKBOOK = {"hash": "语音哈希", "filename": "语音文件名", "character": "角色", "english": "语音文本", "battle": "是否为战斗语音"}


def _voice_name(path: Column) -> Column:
    """The file's name as a WAV: .wem is replaced, a name without an ending gets one."""
    name = basename(F.trim(path))
    return F.when(name == "", "").when(F.rlike(name, F.lit(r"(?i)\.wem$")), F.regexp_replace(name, r"(?i)\.wem$", ".wav")).when(stem(name) == name, F.concat(name, F.lit(".wav"))).otherwise(name)


def read_voice_map(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A JSON object of voice records: ordinal, filename, hash, character, english, source_path, avatar_name.

    Records whose key does not start with ``prefix``, a locale's folder, are dropped
    before they are parsed; the ordinal counts all of them.
    """
    each = read_members(spark, path).filter(F.col("key").startswith(prefix) if prefix else F.lit(True))
    parsed = each.withColumn("r", F.from_json("value", "map<string,string>")).filter("r is not null")
    first = lambda names: F.coalesce(*(F.nullif(F.col("r")[n], F.lit("")) for n in names), F.lit(""))
    named = parsed.select("ordinal", F.trim("key").alias("hash"), *(first(names).alias(f) for f, names in RECORD_FIELDS.items()))
    out = named.select("ordinal", _voice_name(F.col("source_path")).alias("filename"), "hash", F.trim("character").alias("character"), F.trim("english").alias("english"), "source_path", F.trim("avatar_name").alias("avatar_name"))
    return out.filter("filename <> ''")


def only_filenames(records: DataFrame, filenames: DataFrame) -> DataFrame:
    """Records whose file is among those asked for (column filename), whatever the case, in the spelling asked for."""
    asked = filenames.select(F.lower(basename(F.col("filename"))).alias("_want"), basename(F.col("filename")).alias("_as")).groupBy("_want").agg(F.max("_as").alias("_as"))
    return records.join(asked, F.lower("filename") == F.col("_want")).withColumn("filename", F.col("_as")).drop("_want", "_as")


def workbook_voices(sheet: DataFrame, character: str) -> DataFrame:
    """Rows (workbook, ordinal, cells) of a voice workbook whose character holds a name: filename, hash, character, english, battle.

    The run fails on a workbook without one of the four columns.
    """
    needle = character.strip().casefold()
    if not needle:
        raise ValueError("a character is asked for")
    cell = lambda f: F.trim(F.coalesce(F.col("cells")[WORKBOOK[f]], F.lit("")))
    missing = F.array_except(F.array(*(F.lit(WORKBOOK[f]) for f in ("hash", "filename", "character", "english"))), F.map_keys("cells"))
    checked = sheet.withColumn("_role", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))).cast("string")).otherwise(cell("character")))
    name = F.when(F.lower(cell("filename")).endswith(".wav"), cell("filename")).otherwise(F.concat(cell("filename"), F.lit(".wav")))
    return checked.filter(F.contains(F.lower("_role"), F.lit(needle)) & (cell("filename") != "")).select(name.alias("filename"), cell("hash").alias("hash"), F.col("_role").alias("character"), cell("english").alias("english"), cell("battle").alias("battle"))


def candidate_names(spark: SparkSession, path: str) -> DataFrame:
    """WAV names that a file lists: a JSON array or object with entries, a CSV with a file name column, else one in each line of free text."""
    kind = path.rsplit(".", 1)[-1].lower()
    slashed = lambda c: F.translate(c, "\\", "/")
    if kind == "json":
        text = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
        whole = F.when(F.rlike("v", F.lit(r"^\s*\[")), F.col("v")).otherwise(F.get_json_object("v", "$.entries"))
        items = text.select(F.explode(F.from_json(whole, "array<string>")).alias("x"))
        return items.select(F.coalesce(F.get_json_object("x", "$.filename"), "x").alias("name"))
    if kind == "csv":
        rows = read_rows(spark, path)
        held = [c for c in ALIASES["filename"] if c in rows.columns]
        if held:
            name = F.trim(F.col(f"`{held[0]}`"))
            ended = F.when(F.lower(name).endswith(".wav"), name).otherwise(F.concat(name, F.lit(".wav")))
            return rows.filter(name != "").select(slashed(ended).alias("name"))
    lines = spark.read.text(path)
    return lines.select(slashed(F.regexp_extract("value", r"(?iu)[^|\s]+\.wav", 0)).alias("name")).filter("name <> ''")


def read_labs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(member, text) of the LAB files below a folder, and (stem, text) of the stems whose texts agree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[lL][aA][bB]").load(folder)
    text = F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    plain = lambda p: F.regexp_replace(p, "^([a-z]+):/+", "$1:/")
    members = files.select(F.replace(plain(F.col("path")), plain(F.lit(root)), F.lit("")).alias("member"), text.alias("text"))
    single = members.groupBy(stem(F.col("member")).alias("stem")).agg(F.count_distinct("text").alias("n"), F.min("text").alias("text")).filter("n = 1")
    return members, single.select("stem", "text")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """term, target of two glossaries; the overlay wins. Terms with two targets in the overlay are a problem."""
    single = over.groupBy("term").agg(F.min("target").alias("o_target"), F.count_distinct("target").alias("n"))
    joined = base.join(single, "term", "full")
    return joined.select("term", F.coalesce("o_target", "target").alias("target"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("conflict"))


def latest_snapshot(snapshots: DataFrame, url: str, fetched: str, value: str, now: float, fresh: float = 86400, stale: float = 604800) -> DataFrame:
    """The last snapshot of each url with its state: fresh, stale (usable if a fetch fails) or expired."""
    last = snapshots.groupBy(url).agg(F.max_by(value, fetched).alias(value), F.max(fetched).alias(fetched))
    age = F.lit(now) - F.col(fetched)
    return last.withColumn("state", F.when(age <= fresh, "fresh").when(age <= stale, "stale").otherwise("expired"))
