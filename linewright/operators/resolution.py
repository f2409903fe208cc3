"""Which dataset row is a voice's: five ways in order, and annotations by composite keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import basename, stem
from linewright.operators.tables import spread

# The dataset's first folders by locale, the reference locale's folder, prefixes before a voice path, and the ways in order.
FOLDERS = {"en": ("english", "english(us)"), "zh-CN": ("chinese(prc)", "chinese"), "ja": ("japanese", "japanese(jp)"), "ko": ("korean", "korean(kr)")}
REFERENCE_FOLDER, REFERENCE_LOCALE = "chinese(prc)", "zh-CN"
PREFIXES = ("english(us)/", "english/", "chinese(prc)/", "chinese/", "japanese/", "korean/", "en-us/", "zh-cn/", "ja-jp/", "ko-kr/")
WAYS = ("inGameFilename", "inGameFilenameBasename", "wav_hash", "media_id", "media_id", "unique_transcription")
# Emotions, and qualities with the older names they had.
EMOTIONS = ("unmarked", "neutral", "happy", "sad", "angry", "fear", "surprised", "other")
QUALITIES = {"unrated": ("", "unrated"), "A": ("good", "a"), "B": ("ok", "b"), "C": ("poor", "c")}


def voice_path(path: Column) -> Column:
    """A game path without its locale: what follows the first /voice/, else without a known first folder; lower case, empty if null."""
    plain = F.regexp_replace(F.lower(F.trim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))), "^/+", "")
    at = F.instr(F.concat(F.lit("/"), plain), "/voice/")
    bare = plain
    for prefix in reversed(PREFIXES):
        bare = F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 30)).otherwise(bare)
    return F.when(at > 0, F.substr(plain, at + F.lit(6))).otherwise(bare)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def resolve_voices(rows: DataFrame, targets: DataFrame, locale: str = "en", normal: Callable[[Column], Column] | None = None, retry: bool = False) -> DataFrame:
    """Per target file name: status, method, and the dataset row it takes, with the reference locale's row of the same voice.

    ``rows`` have ordinal, key, ingame_filename, transcription, speaker and voice_id,
    ``targets`` filename, hash, english and an order. Only rows in the locale's folders
    count. A row goes to one target: by its game path, by the path's last part, by the
    hash that is its key's stem, or by a media number (its stem, then its voice id) of
    an event recording; of targets that share a key the last in order has it. A target
    takes the first row that came to it. What is still open then takes the row whose
    text is its own, if only one row has that text. A row without a game path that ends
    in .wem does not tell whose voice it is: its target becomes identity_unverified, or
    with ``retry`` takes the first row of those that came to it which does.

    Targets are reduced to one a key before they are joined, so a key that many rows
    or targets share is not multiplied. Rows without any match are left alone. A row
    offers only keys that some target's can be equal to, and keys are joined by
    sorting: a target has up to five, which the sizes that Spark plans by leave out, so
    it would broadcast them all to every task.
    """
    if locale not in FOLDERS:
        raise ValueError(f"no such locale: {locale}")
    if normal is None:
        from linewright.functions.layout import normal_text as normal
    folder = F.lower(F.substring_index("key", "/", 1))
    held = F.struct("ordinal", "key", "speaker", "transcription", "ingame_filename")
    voice = voice_path(F.col("row.ingame_filename"))
    own = rows.filter(folder.isin(*FOLDERS[locale]))
    key_stem, ingame = stem(_text("key")), _text("ingame_filename")
    path, last, number = F.lower(ingame), F.lower(basename(ingame)), "^[0-9]+$"
    keys = [
        F.when(path.endswith(".wem") & path.rlike("^(" + "|".join(map(re.escape, FOLDERS[locale])) + ")/voice/"), path), F.when(last.endswith(".wem"), last), F.lower(key_stem),
        F.when(key_stem.rlike(number), key_stem), F.when(_text("voice_id").rlike(number), _text("voice_id")),
    ]
    offered = own.select(held.alias("row"), F.posexplode(F.array(*keys)).alias("way", "match")).filter("match <> ''")

    targets = spread(targets, "filename")
    name = stem(_text("filename"))
    media = F.when(F.lower(name).startswith("ev_archive_"), F.regexp_extract(name, r"_([0-9]+)$", 1)).otherwise("")
    wem = F.concat(F.lower(name), F.lit(".wem"))
    known = F.array(*(F.struct(F.lit(0).alias("way"), F.concat(F.lit(f"{f}/voice/"), wem).alias("match")) for f in FOLDERS[locale]), *(F.struct(F.lit(k).alias("way"), x.alias("match")) for k, x in ((1, F.lower(F.concat(stem(name), F.lit(".wem")))), (2, F.lower(_text("hash"))), (3, media), (4, media))))
    of_key = targets.select("filename", "order", F.inline(known)).filter("match <> '' and match <> '.wem'").groupBy("way", "match").agg(F.max_by("filename", "order").alias("filename"))
    came = offered.join(of_key.hint("merge"), ["way", "match"]).groupBy("row.ordinal").agg(F.min(F.struct("way", "filename", "row")).alias("x")).select("x.*")
    first = came.filter(voice.endswith(".wem")) if retry else came
    taken = first.groupBy("filename").agg(F.min(F.struct("row.ordinal", "way", "row")).alias("x")).select("filename", "x.way", "x.row")

    wanted = targets.groupBy("filename").agg(F.max_by("english", "order").alias("english"))
    open_ = wanted.join(taken, "filename", "left_anti").select("filename", normal(F.col("english")).alias("said"))
    texts = own.filter(_text("transcription") != "").select(normal(F.col("transcription")).alias("said"), held.alias("row"))
    single = texts.groupBy("said").agg(F.count("*").alias("n"), F.min("row").alias("row")).filter("n = 1")
    by_text = open_.join(single.hint("merge"), "said").select("filename", F.lit(5).alias("way"), "row")
    found = taken.unionByName(by_text).withColumn("voice", voice)

    none = F.lit(None).cast("long")
    if locale == REFERENCE_LOCALE:
        paired = found.withColumn("reference_ordinal", none)
    else:
        reference = rows.filter(folder == REFERENCE_FOLDER).select(voice_path(F.col("ingame_filename")).alias("met"), "ordinal").filter("met <> ''").groupBy("met").agg(F.min("ordinal").alias("reference_ordinal"))
        # rows that tell no voice take no reference below; each has its own key, as they would meet in one task
        met = F.when(F.col("voice").endswith(".wem"), F.col("voice")).otherwise(F.col("filename"))
        paired = found.withColumn("met", met).join(reference.hint("merge"), "met", "left")
    methods = F.array(*map(F.lit, WAYS))
    status = F.when(F.col("row").isNull(), "unresolved").when(F.col("voice").endswith(".wem"), "resolved").otherwise("identity_unverified")
    out = wanted.select("filename").join(paired, "filename", "left").withColumn("status", status)
    kept = lambda c: F.when(F.col("status") == "resolved", c)
    return out.select("filename", "status", F.get(methods, F.col("way")).alias("method"), *(kept(F.col(f"row.{c}")).alias(c) for c in ("ordinal", "key", "speaker", "transcription")), kept(F.col("reference_ordinal")).alias("reference_ordinal"))


def annotation_key(member: Column, logical: Column, number: Column) -> Column:
    """What an annotation is kept under: the member, else the logical id, else the line's number."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    path = F.trim(F.translate(text(member), "\\", "/"))
    return F.when(path != "", F.concat(F.lit("member:"), path)).when(text(logical) != "", F.concat(F.lit("logical:"), text(logical))).otherwise(F.concat(F.lit("id:"), F.coalesce(number.cast("string"), F.lit(""))))


def decorate(entries: DataFrame, annotations: DataFrame, order: str) -> DataFrame:
    """Entries with reference_key, reference_selected, reference_emotion, reference_intensity and reference_quality.

    An entry's own reference_key holds, else one is made of its source_member_id,
    logical_id or id. Annotations have key, selected, emotion, intensity, quality; the
    last in order of a key holds, and a line without one gets the defaults. A quality
    that is none of the known ones stops the run.
    """
    last = annotations.groupBy(F.col("key").alias("annotation_key")).agg(F.max_by(F.struct("selected", "emotion", "intensity", "quality"), order).alias("annotation"))
    own = F.nullif(_text("reference_key"), F.lit("")) if "reference_key" in entries.columns else F.lit(None).cast("string")
    keyed = entries.withColumn("reference_key", F.coalesce(own, annotation_key(F.col("source_member_id"), F.col("logical_id"), F.col("id"))))
    met = keyed.join(last, keyed["reference_key"] == last["annotation_key"], "left")
    return met.select(
        *keyed.columns, F.coalesce(F.col("annotation.selected"), F.lit(False)).alias("reference_selected"), emotion_of(F.col("annotation.emotion")).alias("reference_emotion"),
        F.coalesce(F.col("annotation.intensity").cast("double"), F.lit(0.5)).alias("reference_intensity"), quality_of(F.col("annotation.quality")).alias("reference_quality"),
    )


def emotion_of(value: Column) -> Column:
    """A known emotion, other for an unknown one, unmarked for none."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(plain == "", "unmarked").when(plain.isin(*EMOTIONS), plain).otherwise("other")


def quality_of(value: Column) -> Column:
    """unrated, A, B or C, whatever older name it has; the run fails on any other."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.lit(None).cast("string")
    for new, old in QUALITIES.items():
        known = F.when(plain.isin(*old), new).otherwise(known)
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown quality: "), plain)).cast("string")).otherwise(known)


def reference_catalog(annotations: DataFrame, entries: DataFrame, audio: DataFrame, order: str, least: float = 3.0, most: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejected) of the selected annotations.

    Entries (source_member_id, logical_id, id, filename, source_text and a place) are
    found by the annotation's key, the last of a key; audio (member, seconds) by the
    entry's member, else by its file name. An annotation without an entry is rejected as
    manifest_entry_not_found, one without readable audio as
    audio_unavailable_or_unreadable. The rest are numbered in order; recommended says
    whether the duration is in the band, and nothing outside it is left out.
    """
    from linewright.operators.changes import numbered

    chosen = annotations.filter(F.coalesce(F.col("selected"), F.lit(False)))
    of_key = entries.groupBy(annotation_key(F.col("source_member_id"), F.col("logical_id"), F.col("id")).alias("entry_key")).agg(F.max_by(F.struct("id", "source_member_id", "filename", "source_text"), "place").alias("entry"))
    lengths = audio.groupBy(F.col("member").alias("audio_member")).agg(F.max("seconds").alias("seconds"))
    met = chosen.join(of_key, chosen["key"] == of_key["entry_key"], "left").join(lengths, F.coalesce(F.nullif(F.col("entry.source_member_id"), F.lit("")), "entry.filename") == F.col("audio_member"), "left")
    reason = F.when(F.col("entry").isNull(), "manifest_entry_not_found").when(F.col("seconds").isNull(), "audio_unavailable_or_unreadable")
    judged = met.withColumn("reason", reason)
    rejected = judged.filter("reason is not null").select("key", F.coalesce(F.col("entry.id").cast("string"), F.lit("")).alias("subtitle_id"), "reason", F.coalesce(F.nullif(F.col("entry.source_member_id"), F.lit("")), "entry.filename", F.lit("")).alias("file"))
    kept = judged.filter("reason is null").select(order, "key", F.col("entry.id").cast("string").alias("subtitle_id"), F.col("entry.filename").alias("filename"), F.col("entry.source_text").alias("text"), F.bround("seconds", 3).alias("duration_seconds"), F.col("seconds").between(least, most).alias("recommended"), emotion_of(F.col("emotion")).alias("emotion"), F.coalesce(F.col("intensity").cast("double"), F.lit(0.5)).alias("intensity"), quality_of(F.col("quality")).alias("quality"))
    return numbered(kept, order, "number"), rejected
