"""Sinks: subtitles, training lists, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import MARKUP, ass_clock, clock, width
from linewright.operators.changes import numbered


def stacked(source: Column, target: Column, one_language: bool = False) -> Column:
    """A cue's text: the source over the target; in one language, or where one is blank, only the target or else the source."""
    a, b = F.coalesce(F.trim(source), F.lit("")), F.coalesce(F.trim(target), F.lit(""))
    single = F.when(b != "", b).otherwise(a)
    return single if one_language else F.when((a != "") & (b != ""), F.concat(a, F.lit("\n"), b)).otherwise(single)


def render_srt(lines: DataFrame, archive: str, ordinal: str, text: str, start: Column, end: Column) -> DataFrame:
    """One row an archive: its cues as SRT text. Blank cues are left out before numbering."""
    spoken = lines.withColumn("_a", start).withColumn("_b", end).filter(F.trim(text) != "")
    spoken = spoken.withColumn("_k", F.row_number().over(Window.partitionBy(archive).orderBy(ordinal)))
    block = F.concat(F.col("_k").cast("string"), F.lit("\n"), clock(F.col("_a")), F.lit(" --> "), clock(F.col("_b")), F.lit("\n"), F.col(text), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("_k", block.alias("block"))))
    return spoken.groupBy(archive).agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n").alias("srt"))


def training_list(rows: DataFrame, checks: list[tuple[str, Column]], order: str, speaker: str, language: Column, path: Column, text: Column) -> DataFrame:
    """Add reason (the first failed check, null if accepted), number (1, 2, ... of the accepted rows by a numeric order) and line (path|speaker|language|text)."""
    reason = F.lit(None).cast("string")
    for code, failed in reversed(checks):
        reason = F.when(failed, F.lit(code)).otherwise(reason)
    judged = rows.withColumn("reason", reason).withColumn("line", F.when(F.col("reason").isNull(), F.concat_ws("|", path, F.lit(speaker), language, text)))
    accepted = numbered(judged.filter("reason is null"), order, "number")
    return accepted.unionByName(judged.filter("reason is not null").withColumn("number", F.lit(None).cast("long")))


def write_training_set(judged: DataFrame, folder: str) -> None:
    """Accepted and rejected rows as Parquet, apart in folders by acceptance."""
    judged.withColumn("accepted", F.col("reason").isNull()).write.partitionBy("accepted").mode("overwrite").parquet(folder)


def write_index(rows: DataFrame, folder: str, order: list[str]) -> None:
    """A CSV index with a header in range-sorted files."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(folder)


ASS_HEADER = "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, Alignment\nStyle: Line,Arial,60,2\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"


def ass_text(text: Column, line_feeds: bool = True) -> Column:
    """A text in which nothing reads as markup; line feeds are kept as line breaks, or become spaces too. Null is empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\\{}\r", "\uff0f\uff5b\uff5d ")
    return F.replace(plain, F.lit("\n"), F.lit("\\N" if line_feeds else " "))


#: One visible character with the marks, joiners and variants that belong to it; a word with the spaces after it.
KARAOKE_UNITS = {"character": r"(?s).(?:[\p{M}\x{200C}\x{200D}\x{FE00}-\x{FE0F}\x{1F3FB}-\x{1F3FF}]|(?<=\x{200D}).)*", "word": r"\S+\s*|\s+"}


def _let(value: Column, body) -> Column:
    """Bind an expression, so that it is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tagged(pieces: Column, tag: str) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("{\\" + tag), p["t"].cast("string"), F.lit("}"), p["w"])), "")


def karaoke_aligned(text: Column, duration: Column, words: Column, tag: str = "k") -> Column:
    """A line with the time of each word, array<struct<word,start,end>>, in centiseconds, at least 1.

    The words must make up the text, white space aside, have positive times that do not
    step back by more than 0.02 s, and end at most 0.25 s after the cue; otherwise the
    text stays as it is: no timing is made up.
    """
    squeezed = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    start = F.struct(F.lit(0.0).alias("end"), F.lit(True).alias("fits"))

    def step(acc: Column, w: Column) -> Column:
        a, b = w["start"].cast("double"), w["end"].cast("double")
        fits = (w["word"] != "") & (a >= -0.001) & (b > a) & (a + 0.02 >= acc["end"]) & (b <= duration + 0.25)
        return F.struct(F.coalesce(b, acc["end"]).alias("end"), (acc["fits"] & F.coalesce(fits, F.lit(False))).alias("fits"))

    fits = (duration > 0) & (F.size(words) > 0) & F.aggregate(words, start, step, lambda acc: acc["fits"]) & (squeezed(F.array_join(F.transform(words, lambda w: w["word"]), "")) == squeezed(text))
    pieces = F.transform(words, lambda w: F.struct(F.greatest(F.lit(1).cast("long"), F.bround((w["end"].cast("double") - w["start"].cast("double")) * 100).cast("long")).alias("t"), w["word"].alias("w")))
    return F.when(F.coalesce(fits, F.lit(False)), _tagged(pieces, tag)).otherwise(text)


def karaoke_even(lines: Column, duration: Column, unit: str = "word", tag: str = "k") -> Column:
    """Lines, joined by breaks, with the cue's centiseconds shared evenly over their units; the first ones take what is left over.

    The times add up to the cue, so a unit of a crowded cue may get none. Lines without a unit stay as they are.
    """
    count = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, us: a + F.size(us))
    total = F.greatest(F.lit(0).cast("long"), F.bround(duration * 100).cast("long"))
    plain = F.array_join(lines, "\\N")

    def shared(x: Column) -> Column:
        share = lambda k: F.floor(x["total"] / x["n"]) + (k < x["total"] % x["n"]).cast("long")
        placed = F.transform(x["units"], lambda us, i: F.struct(us.alias("us"), count(F.slice(x["units"], F.lit(1), i)).alias("first")))
        timed = F.transform(placed, lambda line: _tagged(F.transform(line["us"], lambda u, k: F.struct(share(line["first"] + k).alias("t"), u.alias("w"))), tag))
        return F.when(x["n"] > 0, F.array_join(timed, "\\N")).otherwise(plain)

    units = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(KARAOKE_UNITS[unit]), 0))
    return _let(units, lambda us: _let(F.struct(us.alias("units"), count(us).alias("n"), total.alias("total")), shared))


def karaoke_by_width(lines: Column, duration: Column, font_size: float = 42, tag: str = "k") -> Column:
    """Lines with the cue's centiseconds shared over characters by their widths: whole shares, then the largest remainders, first of equals first."""
    hundredth = lambda x: F.greatest(width(x) * font_size, F.lit(1.0)).cast("long")
    pieces = F.flatten(F.transform(lines, lambda x, line: F.transform(F.regexp_extract_all(x, F.lit(KARAOKE_UNITS["character"]), 0), lambda u: F.struct(u.alias("w"), hundredth(u).alias("size"), line.alias("line")))))
    cs = F.greatest(F.lit(0).cast("long"), F.bround(duration * 100).cast("long"))
    summed = lambda xs, name: F.aggregate(xs, F.lit(0).cast("long"), lambda a, p: a + p[name])

    def shared(x: Column) -> Column:
        return F.transform(x["pieces"], lambda p, k: F.struct((-(p["size"] * x["cs"] % x["whole"])).alias("rest"), k.alias("k"), F.floor(p["size"] * x["cs"] / x["whole"]).alias("t"), p["w"].alias("w"), p["line"].alias("line")))

    def placed(x: Column) -> Column:
        ranked = F.transform(F.array_sort(x["quota"]), lambda q, r: F.struct(q["k"].alias("k"), (q["t"] + (r < x["left"]).cast("long")).alias("t"), q["w"].alias("w"), q["line"].alias("line")))
        return _let(F.array_sort(ranked), lambda p: F.array_join(F.transform(lines, lambda _, line: _tagged(F.filter(p, lambda y: y["line"] == line), tag)), "\\N"))

    def timed(ps: Column) -> Column:
        quota = _let(F.struct(ps.alias("pieces"), summed(ps, "size").alias("whole"), cs.alias("cs")), shared)
        rest = lambda q: F.struct(q.alias("quota"), (cs - summed(q, "t")).alias("left"))
        return F.when(F.size(ps) > 0, _let(quota, lambda q: _let(rest(q), placed))).otherwise(F.array_join(lines, "\\N"))

    return _let(pieces, timed)


def overflow_problem(lines: Column, most: float, font_size: float, most_lines: int = 2) -> Column:
    """Why a cue's lines do not fit the picture: too_many_lines, too_wide, else null."""
    wide = F.exists(lines, lambda x: width(F.regexp_replace(x, MARKUP, "")) * font_size / 100 > most)
    return F.when(F.size(lines) > most_lines, "too_many_lines").when(wide, "too_wide")


def overflow_report(cues: DataFrame, key: list[str], lines: str, most: float, font_size: float, most_lines: int = 2) -> DataFrame:
    """The cues that do not fit: key, problem, lines and the widest line's pixels."""
    widest = F.array_max(F.transform(lines, lambda x: width(F.regexp_replace(x, MARKUP, "")) * font_size / 100))
    return cues.withColumn("problem", overflow_problem(F.col(lines), most, font_size, most_lines)).filter("problem is not null").select(*key, "problem", F.size(lines).alias("n_lines"), widest.alias("widest"))


def render_ass(lines: DataFrame, archive: str, ordinal: str, broken: Column, start: Column, end: Column, fade_in: Column, fade_out: Column, body: Column | None = None, problem: Column | None = None) -> DataFrame:
    """One row an archive: its cues as ASS text. ``broken`` is an array of lines; fades are milliseconds outside the voice.

    ``body`` is the marked text if it is not just the lines (karaoke). A cue with a
    ``problem`` (``overflow_problem``) stops the run: nothing is rendered that does not fit.
    """
    shown = F.array_join(F.transform(broken, lambda x: ass_text(x)), "\\N") if body is None else body
    if problem is not None:
        shown = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("rendering blocked, see the overflow report: "), F.col(ordinal).cast("string"), F.lit(" "), problem)).cast("string")).otherwise(shown)
    cue = F.concat(
        F.lit("Dialogue: 0,"), ass_clock(F.greatest(F.lit(0.0), start - fade_in / 1000)), F.lit(","), ass_clock(end + fade_out / 1000), F.lit(",Line,{\\fad("),
        fade_in.cast("string"), F.lit(","), fade_out.cast("string"), F.lit(")}"), shown,
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), cue.alias("cue"))))
    spoken = lines.filter(F.size(broken) > 0)
    return spoken.groupBy(archive).agg(F.concat(F.lit(ASS_HEADER), F.array_join(F.transform(listed, lambda x: x["cue"]), "\n"), F.lit("\n")).alias("ass"))


def reference_pack(lines: DataFrame, key: str, selected: Column, duration: Column, order: list[str], least: float = 3.0, most: float = 10.0) -> DataFrame:
    """Selected lines with in_band (the duration fits) and, for those that do, number 1, 2, ... in each group."""
    chosen = lines.filter(selected).withColumn("in_band", F.coalesce(duration.between(least, most), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(key, "in_band").orderBy(*order))
    return chosen.withColumn("number", F.when(F.col("in_band"), place.cast("long")))


def review_block(line_id: Column, source: Column, target: Column) -> Column:
    """A line's block of a review file; the hash ties an answer to the source it was given for."""
    return F.concat(F.lit("[["), line_id.cast("string"), F.lit(" "), F.sha2(source, 256), F.lit("]]\nSOURCE: "), F.replace(source, F.lit("\n"), F.lit(" ")), F.lit("\nTARGET: "), F.replace(target, F.lit("\n"), F.lit(" ")), F.lit("\n"))


def read_review(blocks: DataFrame, text: str) -> DataFrame:
    """line_id, source_hash, target of the blocks in a text column."""
    grammar = r"\[\[(\S+) ([0-9a-f]{64})\]\]\nSOURCE: [^\n]*\nTARGET: ([^\n]*)"
    found = blocks.select(F.explode(F.regexp_extract_all(text, F.lit(grammar), 0)).alias("block"))
    return found.select(F.regexp_extract("block", grammar, 1).alias("line_id"), F.regexp_extract("block", grammar, 2).alias("source_hash"), F.regexp_extract("block", grammar, 3).alias("target"))


def import_review(lines: DataFrame, answers: DataFrame, line_id: str, source: str) -> DataFrame:
    """line_id, target, outcome of imported answers: ok, stale (given for another source), blank or unknown."""
    held = lines.select(F.col(line_id).cast("string").alias("_l"), F.sha2(F.coalesce(F.col(source), F.lit("")), 256).alias("_h"))
    met = answers.join(held, F.col("line_id") == F.col("_l"), "left")
    outcome = F.when(F.col("_l").isNull(), "unknown").when(F.col("_h") != F.col("source_hash"), "stale").when(F.trim("target") == "", "blank").otherwise("ok")
    return met.select("line_id", "target", outcome.alias("outcome"))


def recovery_package(files: DataFrame, name: str, content: str) -> DataFrame:
    """name, sha256 and base64 of each file: a package that text channels carry."""
    return files.select(name, F.sha2(content, 256).alias("sha256"), F.base64(content).alias("data"))


def recovered(package: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(files whose content has its recorded hash, names of the others)."""
    opened = package.withColumn("content", F.try_to_binary("data", F.lit("base64")))
    right = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    return opened.filter(right).select(name, "content"), opened.filter(~right).select(name)
