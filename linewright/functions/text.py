"""Column functions on names and texts of lines. Blank and null are alike: ``blank`` turns both into null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archives' naming scheme and of its checks: patterns of group names, variants, markup and risk words,
# numerals by the number they write, package kinds and terms.
ANECDOTE = r"(?i)^anecdote_([0-9]+)(?:_|$)"
ARCHIVE = r"(?i)^(archive)(?:_|$)"
FINALITY = r"(?i)^(chapterfinality[0-9]*|finality)(?:_|$)"
CHAPTER = r"(?i)^(chapter[0-9]+)(?:_([0-9]+))?(?:_|$)"
COMPANION = r"(?i)^(companion[0-9]*)(?:_([0-9]+))?(?:_|$)"
SIDE = r"(?i)^(side(?:[0-9]+|x)?)(?:_|$)"
VOICE_ANECDOTE = r"(?i)^vo_anecdote_([0-9]+)_[a-z0-9]+_[0-9]+$"
FAMILY_HINT = r"(?i)^(?:archive(?:_vo_avatar)?|chapter[0-9]+(?:_[0-9]+)?|companion[0-9]+(?:_[0-9]+)?|side[0-9]+(?:_[A-Za-z0-9_]+)?)_"
KINDS = ("genshin-impact", "honkai-star-rail", "generic")
SAMPLE_TERMS = ("aeon", "stellaron", "path", "elation", "nameless", "stellar jade", "planarcadia", "phantasmoon", "wishpower", "fulwish", "supplicant", "graphia", "yao guang", "evanescia", "ambrosial arbor")
VARIANT_PATTERN = r"(?i)^(.*)_([fm])$"
MARKUP = r"<[^>]+>|\{[^}]+\}"
EXPRESSIVE = r"(?i)\.\.\.|[!?~—]|\b(?:don't|isn't|aren't|can't|won't|wouldn't|couldn't|shouldn't)\b"
NEGATION = r"(?i)\b(?:not|never|no|none|nothing|nobody|neither|nor|without|cannot|can't|won't|don't|doesn't|didn't|isn't|aren't|wasn't|weren't|shouldn't|wouldn't|couldn't|mustn't|hasn't|haven't|hadn't)\b"
QUANTITY = r"(?i)(?:^|[^A-Za-z])(?:[0-9]+(?:\.[0-9]+)?%?|zero|one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|half|double|twice|both|all|every|each|few|several|many|much|more|less|fewer|most|least|only)\b"
CONDITION = r"(?i)\b(?:if|unless|provided that|as long as|in case|otherwise|whether|when|whenever|until|once)\b"
PERSONS = (
    r"(?i)(?:^|[^A-Za-z])(?:i|me|my|mine|myself|we|us|our|ours|ourselves)(?:$|[^A-Za-z])",
    r"(?i)(?:^|[^A-Za-z])(?:you|your|yours|yourself|yourselves)(?:$|[^A-Za-z])",
    r"(?i)(?:^|[^A-Za-z])(?:he|him|his|himself|she|her|hers|herself|they|them|their|theirs|themselves)(?:$|[^A-Za-z])",
)
NUMERALS = {0: "零〇", 1: "一壹", 2: "二两兩貳", 3: "三", 4: "四", 5: "五", 6: "六", 7: "七", 8: "八", 9: "九", 10: "十"}
NEGATION_ZH = "不|没|無|无|未|别|別|非|勿|莫|甭|缺乏|免得"
NEGATION_JA, NEGATION_KO = "ない|ません|ぬ|ず|なく|できない", "않|없|못|아니|말고"
PARTICLES_ZH = "吗|嗎|呢|么|麼|吧|谁|誰|什么|什麼"
ANY_BOUND, ASCII_BOUND = (rf"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))" for w in (r"\p{L}\p{M}\p{N}_", "0-9A-Za-z_"))
WIDTHS = (("iI1l!|;,.'\"", 35), ("fjt()[]{}", 45), ("mwMW@#%&", 80))


def strip(x: Column) -> Column:
    """Without white space at both ends, ideographic space included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first non-blank value, row by row; an empty string if there is none."""
    return F.coalesce(*(blank(c) for c in columns), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def bare(name: Column) -> Column:
    """A stem without the technical prefixes ev_ and vo_, however many."""
    return F.regexp_replace(name, "(?i)^(?:(?:ev|vo)_)+", "")


def logical_id(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, VARIANT_PATTERN, 1), F.lit("")), name)


def variant(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, VARIANT_PATTERN, 2))


def _let(value: Column, body) -> Column:
    """Bind an expression, so that it is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def known_group(name: Column) -> Column:
    """struct(group, major) of a name that follows one of six naming schemes, else null."""
    return _let(name, _known_group)


def _known_group(name: Column) -> Column:
    said = lambda pattern, k: F.lower(F.regexp_extract(name, pattern, k))
    whole = lambda group, major: F.struct(group.alias("group"), major.alias("major"))

    def family(pattern: str, sections: bool = False, prefix: str = "") -> Column:
        major = F.concat(F.lit(prefix), said(pattern, 1))
        section = said(pattern, 2) if sections else F.lit("")
        group = F.concat(major, F.when(section != "", F.concat(F.lit("_"), section)).otherwise(""))
        return F.when(said(pattern, 1) != "", whole(group, major))

    return F.coalesce(family(ANECDOTE, prefix="anecdote_"), family(ARCHIVE), family(FINALITY), family(CHAPTER, True), family(COMPANION, True), family(SIDE))


def inferred_group(name: Column) -> Column:
    """The group that a stem tells, else what stands before its first underscore."""
    own = F.coalesce(known_group(F.when(F.rlike(name, F.lit(VOICE_ANECDOTE)), F.substring(name, 4, 1 << 30))), known_group(bare(name)))
    return F.coalesce(own["group"], F.substring_index(name, "_", 1))


def classify_group(member: Column, declared: Column) -> Column:
    """struct(group, major, confidence, method) by the first evidence that holds.

    A file name or a declared group that follows a scheme confirms a group; a
    folder of the path, nearest first, or a group of its own name suggests one.
    """
    given = F.struct(stem(member).alias("name"), F.coalesce(blank(declared), F.lit("")).alias("said"), member.alias("member"))
    return _let(given, lambda x: _classified(x["name"], x["said"], x["member"]))


def _classified(name: Column, said: Column, member: Column) -> Column:
    steps = F.split(F.translate(member, "\\", "/"), "/")
    folders = F.reverse(F.slice(steps, 1, F.size(steps) - 1))
    folder = F.get(F.filter(F.transform(folders, lambda p: known_group(bare(p))), lambda g: g.isNotNull()), F.lit(0))
    voice, own, told = known_group(F.when(F.rlike(name, F.lit(VOICE_ANECDOTE)), F.substring(name, 4, 1 << 30))), known_group(bare(name)), known_group(bare(said))
    custom = (said != "") & (F.lower(said) != "unknown") & (F.lower(said) != F.lower(inferred_group(name)))
    found = lambda g, confidence, method: F.struct(g["group"].alias("group"), g["major"].alias("major"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    explicit = F.struct(F.lower(said).alias("group"), F.lower(said).alias("major"), F.lit("inferred").alias("confidence"), F.lit("explicit_index_group").alias("method"))
    unknown = F.struct(F.lit("").alias("group"), F.lit("").alias("major"), F.lit("unknown").alias("confidence"), F.lit("unrecognized").alias("method"))
    # the first evidence that is there; later ones are not looked for
    known = lambda g, confidence, method: _let(g, lambda x: F.when(x.isNotNull(), found(x, confidence, method)))
    return F.coalesce(
        known(voice, "confirmed", "genshin_filename_schema"),
        known(own, "confirmed", "filename_schema"),
        known(told, "confirmed", "declared_group_schema"),
        known(folder, "inferred", "package_path"),
        F.when(custom, explicit),
        unknown,
    )


def chapter_rank(major: Column) -> Column:
    """struct(rank, number, name): archive, chapters, finality, companions, side stories, other groups, unknown ones last."""
    return _let(F.lower(F.coalesce(major, F.lit(""))), _ranked_chapter)


def _ranked_chapter(name: Column) -> Column:
    number = lambda pattern, default: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(default).cast("long"))
    place = lambda rank, n=F.lit(0): F.struct(F.lit(rank).alias("rank"), n.cast("long").alias("number"), name.alias("name"))
    return (
        F.when(name == "", place(6))
        .when(name == "archive", place(0))
        .when(F.rlike(name, F.lit("^chapter[0-9]+$")), place(1, number("^chapter([0-9]+)$", 0)))
        .when(F.contains(name, F.lit("finality")), place(2))
        .when(F.rlike(name, F.lit("^companion[0-9]*$")), place(3, number("^companion([0-9]*)$", 0)))
        .when(F.rlike(name, F.lit("^side[A-Za-z0-9_]*$")), place(4, number("^side([0-9]+)$", 999)))
        .otherwise(place(5))
    )


def compacted(text: Column) -> Column:
    """Lower-cased letters and digits only: what a tolerant search compares."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]", "")


def cross_key(path: Column) -> Column:
    """Key of a line across languages: group and numeric tail, else numeric id, else bare stem."""
    name = F.lower(stem(path))
    group = F.regexp_extract(name, r"^(?:vo_)?([a-z]+[0-9]*(?:_[0-9]+)?)_.*?_?([0-9]+(?:_[fm])?)$", 1)
    tail = F.regexp_extract(name, r"^(?:vo_)?([a-z]+[0-9]*(?:_[0-9]+)?)_.*?_?([0-9]+(?:_[fm])?)$", 2)
    number = F.regexp_extract(name, r"^(?:vo_)?([0-9]+(?:_[0-9]+)*(?:_[fm])?)$", 1)
    return F.when(number != "", F.concat(F.lit("id::"), number)).when(group != "", F.concat_ws("::", group, tail)).otherwise(F.regexp_replace(name, "^vo_", ""))


def unsafe_path(path: Column) -> Column:
    """Absolute, climbing out, or on a drive."""
    return F.rlike(F.translate(path, "\\", "/"), F.lit(r"^/|(^|/)\.\.(/|$)|^[^/]*:"))


def visible(text: Column) -> Column:
    return strip(F.regexp_replace(text, MARKUP, ""))


def markup_signature(text: Column) -> Column:
    """Sorted markup tokens; a brace token with a # counts by what stands before it."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(MARKUP), 0), lambda t: F.regexp_replace(t, r"^(\{[^#}]*#)[^}]*\}$", "$1}")))


def issue(condition: Column, code: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def translation_issues(source: Column, target: Column, terms: dict[str, str] | None = None, target_language: str = "zh-CN") -> Column:
    """Array of (code, severity) in the order of the checks."""
    n, m = F.length(visible(source)), F.length(visible(target))
    found = [issue(markup_signature(source) != markup_signature(target), "format_tokens", "major")]
    found += [issue(F.contains(F.lower(source), F.lit(a.lower())) & ~F.contains(target, F.lit(b)), "terminology", "major") for a, b in (terms or {}).items()]
    if target_language.lower().startswith("zh"):
        found.append(issue(F.rlike(F.regexp_replace(target, MARKUP, ""), F.lit("[A-Za-z]{5,}")), "english_residue", "minor"))
    found.append(issue((n >= 20) & (m <= F.greatest(F.lit(1), F.floor(n * 5 / 100))), "too_short", "major"))
    found.append(issue((n >= 20) & (m * 2 >= n * 5), "too_long", "minor"))
    return F.array_compact(F.array(*found))


def hard(issues: Column) -> Column:
    return F.exists(issues, lambda x: x["severity"].isin("major", "critical"))


def numbers(text: Column) -> Column:
    """Numbers that follow neither a word character nor a dot."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|[^\w.])([0-9]+(?:\.[0-9]+)?)"), 1)


def number_present(value: Column, text: Column) -> Column:
    """The number's digits, or a numeral of 0 to 10, stand in the text."""
    forms = F.lit(False)
    for n, chars in NUMERALS.items():
        forms = forms | ((value == str(n)) & F.rlike(text, F.lit(f"[{chars}]")))
    return F.contains(text, value) | forms


def word_bounds(pattern: str, ascii_words: bool) -> str:
    r"""A pattern whose \b holds between ASCII word characters and all others, if asked; else letters of any script are word characters.

    Java's own \b is the one or the other by its version.
    """
    return pattern.replace(r"\b", ASCII_BOUND if ascii_words else ANY_BOUND)


def has_negation(text: Column, language: str = "en", ascii_words: bool = False) -> Column:
    """An explicit negation; languages other than these four have none."""
    patterns = {"en": NEGATION, "zh": NEGATION_ZH, "ja": NEGATION_JA, "ko": NEGATION_KO}
    return F.rlike(text, F.lit(word_bounds(next((p for k, p in patterns.items() if language.lower().startswith(k)), "(?!)"), ascii_words)))


def alignment_signals(source: Column, official: Column, terms: dict[str, str] | None = None, source_language: str = "en", target_language: str = "zh-CN", ascii_words: bool = False) -> Column:
    """Array of (code, severity) of what a localisation may not or hardly change."""
    a, b = visible(source), visible(official)
    lost = F.exists(numbers(a), lambda x: ~number_present(x, b)) | F.exists(numbers(b), lambda x: ~number_present(x, a))
    said, answered = has_negation(a, source_language, ascii_words), has_negation(b, target_language, ascii_words)
    n, m = F.length(a), F.length(b)
    found = [
        issue(markup_signature(source) != markup_signature(official), "placeholder_mismatch", "high"),
        issue(lost, "numeric_conflict", "high"),
        issue(said & ~answered, "negation_dropped", "high"),
        issue(answered & ~said, "negation_added", "low"),
        *(issue(F.contains(F.lower(a), F.lit(x.lower())) & ~F.contains(b, F.lit(y)), "terminology_missing", "low") for x, y in (terms or {}).items()),
        issue(F.rlike(a, F.lit("[?？]$")) & ~F.rlike(b, F.lit(f"[?？]$|{PARTICLES_ZH}")), "sentence_type_shift", "low"),
        issue((n >= 20) & ((m <= F.greatest(F.lit(1), F.bround(n * 12 / 100).cast("int"))) | (m * 10 >= n * 16)), "length_anomaly", "low"),
    ]
    empty = F.array(F.struct(F.lit("empty_official").alias("code"), F.lit("high").alias("severity")))
    return F.when(F.length(strip(official)) == 0, empty).when(F.length(strip(source)) == 0, F.array().cast("array<struct<code:string,severity:string>>")).otherwise(F.array_compact(F.array(*found)))


def alignment_zone(signals: Column) -> Column:
    return F.when(F.exists(signals, lambda x: x["severity"] == "high"), "red").when(F.size(signals) > 0, "yellow").otherwise("green")


def risk_tags(text: Column, ascii_words: bool = False) -> Column:
    """Negation, quantity, condition, and person where two grammatical persons meet."""
    persons = reduce(lambda a, b: a + b, (F.rlike(text, F.lit(p)).cast("int") for p in PERSONS))
    return F.array_compact(F.array(*(F.when(c, F.lit(tag)) for tag, c in (("negation", has_negation(text, ascii_words=ascii_words)), ("quantity", F.rlike(text, F.lit(word_bounds(QUANTITY, ascii_words)))), ("condition", F.rlike(text, F.lit(word_bounds(CONDITION, ascii_words)))), ("person", persons >= 2)))))


def sample_category(text: Column, terms: tuple[str, ...] = SAMPLE_TERMS, ascii_words: bool = False) -> Column:
    """Class of a line for a balanced sample; the first that fits."""
    term = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t)) for t in terms), F.lit(False))
    return (
        F.when(F.rlike(text, F.lit(f"(?i){MARKUP}|RUBY")), "tags_placeholders")
        .when(term, "hsr_terminology")
        .when(F.length(text) >= 140, "long_complex")
        .when(F.length(text) <= 45, "short_context_sensitive")
        .when(F.rlike(text, F.lit(word_bounds(EXPRESSIVE, ascii_words))), "expressive_dialogue")
        .otherwise("general")
    )


def clock(seconds: Column, comma: str = ",") -> Column:
    """HH:MM:SS,mmm with half-even rounding."""
    ms = F.bround(seconds * 1000).cast("long")
    part = lambda div, mod: F.floor(ms / div) % mod
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000)


def ass_clock(seconds: Column) -> Column:
    """H:MM:SS.cc with half-even rounding."""
    cs = F.bround(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def width(text: Column) -> Column:
    """Hundredths of the font size that a text takes: wide scripts 100, classes of letters less."""
    wide = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}"
    count = lambda p: F.regexp_count(text, F.lit(p))
    classes = {35: r"[iI1l!|;,.'\"]", 45: r"[fjt()\[\]{}]", 80: "[mwMW@#%&]"}
    special = {100: count(f"[{wide}]"), 30: count(" "), **{w: count(p) for w, p in classes.items()}}
    upper = count(rf"[\p{{Lu}}&&[^IMW{wide}]]")  # wide scripts have capitals too
    rest = F.length(text) - upper - reduce(lambda a, b: a + b, special.values())
    return (reduce(lambda a, b: a + b, (n * w for w, n in special.items())) + upper * 65 + rest * 52).cast("long")


def natural_key(path: Column) -> Column:
    """Sort key in which chapter2 precedes chapter10."""
    parts = F.regexp_extract_all(F.lower(path), F.lit("([^0-9]+|[0-9]+)"), 0)
    return F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.struct(F.lit("").alias("s"), p.cast("decimal(38,0)").alias("n"))).otherwise(F.struct(p.alias("s"), F.lit(0).cast("decimal(38,0)").alias("n"))))


def slug(name: Column, most: int = 96) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), r"^[_.]+|[_.]+$", ""), F.lit(most))


def seconds_of(part: Column) -> Column:
    """Seconds of H:M:S, M:S or a plain number; null if it is none of them."""
    pieces = F.split(strip(part), ":")
    number = lambda k: F.get(pieces, F.lit(k)).try_cast("double")
    return F.when(F.size(pieces) == 1, number(0)).when(F.size(pieces) == 2, number(0) * 60 + number(1)).when(F.size(pieces) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def time_range(text: Column) -> Column:
    """struct(start, end) of two times with a dash of any kind between them, else nulls."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "--|[—–~]", "-"), "-"), strip), lambda p: p != "")
    both = F.size(parts) == 2
    return F.struct(F.when(both, seconds_of(F.get(parts, F.lit(0)))).alias("start"), F.when(both, seconds_of(F.get(parts, F.lit(1)))).alias("end"))


def locale_problem(declared: Column, path: Column, expected: str, labels: dict[str, str], wanted_path: Column) -> Column:
    """Why a fetched row cannot be the wanted line, null if it can.

    The declared locale and a locale folder that leads the path must both be the
    expected one, at least one of them must be there, and what follows the
    locale folder must be the wanted path.
    """
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    plain = lambda p: F.lower(F.translate(F.coalesce(p, F.lit("")), "\\", "/"))
    said, folder = F.coalesce(blank(F.lower(declared)), F.lit("")), F.substring_index(plain(path), "/", 1)
    told, led = F.when(said != "", F.coalesce(known[said], said)), known[folder]
    rest = lambda p: F.when(known[F.substring_index(plain(p), "/", 1)].isNotNull(), F.regexp_replace(plain(p), "^[^/]*/", "")).otherwise(plain(p))
    return F.when(told != expected, "declared_locale").when(led != expected, "path_locale").when(told.isNull() & led.isNull(), "no_locale").when((rest(path) == "") | (rest(wanted_path) == ""), "no_identity").when(rest(path) != rest(wanted_path), "other_line")


def reconciled(confidence: Column, dominance: Column, matched: Column, total: Column) -> Column:
    """The higher of a present confidence and that of index evidence: min(dominance, coverage) at 0.75 and 0.40."""
    evidence = F.least(dominance, matched / F.greatest(total, F.lit(1)))
    found = F.when(evidence >= 0.75, 3).when(evidence >= 0.40, 2).otherwise(1)
    rank = F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)
    names = F.array(*map(F.lit, ("none", "low", "medium", "high")))
    return F.when(matched <= 0, F.get(names, rank)).otherwise(F.get(names, F.greatest(found, rank)))


def review_gate(zone: Column, revised: Column, issues: Column) -> Column:
    """What becomes of an official text: adopted if green, revised if a revision passes its checks, else for review."""
    return F.when(zone == "green", "adopted").when(blank(revised).isNotNull() & ~F.coalesce(hard(issues), F.lit(False)), "revised").otherwise("review")


def canonical_json(names: list[str]) -> Column:
    """Columns as JSON with sorted keys, no spaces, and nulls written."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def bare_hash(text: Column) -> Column:
    """SHA-256 of a text without its white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""), 256)
