"""Secret scans: fixed patterns, and a battery of randomness tests.

Candidates are runs of letters, digits and ``+/_-`` of 20 characters or more, long
ones in even pieces of 128 to 255, in which an encoding can be inferred:
hexadecimal, base32, digits with letters of one case, base64, or letters alone. Three
tests look for signs that a candidate is not random: chi-squared uniformity of its
alphabet (in cells of at least five expected symbols, letters in the order of their
frequency in texts, where texts crowd the first cells), the number of runs of
characters of one kind (digits, upper, lower case; in letters of one case vowels and
consonants) against its mean and variance at random, and serial correlation; outside
hexadecimal, where letters are no text's, a second chi-squared test compares vowels
and consonants alone. Fisher's method combines the p-values to the candidate's.

What is reported must look random where ordinary strings do not. The null is a model
of ordinary strings: the plain words of texts with candidates (a list of common ones
where a text has none), joined, half of them with a digit after every third and half
cut short with numbers after every second, for hexadecimal as dumps of their bytes and
zero-padded numbers, and cut to the candidates' lengths, go through the same battery. A candidate's q is the share of
those of its encoding and length class that look as random, and Benjamini and
Hochberg's procedure at ``RATE`` on the q of a class bounds the share of ordinary
strings among its reported spans: short classes, in which the tests tell little,
report less. A candidate that the battery itself rejects at ``LEAST_P`` is never
reported. Both distributions are histograms of a few hundred bins a class, so only
bounded counts are gathered. Reported pieces that touch make one span.

Only built-in expressions and aggregates run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import apart, columns_of, let, settle

#: The contract's patterns, least lengths, and their order.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]+"
LEAST_CANDIDATE, PIECE = 20, 128
RATE, LEAST_P = 0.05, 0.001
#: Ordinary strings made for each class of each text that has candidates.
ORDINARY = 20
#: Bins of -20 log10(p); the last random enough to be reported.
BINS, LAST_BIN = 400, 60
#: A word of letters that stands alone and is no candidate itself.
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{1,19}(?![A-Za-z0-9+/_-])"
#: Letters: vowels, then consonants, each by their frequency in texts.
LETTERS = "eaoiutnsrhldcmfgpwybvkxjqz"
DIGITS, CAPITALS = "0123456789", LETTERS.upper()
#: encoding -> its alphabet, texts' characters of a kind first, and how many symbols each of its kinds has.
ALPHABETS = {
    "hex": (DIGITS + "abcdef", (10, 6)),
    "hex_upper": (DIGITS + "ABCDEF", (10, 6)),
    "base32": (CAPITALS + "234567", (26, 6)),
    "lower36": (DIGITS + LETTERS, (10, 26)),
    "upper36": (DIGITS + CAPITALS, (10, 26)),
    "base64": (DIGITS + CAPITALS + LETTERS + "+/", (10, 26, 26, 2)),
    "lower26": (LETTERS, (5, 21)),
    "upper26": (CAPITALS, (5, 21)),
    "mixed52": (CAPITALS + LETTERS, (26, 26)),
}
#: Words of ordinary strings where a text has none.
COMMON = "the value of this setting name and index file path from server user data list item time order number first last current default result message table column state type size count start end with all other for new old main test config version update read write open close view page text line word part group key code".split()
#: What stands for 0, 1, 8 and 9 in ordinary strings of base32.
AS_BASE32 = ("0189", "2345")
SPAN = "struct<start:long,end:long,hit:string>"


def spans(text: Column, pattern: str, least: int, group: int = 0, filter_pattern: str | None = None) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    Positions come from the lengths of the matches and of the texts between them.
    Texts in which nothing long enough can match skip the scan.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(parts: Column) -> Column:
        steps = F.transform(parts["hits"], lambda hit, i: F.struct(F.char_length(F.get(parts["gaps"], i)).cast("long").alias("gap"), F.char_length(hit).cast("long").alias("n"), hit.alias("hit")))
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["gap"]
            part = F.char_length(F.regexp_extract(x["hit"], pattern, group)) if group else x["n"]
            here = F.when(part >= least, F.array(F.struct(first.alias("start"), (first + x["n"]).alias("end"), x["hit"].alias("hit")))).otherwise(none)
            return F.struct((first + x["n"]).alias("at"), F.when(part >= least, F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(steps, start, step, lambda acc: acc["found"])

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    return F.when(text.rlike(filter_pattern or pattern), let(parts, placed)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by a logistic fit of the normal distribution; exact to about 0.0002."""
    x = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x))


def encoding(token: Column) -> Column:
    has = lambda p: F.rlike(token, F.lit(p))
    return (
        F.when(~has("[A-Za-z]"), None)
        .when(~has("[0-9]"), F.when(has("^[a-z]+$"), "lower26").when(has("^[A-Z]+$"), "upper26").when(has("^[A-Za-z]+$"), "mixed52"))
        .when(has("^[0-9a-f]+$"), "hex")
        .when(has("^[0-9A-F]+$"), "hex_upper")
        .when(has("^[A-Z2-7]+$"), "base32")
        .when(has("^[0-9a-z]+$"), "lower36")
        .when(has("^[0-9A-Z]+$"), "upper36")
        .when(has("[A-Z]") & has("[a-z]"), "base64")
    )


def runs_of(token: Column, kind: Column) -> Column:
    """How many runs of characters of one kind a token has."""
    cases = F.translate(token, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "0" * 10 + "A" * 26 + "a" * 26 + "+" * 4)
    vowels = F.translate(F.lower(token), "aeioubcdfghjklmnpqrstvwxyz", "0" * 5 + "1" * 21)
    return F.regexp_count(F.when(kind.isin("lower26", "upper26"), vowels).otherwise(cases), F.lit(r"(.)\1*"))


def battery(token: Column, kind: Column) -> Column:
    """p-value of a token against randomness over its encoding's alphabet, never null.

    The encoding is a column, so one expression serves all of them.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    of_kind = lambda make: F.element_at(F.create_map(*(F.lit(x) for name, (alphabet, kinds) in ALPHABETS.items() for x in (name, make(alphabet, kinds)))), kind)
    power = lambda e: of_kind(lambda alphabet, kinds: float(sum((k / len(alphabet)) ** e for k in kinds)))

    def of(x: Column) -> Column:
        n, size = F.size(x["v"]).cast("double"), x["size"]
        cells = F.least(size, F.greatest(F.lit(2.0), F.floor(n / 5).cast("double")))
        known = F.struct(x["v"].alias("v"), size.alias("size"), n.alias("n"), cells.alias("cells"), (total(x["v"]) / n).alias("mean"), *(x[k].alias(k) for k in ("runs", "a", "b", "letters", "vowels")))
        return let(known, tests)

    def tests(x: Column) -> Column:
        v, size, n, cells, mean, runs, a, b, letters, vowels = (x[k] for k in ("v", "size", "n", "cells", "mean", "runs", "a", "b", "letters", "vowels"))
        # cells need not hold equally many symbols, so each has its own expectation
        wide = lambda k: F.ceil((k + 1) * size / cells) - F.ceil(k * size / cells)
        held = lambda k: F.size(F.filter(v, lambda y: F.floor(y * cells / size) == k))
        counts = F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), lambda k: F.struct((wide(k) * n / size).cast("double").alias("e"), held(k).cast("double").alias("o")))
        chi, df = total(F.transform(counts, lambda c: (c["o"] - c["e"]) * (c["o"] - c["e"]) / c["e"])), cells - 1
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        # a and b: chances that two and that three characters are of one kind
        z_runs = (runs - 1 - (n - 1) * (1 - a)) / F.sqrt((n - 1) * a * (1 - a) + 2 * (n - 2) * (b - a * a))
        var = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        lag = total(F.transform(v, lambda y, i: F.when(i > 0, (y - mean) * (F.get(v, i - 1) - mean)).otherwise(0.0)))
        z_serial = F.when(var > 0, lag / var * F.sqrt(n)).otherwise(30.0)
        z_vowels = (vowels - letters * 5 / 26) / F.sqrt(letters * 105 / 676)
        two_sided = lambda z: F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))
        ps = F.array(_normal_tail(z_chi), two_sided(z_runs), two_sided(z_serial), F.when(letters > 0, two_sided(z_vowels)))
        return let(F.struct(total(F.transform(F.filter(ps, lambda p: p.isNotNull()), lambda p: -F.log(F.greatest(p, F.lit(1e-30))))).alias("x"), letters.alias("letters")), fisher)

    def fisher(f: Column) -> Column:
        """The upper tail of chi-squared at twice x, with two degrees of freedom for each p-value: three, or four."""
        x = f["x"]
        return F.exp(-x) * (1 + x + x * x / 2 + F.when(f["letters"] > 0, x * x * x / 6).otherwise(0.0))

    values = lambda alphabet: F.transform(F.split(F.translate(token, "-_", "+/"), ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    count = lambda pattern: F.when(kind.startswith("hex"), 0.0).otherwise(F.regexp_count(token, F.lit(pattern)).cast("double"))
    of_token = lambda alphabet: F.struct(values(alphabet).alias("v"), F.length(alphabet).cast("double").alias("size"), runs_of(token, kind).cast("double").alias("runs"), power(2).alias("a"), power(3).alias("b"), count("[A-Za-z]").alias("letters"), count("[AEIOUaeiou]").alias("vowels"))
    return let(of_kind(lambda alphabet, _: alphabet), lambda alphabet: let(of_token(alphabet), of))


def _class_of(kind: Column, n: Column) -> Column:
    """Encoding and length class: lengths of 20 to 31, 32 to 63, and so on."""
    return F.concat_ws("/", kind, F.length(F.bin(n)).cast("string"))


def bin_of(token: Column, kind: Column) -> Column:
    """The battery's bin of a token in an encoding: 0 looks most random."""
    return F.least(F.lit(BINS), F.floor(-F.log10(battery(token, kind)) * 20)).cast("int")


def candidates(found: Column) -> Column:
    """Spans of CANDIDATE -> struct(start, end, kind, class, bin) of their pieces that have an encoding."""

    def pieces(x: Column) -> Column:
        n = x["end"] - x["start"]
        k = F.greatest(F.lit(1).cast("long"), F.floor(n / PIECE).cast("long"))
        cut = lambda i: F.floor(n * i / k).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.struct((x["start"] + cut(i)).alias("start"), (x["start"] + cut(i + 1)).alias("end"), F.substring(x["hit"], (cut(i) + 1).cast("int"), (cut(i + 1) - cut(i)).cast("int")).alias("hit")))

    def tested(x: Column, kind: Column) -> Column:
        return F.when(kind.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), _class_of(kind, x["end"] - x["start"]).alias("class"), bin_of(x["hit"], kind).alias("bin")))

    return F.array_compact(F.transform(F.flatten(F.transform(found, pieces)), lambda x: let(encoding(x["hit"]), lambda kind: tested(x, kind))))


def ordinary(text: Column, tried: Column) -> Column:
    """struct(class, bin) of ordinary strings made of a text's words, ORDINARY for each class tried."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    words = F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, COMMON)))
    made = {
        "named": lambda w, i: F.concat(F.initcap(w), F.when(i % 3 == 2, (F.length(w) % 10).cast("string")).otherwise("")),
        "short": lambda w, i: F.concat(F.initcap(F.substring(w, 1, 5)), F.when(i % 2 == 1, (F.length(w) * (i + 3) % 100).cast("string")).otherwise("")),
        "letters": lambda w, i: F.initcap(w),
        "dumped": lambda w, i: F.when(i % 2 == 0, F.lower(F.hex(w))).otherwise(F.lpad(F.lower(F.hex((F.length(w) * (i + 1)).cast("long"))), 8, "0")),
    }
    strings = lambda ws: F.struct(*(F.array_join(F.transform(ws, make), "").alias(name) for name, make in made.items()), F.crc32(text).alias("from"))

    def spell(x: Column, kind: Column) -> Column:
        return F.when(kind.isin("lower36", "lower26"), F.lower(x)).when(kind.isin("hex_upper", "upper36", "upper26"), F.upper(x)).when(kind == "base32", F.translate(F.upper(x), *AS_BASE32)).otherwise(x)

    def of_class(x: Column, like: Column) -> Column:
        def one(r: Column) -> Column:
            model = F.get(like, (r % F.size(like)).cast("int"))
            kind, n = model["kind"], (model["end"] - model["start"]).cast("int")
            base = F.when(kind.startswith("hex"), x["dumped"]).when(kind.isin("lower26", "upper26", "mixed52"), x["letters"]).when(r % 2 == 1, x["short"]).otherwise(x["named"])
            return let(base, lambda b: F.struct(model["class"].alias("class"), bin_of(spell(piece(b, n, model["start"], r), kind), kind).alias("bin")))

        def piece(base: Column, n: Column, start: Column, r: Column) -> Column:
            size = F.length(base)
            at = ((start + x["from"] + F.floor(r * size / ORDINARY)) % size).cast("int")
            return F.substring(F.repeat(base, (F.floor((at + n) / size) + 1).cast("int")), at + 1, n)

        return F.transform(F.sequence(F.lit(0), F.lit(ORDINARY - 1)), one)

    def of(x: Column) -> Column:
        classes = F.array_distinct(F.transform(tried, lambda t: t["class"]))
        return F.flatten(F.transform(classes, lambda c: let(F.filter(tried, lambda t: t["class"] == c), lambda like: of_class(x, like))))

    none = F.array().cast("array<struct<class:string,bin:int>>")
    return F.when(F.size(tried) > 0, let(words, lambda ws: let(strings(ws), of))).otherwise(none)


def scan(docs: DataFrame, to: str) -> DataFrame:
    """Add the column ``to``: assign, access and hex (arrays of spans), tried (tested candidates) and ordinary (bins of the null). Null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(to, F.struct(
        spans(text, ASSIGN, 6, group=2).alias("assign"),
        spans(text, ACCESS, 20, filter_pattern=ACCESS[:4] + "[A-Z0-9]{16}").alias("access"),
        spans(text, HEX, 24, filter_pattern="[0-9a-f]{24}").alias("hex"),
        let(spans(text, CANDIDATE, LEAST_CANDIDATE, filter_pattern=CANDIDATE[:-1] + "{20}"), candidates).alias("tried"),
    ))
    return found.withColumn(to, F.struct(f"{to}.assign", f"{to}.access", f"{to}.hex", f"{to}.tried", let(F.col(f"{to}.tried"), lambda tried: ordinary(text, tried)).alias("ordinary")))


def discoveries(scanned: DataFrame, s: str) -> dict[str, int]:
    """class -> last bin that is reported.

    Gathers at most BINS + 1 pairs of counts for each encoding and power of two of lengths.
    """
    side = lambda name, k: scanned.select(F.explode(f"{s}.{name}").alias("t")).select("t.class", "t.bin", F.lit(k).alias("null"))
    counts = side("tried", 0).unionByName(side("ordinary", 1)).groupBy("class", "bin").agg(F.count_if(F.col("null") == 0).alias("n"), F.count_if(F.col("null") == 1).alias("o"))
    by_class: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.collect():
        by_class.setdefault(r["class"], {})[r["bin"]] = (r["n"], r["o"])
    last = {}
    for name, bins in by_class.items():
        total, null = (sum(x[k] for x in bins.values()) for k in (0, 1))
        n = o = 0
        for b in sorted(x for x in bins if x <= LAST_BIN):
            n, o = n + bins[b][0], o + bins[b][1]
            if (1 + o) * total <= RATE * n * (1 + null):
                last[name] = b
    return last


def report(scanned: DataFrame, s: str, last: dict[str, int], to: str) -> DataFrame:
    """Add the column ``to``: all spans (start, kind, end) of a row, by start and kind.

    A random piece that meets a fixed span is left out; pieces that touch are one span.
    """
    told = F.create_map(*(F.lit(x) for pair in last.items() for x in pair)) if last else F.create_map().cast("map<string,int>")
    span = lambda start, kind, end: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
    of_kind = lambda k: F.transform(F.col(f"{s}.{KINDS[k]}"), lambda x: span(x["start"], k, x["end"]))
    fixed = [of_kind(k) for k in range(3)]

    def both(base: Column) -> Column:
        alone = F.filter(f"{s}.tried", lambda x: (x["bin"] <= F.coalesce(F.element_at(told, x["class"]), F.lit(-1))) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.array_sort(F.concat(base, let(alone, whole)))

    def whole(x: Column) -> Column:
        opens = F.array_compact(F.transform(x, lambda y, i: F.when(~F.coalesce(F.get(x, i - 1)["end"] == y["start"], F.lit(False)), y["start"])))
        ends = F.array_compact(F.transform(x, lambda y, i: F.when(~F.coalesce(F.get(x, i + 1)["start"] == y["end"], F.lit(False)), y["end"])))
        return F.zip_with(opens, ends, lambda a, b: span(a, 3, b))

    return scanned.withColumn(to, let(F.concat(*fixed), both))


def joined(found: Column, most_kind: int) -> Column:
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter(found, lambda x: x["kind"] <= most_kind)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null texts count as empty and have no spans. Repeated rows each give a row;
    an empty table gives none. Columns but doc_id and text are not read. A very
    long run is tested in pieces, to its end. In a class of candidates of which no
    bin holds few enough ordinary strings, only the fixed patterns find anything.
    """
    held = settle(scan(docs.select("doc_id", "text"), "_s").drop("text"), "secrets")
    out = report(held, "_s", discoveries(held, "_s"), "_found")
    count = lambda i: F.size(F.filter("_found", lambda x: x["kind"] == i)).cast("long")
    return out.select("doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(joined(F.col("_found"), 2), 256).alias("base_sha256"), joined(F.col("_found"), 3).alias("spans"), count(3).alias("n_random"))


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``, n_chars brought up to date.

    Overlapping spans are masked as one. Null texts and texts without spans stay as
    they are, repeated rows are masked alike, an empty table stays empty, and other
    columns are kept whatever they are called. A text of any length is masked to
    its end. The documents are written once beside their spans, so that they are
    scanned once.
    """
    p = apart(docs)
    held = settle(scan(docs, f"{p}s"), "secrets")
    found, spans_of = report(held, f"{p}s", discoveries(held, f"{p}s"), f"{p}found"), F.col(f"{p}found")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"))
        wider = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(wider)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    hit = F.size(spans_of) > 0
    out = found.withColumn("text", F.when(hit, F.aggregate(spans_of, start, step, rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))
