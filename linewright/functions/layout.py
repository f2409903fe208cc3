"""Text layout and repair that no built-in function expresses, as pandas UDFs."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.text import MARKUP

# Quotes and dashes folded, classes of characters for breaking.
FOLD = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
NO_START = frozenset("，。！？；：、）》」』”’】,.!?;:)]}%")
NO_END = frozenset("（《「『“‘【([{")
WIDE = ((0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF), (0x20000, 0x2A6DF))


@F.pandas_udf(T.StringType())
def normal_text(text: pd.Series) -> pd.Series:
    """Without entities and tags, NFKC, quotes and dashes folded, white space single."""

    def one(x: str | None) -> str:
        plain = unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", "", html.unescape(x or "")))
        for a, b in FOLD.items():
            plain = plain.replace(a, b)
        return " ".join(plain.split())

    return text.map(one)


def char_width(c: str) -> int:
    """Hundredths of the font size."""
    n = ord(c)
    if any(a <= n <= b for a, b in WIDE):
        return 100
    for chars, width in (("iI1l!|;,.'\"", 35), ("fjt()[]{}", 45), ("mwMW@#%&", 80), (" ", 30)):
        if c in chars:
            return width
    return 65 if c.isupper() else 52


class _Cached(dict):
    """A function's values by character."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, c: str):
        self[c] = value = self.f(c)
        return value


_width_of = _Cached(lambda c: char_width(c))
_wide = _Cached(lambda c: any(a <= ord(c) <= b for a, b in WIDE))
#: Markup, white space, characters that break on their own, and runs of the others.
_parts = re.compile(rf"{MARKUP}|\s+|[^\s<{{{''.join(f'{chr(a)}-{chr(b)}' for a, b in WIDE)}]+|.", re.S)


def break_text(text: str, most: int) -> list[str]:
    """Lines of at most ``most`` width, as even as they can be.

    Breaks lie at spaces or between wide characters, never before closing or
    after opening punctuation and never within markup; the fewest lines are
    taken, and among those the one whose squared slack is least. A piece wider
    than a line stands alone.
    """
    pieces: list[str] = []
    gaps: list[str] = []  # what stands before each piece
    gap = ""
    for part in _parts.findall(text.strip()):
        if part.isspace():
            gap = " "
            continue
        if pieces and not gap:
            last = pieces[-1]
            if (not (len(part) == 1 and _wide[part]) and not (len(last) == 1 and _wide[last])) or part[0] in NO_START or last[-1] in NO_END:
                pieces[-1] = last + part
                continue
        pieces.append(part)
        gaps.append(gap)
        gap = ""
    width = [sum(map(_width_of.__getitem__, re.sub(MARKUP, "", p) if "<" in p or "{" in p else p)) for p in pieces]
    before = [30 if g else 0 for g in gaps]
    # of the first k pieces: lines, squared slack, where the last line starts
    lines, slack, first = [0], [0], [0]
    for k in range(len(pieces)):
        inner = width[k]
        n, s, at = lines[k], slack[k] + (most - inner) ** 2 if inner < most else slack[k], k
        for j in range(k - 1, -1, -1):
            inner += width[j] + before[j + 1]
            if inner > most:
                break
            if lines[j] <= n:
                rest = slack[j] + (most - inner) ** 2
                if lines[j] < n or rest <= s:
                    n, s, at = lines[j], rest, j
        lines.append(n + 1)
        slack.append(s)
        first.append(at)
    out, k = [], len(pieces)
    while k > 0:
        j = first[k]
        out.append(pieces[j] + "".join(g + p for g, p in zip(gaps[j + 1 : k], pieces[j + 1 : k])))
        k = j
    return out[::-1]


def broken_lines(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def broken(text: pd.Series) -> pd.Series:
        return text.map(lambda x: break_text(x or "", most))

    return broken


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def repair_ids(wanted: DataFrame, got: DataFrame, key: str, least: float = 0.85, longest: int = 4) -> DataFrame:
    """(wanted key, got key) of ids that differ by a slip: alone for each other.

    Candidates share the number at their end, so only those are compared; ids
    that match exactly are out on both sides.
    """
    tail = F.regexp_extract(key, "([0-9]+)[^0-9]*$", 1)
    missing = wanted.join(got, key, "left_anti").select(F.col(key).alias("wanted"), tail.alias("tail"))
    extra = got.join(wanted, key, "left_anti").select(F.col(key).alias("got"), tail.alias("tail"))
    near = missing.filter("tail <> ''").join(extra, "tail").filter(F.abs(F.length("wanted") - F.length("got")) <= longest)
    like = near.withColumn("likeness", likeness("wanted", "got")).filter(F.col("likeness") >= least)
    one = lambda side: like.groupBy(side).agg(F.count("*").alias("_n")).filter("_n = 1").select(side)
    return like.join(one("wanted"), "wanted", "left_semi").join(one("got"), "got", "left_semi").select("wanted", "got")
