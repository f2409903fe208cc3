"""Fill-in-middle: texts cut at two unit boundaries and put together with sentinels.

The characters of a block of texts are classed (inside a word, end of a word,
white space, line feed, and whether the text ends there) and held in a wavelet
matrix. The ends of units before a place are a sum of rank queries over the
classes that end a unit, and a cut is found by bisection on that sum, for all
texts of the block together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the texts that are cut together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20

INSIDE, WORD_END, WORD_END_LAST, SPACE, SPACE_LAST, LINE, LINE_LAST = range(7)
#: The classes whose characters end a unit. A word takes the white space before it along.
UNITS = {
    "words": (WORD_END, WORD_END_LAST, SPACE_LAST, LINE_LAST),
    "lines": (LINE, LINE_LAST, WORD_END_LAST, SPACE_LAST),
    "characters": tuple(range(7)),
}


class WaveletMatrix:
    """Rank queries over a sequence of small numbers: a bit vector with running counts for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        first, at = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, at)
            if symbol >> (self.bits - 1 - level) & 1:
                zeros = self.levels[level][2]
                first, at = zeros + a, zeros + b
            else:
                first, at = first - a, at - b
        return at - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the symbols stand before each place."""
        return sum(self.rank(s, at) for s in symbols)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point of the texts put together, and the texts' bounds."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    white = (points == 32) | ((points >= 9) & (points <= 13))
    last = np.zeros(len(points), dtype=bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    ends_word = last.copy()
    ends_word[:-1] |= white[1:]
    found = np.where(white, SPACE, np.where(ends_word, WORD_END, INSIDE)).astype(np.uint8)
    found[points == 10] = LINE
    found[last] += 1  # the class beside it: the text ends here
    return found, bounds


def cut_places(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str = "words") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the two places (code points) after as many units as two numbers modulo units + 1 say."""
    symbols, bounds = classes(texts)
    matrix, ends = WaveletMatrix(symbols, 3), UNITS[unit]
    start, end = bounds[:-1], bounds[1:]
    before = matrix.count(ends, start)
    n = matrix.count(ends, end) - before
    a, b = first % (n + 1), second % (n + 1)
    places = []
    for wanted in (np.minimum(a, b), np.maximum(a, b)):
        low, high = start.copy(), end.copy()  # the least place with that many ends before it
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = matrix.count(ends, middle) - before >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        places.append(low - start)
    return n, *places


def blocks_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > BLOCK_CHARS:
            yield at, k
            at, size = k, 0
        size += len(text)
    if len(texts) > at:
        yield at, len(texts)


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, unit: str = "words", sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars, output.

    The id's hash decides the form (plain, psm, spm) and the cuts, so a run can be
    repeated. Null texts count as empty and empty texts are plain, as are texts
    that hold a sentinel. A null id is hashed as an empty one; repeated rows give
    one row each; an empty table gives none. A text of any length is cut whole, in
    memory in proportion to it. Other columns are ignored, so their names cannot clash.
    """
    prefix_mark, suffix_mark, middle_mark = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [bytes.fromhex(h) for h in batch.column("h").to_pylist()]
            h = np.frombuffer(b"".join(keys), dtype=">u4").reshape(-1, 4).astype(np.int64)
            for at, to in blocks_of(texts):
                part = texts[at:to]
                n, low, high = cut_places(part, h[at:to, 0], h[at:to, 1], unit)
                forms, outputs = [], []
                for text, a, b, (pick, order) in zip(part, low.tolist(), high.tolist(), h[at:to, 2:].tolist()):
                    if not text or pick % 100 >= percent or any(s in text for s in sentinels):
                        forms.append("plain")
                        outputs.append(text)
                    elif order % 100 < spm_percent:
                        forms.append("spm")
                        outputs.append(f"{suffix_mark}{text[b:]}{prefix_mark}{text[:a]}{middle_mark}{text[a:b]}")
                    else:
                        forms.append("psm")
                        outputs.append(f"{prefix_mark}{text[:a]}{suffix_mark}{text[b:]}{middle_mark}{text[a:b]}")
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(outputs, pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``transform`` made an output of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), 4)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1)))


def digests(docs: DataFrame) -> DataFrame:
    """The outputs of ``transform`` and the texts rebuilt from them, as digests."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


DIGESTS_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') as u,
         sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
picked as (
  select *, len(u) as n,
         ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
              when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from units),
parts as (
  select *, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b) + 1:], '') as s
  from picked)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
