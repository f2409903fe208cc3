"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters.
Every three words are hashed, and the least hash of each window of three is a
fingerprint, so any five words shared with a template share a fingerprint; of
templates too short for that every hash counts. An inverted index of the templates'
fingerprints (a fixed table, ``license_texts``) gives candidate places; around each
one a banded alignment matches the template's words against the text's.

A place is reported if the matched words are four fifths of the template's words and
of the words put in between. Words that tell one license from another, and numbers
in lines and identifiers, must all be matched and none may be put in; a line just
after a word that denies it is none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import WordHashes
from linewright.llm.license_texts import DENYING, TELLING, TEMPLATES

SHINGLE, WINDOW, BAND, LEAST_COVERAGE = 3, 3, 8, 0.8
#: Words before a line in which one may deny it.
BEFORE = 3
#: Words hashed at a time.
BLOCK = 1_000_000

_keep = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_far = np.uint64(0xFFFFFFFFFFFFFFFF)


_words = WordHashes()


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_keep).split()


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each three words of the texts laid end to end; the largest value where a text ends."""
    out = np.full(len(hashes), _far)
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return out
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    out[:n] = mixed & np.uint64(0x7FFFFFFFFFFFFFFF)
    ends = np.cumsum(lengths)
    for k in range(1, SHINGLE):
        at = ends - k
        out[at[(at >= 0) & (lengths >= k)]] = _far
    return out


def winnow(hashed: np.ndarray) -> np.ndarray:
    """Positions of the least hash of each window, the last of equal ones."""
    if len(hashed) < WINDOW:
        hashed = np.append(hashed, np.full(WINDOW - len(hashed), _far))
    windows = np.lib.stride_tricks.sliding_window_view(hashed, WINDOW)
    at = np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    chosen = np.unique(at)
    return chosen[hashed[chosen] != _far]


class Index:
    """Fingerprint -> places (template, word) of the fixed templates."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.templates = [(name, form, words_of(text)) for name, form, text in templates]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short = set()
        for t, (_, _, words) in enumerate(self.templates):
            hashed = shingles(np.array([_words[w] for w in words], dtype=np.uint64), np.array([len(words)]))
            brief = len(words) < SHINGLE + WINDOW - 1
            for at in np.flatnonzero(hashed != _far) if brief else winnow(hashed):
                self.places[int(hashed[at])].append((t, int(at)))
                short |= {int(hashed[at])} if brief else set()
        self.keys, self.short = (np.array(sorted(k), dtype=np.uint64) for k in (self.places, short))

    def hits(self, hashed: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Those of the chosen positions whose fingerprint the index holds, and all with one of a short template."""
        held = lambda keys, at: at[keys[np.minimum(np.searchsorted(keys, hashed[at]), len(keys) - 1)] == hashed[at]] if len(keys) else at[:0]
        return np.union1d(held(self.keys, chosen), held(self.short, np.arange(len(hashed))))

    def fits(self, t: int, words: list[bytes], first: int, end: int, matched: int) -> bool:
        """Whether enough of a template stands in words[first:end], with all that tells it from others."""
        _, form, template = self.templates[t]
        if matched < LEAST_COVERAGE * (len(template) + end - first - matched):
            return False
        brief = form in ("line", "identifier")
        here, want = Counter(words[first:end]), Counter(template)
        telling = lambda w: w.decode(errors="replace") in TELLING or (brief and any(c in b"0123456789" for c in w))
        if any(map(telling, (here - want) + (want - here))):
            return False
        if brief and any(w.decode(errors="replace") in DENYING for w in words[max(0, first - BEFORE) : first]):
            return False
        # an identifier or version may go on behind its last word: 2.0-only, 2.1
        return not (brief and end < len(words) and form == "identifier" and words[end] in (b"only", b"or") and (b"only" not in template and b"or" not in template))


def align(template: list[bytes], text: list[bytes], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment whose words stay within ``band`` of a diagonal.

    A match scores 2, a word left out on either side or replaced -1; the text
    before the first and after the last matched word is free.
    """
    width = 2 * band + 1
    # each cell: score, matched, first matched word (-1 for none), end of the last one
    none = (0, 0, -1, -1)
    before = [none] * (width + 1)
    for i, word in enumerate(template):
        row, left = [], None
        for k in range(width):
            j = i + diagonal + k - band
            best = before[k + 1]  # the template's word is left out
            best = (best[0] - 1, *best[1:])
            if 0 <= j < len(text):
                s, n, first, end = before[k]
                step = (s + 2, n + 1, j if first < 0 else first, j + 1) if text[j] == word else (s - 1, n, first, end)
                if step[:2] > best[:2]:
                    best = step
            if left is not None and (left[0] - (left[2] >= 0), left[1]) > best[:2]:  # the text's word is left out
                best = (left[0] - (left[2] >= 0), *left[1:])
            row.append(best)
            left = best
        before = [*row, (-(10**6), 0, -1, -1)]
    _, matched, first, end = max(before, key=lambda c: (c[0], c[1], -c[2]))
    return matched, first, end


def places_in(words: list[bytes], at: list[int], hashed: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, matched) of the covered templates, none within another's span."""
    seen: dict[int, list[int]] = defaultdict(list)
    for p in at:
        for t, q in index.places[int(hashed[p])]:
            seen[t].append(p - q)
    found = []
    for t, diagonals in seen.items():
        template, last = index.templates[t][2], None
        for d in sorted(set(diagonals)):
            if last is not None and d - last <= BAND // 2:
                continue
            last = d
            matched, first, end = align(template, words, d)
            if matched and index.fits(t, words, first, end, matched):
                found.append((-matched, len(template), first, end, t))
    kept: list[tuple[int, int, int, int]] = []
    for less, _, first, end, t in sorted(found):
        if all(end <= a or b <= first for _, a, b, _ in kept):
            kept.append((t, first, end, -less))
    return sorted(kept, key=lambda x: x[1])


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license found in a text.

    id, license, form, start and end (code points, end exclusive), matched_words,
    template_words, coverage. Null and empty texts and an empty table give no row;
    repeated rows each give theirs; of overlapping places that with most matched
    words is reported, of equal ones the shorter template. Columns but the id and the
    text are not read; very long texts are hashed in blocks and read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            ids, texts, out, held, total, first = batch.column("id"), batch.column("text").to_pylist(), [], [], 0, 0

            def look(held: list[list[bytes]], first: int) -> None:
                lengths = np.array([len(w) for w in held])
                hashes = np.fromiter((h for words in held for h in map(_words.__getitem__, words)), dtype=np.uint64, count=int(lengths.sum()))
                hashed = shingles(hashes, lengths)
                hits = index.hits(hashed, winnow(hashed))
                ends = np.cumsum(lengths)
                owner = np.searchsorted(ends, hits, side="right")
                for k in np.unique(owner):
                    begin = int(ends[k] - lengths[k])
                    at = [int(h) - begin for h in hits[owner == k]]
                    places = places_in(held[k], at, hashed[begin : int(ends[k])], index)
                    if places:
                        spans = [m.span() for m in _word.finditer(texts[first + k])]
                        for t, a, b, matched in places:
                            name, form, template = index.templates[t]
                            out.append((first + int(k), name, form, spans[a][0], spans[b - 1][1], matched, len(template), matched / len(template)))

            for text in texts:
                held.append(words_of(text or ""))
                total += len(held[-1])
                if total >= BLOCK:
                    look(held, first)
                    first, held, total = first + len(held), [], 0
            if total:
                look(held, first)
            rows = list(zip(*out)) or [()] * 8
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *(pa.array(r, k) for r, k in zip(rows[1:], kinds))], ["id", "license", "form", "start", "end", "matched_words", "template_words", "coverage"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, license string, form string, start long, end long, matched_words long, template_words long, coverage double").withColumnRenamed("id", id_col)
