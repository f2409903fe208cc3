import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from linewright.llm import bpe, packing
from linewright.llm.queries import op8_best_fit_packing, op9_token_counts, vocabulary


@functools.cache
def library():
    return Tokenizer.from_file(vocabulary())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, odd_docs, no_docs):
    got = bpe.count_tokens(odd_docs, vocabulary(), public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        n = len(ids(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512), r
    assert bpe.count_tokens(no_docs, vocabulary(), public_tokenizers.PATTERN).count() == 0


def test_counts_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(ids(docs[r.doc_id]))


def test_cached_chunks_equal_whole_texts():
    encode, plain, count = bpe.IdEncoder(vocabulary(), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), bpe.IdEncoder(vocabulary()), bpe.MergeCounter(vocabulary(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    alphabet = list("ab'st 1.\n\t é ") + ["  ", " \n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 12)))
        want = ids(text)
        assert np.frombuffer(encode(text), "<u4").tolist() == want, repr(text)
        assert plain(text) == encode(text) and count(text) == len(want), repr(text)


def packed_right(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, parts in by_doc.items():
        if doc in (None, 3):
            continue
        stream, at = np.array([*ids(texts[doc]), 2], "<u4"), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(stream[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(stream)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf_dir, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, vocabulary()).collect()
    packed_right(rows, {r.doc_id: r.text for r in odd_docs.collect()}, 1024)
    assert packing.pack_documents(no_docs, vocabulary()).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_best_fit_packing(spark, sf_dir).collect()
    assert packed_right(rows, docs, 1024) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(2)
    for histogram in ({}, {5: 3}, {600: 50_000}, {1024: 7, 1: 2}, dict(zip(range(1, 1025), map(int, rng.integers(0, 40, 1024))))):
        found = packing.plan(histogram, 1024, rounds=30)
        held = defaultdict(int)
        for config, times in found:
            assert sum(k * n for k, n in config) <= 1024
            for k, n in config:
                held[k] += n * times
        assert {k: n for k, n in held.items() if n} == {k: n for k, n in histogram.items() if n}
    assert sum(t for _, t in packing.plan({600: 50_000, 400: 50_000}, 1024)) == 50_000
