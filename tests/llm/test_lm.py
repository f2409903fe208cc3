import math
import random
import zlib
from collections import Counter

from linewright.llm import lm
from linewright.llm.queries import op6_lm_scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), b"<end>"]


def brute(docs):
    train = [tokens(t) for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 10]
    padded = lambda w: list(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    triples = Counter(x for w in train for x in padded(w))
    count = Counter(x for w in train for x in w)
    pairs = Counter((v, w) for _, v, w in triples)
    types = Counter(w for _, w in pairs)
    c3, c2, k3, k2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), n in triples.items():
        c3[u, v] += n
        k3[u, v, min(n, 3)] += 1
    for (v, _), n in pairs.items():
        c2[v] += n
        k2[v, min(n, 3)] += 1
    n, v = sum(count.values()), len(count)
    of = lambda values: lm.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d3, d2, d1 = of(triples.values()), of(pairs.values()), of(types.values())
    total = sum(types.values())
    rest = sum(d1[min(t, 3) - 1] for t in types.values()) / total if total else 1.0

    def one(w):
        t = types[w]
        return ((t - d1[min(t, 3) - 1] if t else 0) / total if total else 0) + rest / (v + 1)

    def two(a, w):
        c = pairs[a, w]
        if not c2[a]:
            return one(w)
        return (c - d2[min(c, 3) - 1] if c else 0) / c2[a] + sum(k2[a, k] * d2[k - 1] for k in (1, 2, 3)) / c2[a] * one(w)

    def three(a, b, w):
        c = triples[a, b, w]
        if not c3[a, b]:
            return two(b, w)
        return (c - d3[min(c, 3) - 1] if c else 0) / c3[a, b] + sum(k3[a, b, k] * d3[k - 1] for k in (1, 2, 3)) / c3[a, b] * two(b, w)

    for d, t in docs:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        yield d, d is None or zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, base, sum(math.log10(three(*x)) for x in padded(w))


def same(rows, docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute(docs), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op6_lm_scoring(spark, sf_dir).collect()
    same(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    same(lm.fold_scores(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lm.fold_scores(no_docs).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = [(i, "a b a") for i in only_held]
    same(lm.fold_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_probabilities_sum_to_one(spark):
    docs = [(i, t) for i, t in enumerate(["a b c a b", "b b a c", "c a b b d e", "a a a", "d e f"] * 4)]
    model = lm.learn(spark.createDataFrame(docs, "doc_id long, text string"))
    scorer, hashes = lm.Scorer(model), lm.WordHashes()
    score = lambda text, cut: scorer.score([lm.token_hashes(text, hashes, scorer.end)[:cut]])[2][0]
    for context in ("a", "a b", "zz", "b zz", "b", "c a b"):
        n = len(context.split())
        before = score(context, n)
        total = sum(10 ** (score(f"{context} {w}", n + 1) - before) for w in ("a", "b", "c", "d", "e", "f", "never"))
        total += 10 ** (score(context, n + 1) - before)
        assert math.isclose(total, 1.0, rel_tol=1e-9), context


def test_words_of_several_buckets(spark, monkeypatch):
    """Tiny buckets and ranges: nearly every word is dealt out over several, and the answer is the same."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 7)
    monkeypatch.setattr(lm, "RANGE_BYTES", 200)
    monkeypatch.setattr(lm, "COUNT_BLOCK", 60)
    monkeypatch.setattr(lm, "SCORE_BLOCK", 50)
    monkeypatch.setattr(lm, "MOST_MAPS", 3)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("the the the the of and a b c d e f g h".split()) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    same(lm.fold_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect(), docs)


def test_words_whose_hashes_share_their_halves_stay_apart(spark):
    """Real words whose 64-bit hashes agree in 32 bits: every count is still its own."""
    halves, twins = {}, []
    for i in range(200_000):
        word = f"w{i}"
        h = lm.WordHashes()[word.encode()] >> 32
        twins += [(halves[h], word)] if h in halves else []
        halves[h] = word
    assert twins
    docs = [(10 * k + j, f"{a} x {a} y {b} x {b} {a}" if j % 2 else f"{b} y {b} {b} z {a}") for k, (a, b) in enumerate(twins) for j in range(10)]
    same(lm.fold_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
