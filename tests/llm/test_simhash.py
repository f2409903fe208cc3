import numpy as np
import xxhash

from linewright.llm import simhash
from linewright.llm.queries import op10_simhash_near_dedup

WHITE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(ids, fps):
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                label[root(b)] = root(a)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in zip(ids, fps)]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(map(tuple, op10_simhash_near_dedup(spark, sf_dir).collect()))
    assert got == sorted(brute([d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs]))
    assert any(i != c for i, _, c in got)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    got = sorted(map(str, map(tuple, simhash.near_duplicates(odd_docs).collect())))
    assert got == sorted(map(str, brute([d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs])))
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.first_of_each(odd_docs).columns == odd_docs.columns


def test_every_pair_within_two_bits_shares_a_key():
    golay, rng = simhash.Golay(), np.random.default_rng(0)
    for bits in (21, 22):
        words = rng.integers(0, 1 << bits, 2000)
        assert {int((row >= 0).sum()) for row in golay.indices(words, 23)} <= {1, 6}
        other = words ^ (1 << rng.integers(0, bits, 2000)) ^ (1 << rng.integers(0, bits, 2000))
        for a, b in zip(golay.indices(words, bits), golay.indices(other, bits)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([[0], 1 << rng.integers(0, 40, 60), (1 << rng.integers(0, 40, 200)) | (1 << rng.integers(0, 40, 200)), rng.integers(0, 1 << 62, 50)])).astype(np.int64)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    for small in (2, 8, 1000):
        got = {r.node: r.root for r in simhash.components(simhash.links(nodes, small)).collect()}
        label = {r[0]: r[2] for r in zip(map(int, fps), fps, [c for _, _, c in brute(list(map(int, fps)), list(map(int, fps)))])}
        assert {f: got.get(f, f) for f in label} == label
