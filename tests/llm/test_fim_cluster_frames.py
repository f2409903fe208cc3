import io
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from linewright.llm import cluster, fim, frames
from linewright.llm.common import new_path
from linewright.llm.queries import op13_token_ids, vocabulary

UNIT = {"words": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "lines": r"[^\n]*\n|[^\n]+", "characters": r"(?s)."}


def test_wavelet_ranks_equal_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 7, n).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(symbols, 3), np.arange(n + 1)
        for s in range(7):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


@pytest.mark.parametrize("unit", sorted(UNIT))
def test_cuts_equal_units(unit):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab  \n\té🙂　\x1f"), rng.integers(0, 30))) for _ in range(2000)]
    first, second = rng.integers(0, 2**32, (2, len(texts)))
    for text, x, y, n, low, high in zip(texts, first, second, *fim.cut_places(texts, first, second, unit)):
        units = re.findall(UNIT[unit], text)
        p, q = sorted((int(x % (len(units) + 1)), int(y % (len(units) + 1))))
        assert (n, low, high) == (len(units), len("".join(units[:p])), len("".join(units[:q]))), repr(text)


def test_fill_in_middle_restores(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(["<P> x y z", "a <S>", "b<M>", *["<a <P < S> one\n two  <P", "x<<S", "…"] * 30])], "doc_id long, text string"), allowMissingColumns=True)
    made = fim.transform(docs, percent=100)
    rows = made.select("*", fim.restore(made["output"], made["form"]).alias("restored")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = texts[r.doc_id]
        assert r.restored == text
        plain = not text or any(s in text for s in ("<P>", "<S>", "<M>"))
        assert (r.form == "plain") == plain and (r.prefix_chars is None) == plain
        if not plain:
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            p, m, s = text[:a], text[a:b], text[b:]
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fim.transform(no_docs).count() == 0


def plain_clusters(rows, k, rounds, size, scale, seed):
    """Every centroid compared, with Python's integers."""
    import hashlib

    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((repr(i), near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centroids[near(v)[1]])).encode()).hexdigest()) for i, v in kept)


@pytest.mark.parametrize("scale", [256, 1, 1 << 20])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (9, 8))
    rows = [(i, [float(x) for x in centres[i % 9] + rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are copies
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (None, rows[5][1]), (5, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as cluster", "1 as id", "2 as v").repartition(4)
    got = cluster.cluster(table, k=12, rounds=4, size=8, scale=scale).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.centroid_sha256) for r in got) == plain_clusters(rows, 12, 4, 8, scale, 2)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for j in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == j} == {sum(r.distance for r in got if r.cluster == j)}


def test_vectors_all_alike_and_too_large(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = cluster.cluster(same, k=4, rounds=2, size=2).collect()
    assert len(got) == 50 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
    assert cluster.cluster(same.limit(0), size=2).count() == 0
    with pytest.raises(Exception, match="would not fit a long"):
        cluster.cluster(same.selectExpr("vec_id", "array(1e30D, 2D) as embedding"), size=2).collect()


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(6)
    centres = rng.integers(-1000, 1000, (40, 64))
    vectors = (centres[rng.integers(0, 40, 5000)] + rng.integers(-8, 9, (5000, 64))).astype(np.int64)
    held = cluster.Clusters(centres.astype(np.int64), cluster.far_apart(centres.astype(np.int64), 6))
    of_vectors = cluster.distances(vectors, held.pivots)
    everything = np.stack([cluster.squared(vectors, c[None]) for c in held.centroids], axis=1)
    low = cluster.bounds(of_vectors, held.of_centroids, held.of_pivots)
    assert (low <= everything).all()
    found, distance, checks = cluster.nearest(vectors, of_vectors, held.centroids, held.of_centroids, held.of_pivots)
    assert (found == everything.argmin(axis=1)).all() and (distance == everything.min(axis=1)).all()
    assert checks < len(vectors) * 4  # of 40


def ids_of(text):
    return np.array(Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_ids_equal_the_library(spark, sf_dir, odd_docs, no_docs):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=lambda r: r[0])
    got, at, library = {r.doc_id: r for r in op13_token_ids(spark, sf_dir).collect()}, 0, Tokenizer.from_file(vocabulary())
    assert len(got) == len(docs)
    for number, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[number].start, got[number].n_tokens, got[number].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = new_path(spark, "odd")
    frames.write_tokens(odd_docs, path, vocabulary(), end_id=2)
    rows = sorted(frames.read_tokens(spark, path).collect(), key=lambda r: r.start)
    texts, at = {r.doc_id: r.text for r in odd_docs.collect()}, 0
    assert len(rows) == odd_docs.count() and rows[0].doc_id is None
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    for r in rows:
        assert r.start == at and r.ids == ids_of(texts[r.doc_id]).tobytes()
        at += r.n_tokens
    path = new_path(spark, "none")
    frames.write_tokens(no_docs, path, vocabulary(), end_id=2)
    assert frames.read_tokens(spark, path).count() == 0


def held_file(bodies, first=0):
    out = io.BytesIO()
    file = frames.FrameWriter(out)
    for k, body in enumerate(bodies):
        file.append(first + 3 * k, body)
    file.close()
    return out.getvalue()


def test_a_file_is_plain_zstandard_and_reads_only_what_is_asked():
    bodies = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5000, 1, 70, 2)]
    data = held_file(bodies)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(bodies)

    class Counted(io.BytesIO):
        took = 0

        def read(self, n=-1):
            self.took += n
            return super().read(n)

    source = Counted(data)
    file = frames.FrameReader(source, len(data))
    source.took = 0
    places = file.places(np.array([0, 7, 9]), 0, 5)
    assert [(file.number(k), body) for k, body in file.ids(places)] == [(0, bodies[0]), (9, bodies[3])]
    assert source.took == file.packed[0] + file.packed[3]
    assert [body for _, body in file.ids(np.arange(5))] == bodies and file.starts.tolist() == [0, 1, 5001, 5002, 5072]


def test_damage_is_found():
    data = held_file([np.arange(500, dtype="<u4").tobytes()] * 3)
    for at in range(0, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 0x41
        try:
            file = frames.FrameReader(io.BytesIO(bytes(bad)), len(bad))
            got = [body for _, body in file.ids(np.arange(3))]
        except (ValueError, zstandard.ZstdError, MemoryError):
            continue
        assert got == [np.arange(500, dtype="<u4").tobytes()] * 3  # a byte that tells nothing, of a frame's header
    with pytest.raises(ValueError):
        frames.FrameReader(io.BytesIO(data[:-1]), len(data) - 1)
    with pytest.raises(ValueError, match="ascending"):
        out = frames.FrameWriter(io.BytesIO())
        out.append(2, b"")
        out.append(1, b"")


def test_filters_reach_the_files_and_failed_writes_leave_the_former(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('word ', id) as text")
    path = f"file://{tmp_path}/ids"
    frames.write_tokens(docs, path, vocabulary(), end_id=2, file_bytes=500)
    manifest = (tmp_path / "ids" / frames.MANIFEST).read_bytes()
    want = frames.read_tokens(spark, path).where("doc_id in (7, 150, 999)")
    assert sorted(r.doc_id for r in want.collect()) == [7, 150]
    assert want.rdd.getNumPartitions() <= 2 < frames.read_tokens(spark, path).rdd.getNumPartitions()
    assert frames.read_tokens(spark, path).where("doc_id = 999").count() == 0
    failing = docs.selectExpr("doc_id", "if(doc_id = 150, raise_error('lost'), text) as text")
    with pytest.raises(Exception, match="lost|holds ids already"):
        frames.write_tokens(failing, path, vocabulary(), end_id=2, file_bytes=500, mode="overwrite")
    assert (tmp_path / "ids" / frames.MANIFEST).read_bytes() == manifest and frames.read_tokens(spark, path).count() == 200
    with pytest.raises(Exception, match="holds ids already"):
        frames.write_tokens(docs, path, vocabulary(), end_id=2)
    frames.write_tokens(docs.limit(3), path, vocabulary(), end_id=2, mode="overwrite")
    assert frames.read_tokens(spark, path).count() == 3
    assert os.path.exists(tmp_path / "ids" / frames.MANIFEST)
