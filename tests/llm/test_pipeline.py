import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from linewright.llm import decontam, quality, simhash
from linewright.llm.common import own_folder
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_simhash import brute, plain_fingerprint
from tests.llm.test_tokens_packing import packed_right


def masked(text, named):
    spans, at, out = [], 0, ""
    for a, b in (tuple(map(int, x.split(":")[1:])) for x in named.split(",") if x):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in spans:
        out, at = out + text[at:a] + "[SECRET]", b
    return out + (text or "")[at:]


def test_pipeline_equals_brute_force(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create table {table} as select * from '{sf_dir}/{table}.parquet'")
    kept = {r[0] for r in con.sql(quality.RATE_SQL).fetchall() if r[7]}
    docs = {d: t for d, t in con.sql("select doc_id, text from documents").fetchall() if d in kept}
    links = brute(list(docs), [plain_fingerprint(t) for t in docs.values()])
    firsts = {i for i, _, c in links if i == c}
    hit = {r[0] for r in con.sql(decontam.CONTAMINATION_SQL).fetchall() if r[5]}
    left = {d: t for d, t in docs.items() if d in firsts - hit}
    want = {d: masked(t, spans) for (d, t), spans in zip(left.items(), brute_spans(list(left.values())))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(want) < con.sql("select count(*) from documents").fetchall()[0][0]
    assert {r.doc_id for r in rows} == set(want)
    packed_right(rows, want, 1024)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf_dir, odd_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
        assert not after - before if name != "secret_scans" else after.total() == before.total(), name


def test_one_row_of_each_group_stays(spark):
    """Rows are told apart by id and text; the answer does not depend on the layout."""
    other = "entirely different words that are about something else"
    rows = [(1, "a b c d", "x"), (5, "a b c d", "x"), (5, other, "y"), (5, other, "x"), (None, other, "x"), (None, "third text of no id at all", "x"), (None, "third text of no id at all", "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep string")
    want = [(1, "a b c d", "x"), (5, other, "x"), (None, "third text of no id at all", "x"), (7, None, "x")]
    for n in (1, 3, 8):
        assert sorted(map(repr, map(tuple, simhash.first_of_each(docs.repartition(n)).collect()))) == sorted(map(repr, want))


def test_tables_can_be_cleared(spark):
    from linewright.llm import common

    held = common.settle(spark.range(3).toDF("x"), "cleared")
    assert held.count() == 3
    before = common.own_folder(spark)
    try:
        common.own_folder = lambda s: before + "-other"
        path = common.new_path(spark, "gone")
        held.write.parquet(path)
        common.clear(spark)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
    finally:
        common.own_folder = own_folder
    assert held.count() == 3
