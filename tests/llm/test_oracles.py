"""Every query that has SQL, against DuckDB: on the given tables and on odd rows."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from linewright.llm.queries import ORACLES, QUERIES


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        path = f"{sf_dir}/{table}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {table} as select * from '{path}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.fixture(scope="module")
def odd_dir(spark, odd_docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    docs = odd_docs.toPandas()
    docs.to_parquet(root / "documents.parquet")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs"), (2, "One two"), (3, ""), (4, None), (5, "nothing of this kind is ever said in any document here"), (2, "One two"), (6, "fox jumps over the lazy dog and runs away from it all today"), (7, "lazy dog"), (8, "ONE")], "item_id long, text string")
    bench.toPandas().to_parquet(root / "benchmark.parquet")
    spark.createDataFrame([(1, None, "x")], "page_id long, url string, html string").toPandas().to_parquet(root / "pages.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").toPandas().to_parquet(root / "labels.parquet")
    vectors = [[0.25 * (i % 7) + 0.01 * j for j in range(64)] for i in range(60)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]
    rows = [(i, v, 0) for i, v in enumerate([*vectors, *odd])] + [(3, vectors[3], 0), (3, vectors[4], 1), (None, vectors[5], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as d", "'x' as cluster", "4 as id", "'dot' as `a.b`").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        pq.write_table(spark.createDataFrame([], schema).toArrow(), f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_given_tables(spark, sf_dir, name):
    same(spark, sf_dir, name)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, odd_dir, name):
    same(spark, odd_dir, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0
