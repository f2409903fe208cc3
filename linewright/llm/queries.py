"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import bpe, cluster, decontam, fim, frames, html, licenses, lm, packing, quality, secrets, simhash, urls
from linewright.llm.common import new_path, read_table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The contract's rules.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its url's path; that document's label is the page's."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", bad.alias("bad"))
    return urls.filter_urls(pages, labelled, URL_RULES)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fold_scores(read_table(spark, sf_dir, "documents"), folds=10)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)


def pack_1024(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, vocabulary(), capacity=1024, end_id=2, ranks=vocabulary("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_ids=with_ids)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_1024(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN, limit=512)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, scale=256, seed=2)


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    frames.write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2, ranks=vocabulary("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return frames.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_secret_scans": op2_secret_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_token_ids": op13_token_ids,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.RATE_SQL,
    "op7_benchmark_decontamination": decontam.CONTAMINATION_SQL,
    "op11_fill_in_middle": fim.DIGESTS_SQL,
    "op12_centroid_clustering": cluster.cluster_sql(),
}
