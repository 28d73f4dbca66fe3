"""Queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, mixing, ngram_join, privacy, quality, span_dedup, topk, url_filter
from .oracles import ORACLES

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("repeats")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.remove_repeats(_table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_words_removed", "removed", "text")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find_personal_data(_table(spark, sf_dir, "documents")).drop("text_key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_decontaminate, op2_license_scan, op3_line_dedup, op4_topk, op5_url_filter, op6_mix, op7_quality, op8_ngram_join, op9_span_dedup, op10_personal_data]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
