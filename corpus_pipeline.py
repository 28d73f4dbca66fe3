"""A training-data pipeline over ``documents``, made of operators of ``cairn.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.

Defined results: a null text is judged like an empty one by the classifier, has no lines, is
like no other document, isn't contaminated and counts no words.  Null ids and null sources are
kept as they are: a null source is a source.  Of rows that are alike one stays after the
near-duplicate stage, which takes ties by the smallest id, then by a digest of the text; rows
without words are like nothing and all stay.  Texts of any length are read whole; columns beyond
those of ``documents`` go in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from cairn.session import Stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the text; lines of copied pages are left to the next stage."""
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), unlike_pages=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts that share four of five 5-word shingles."""
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS), shingle=5, numerator=80, denominator=100, single_rows=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with ``repeat`` from 1."""
    return mixing.sample_mix(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The fitted classifier and the components can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Stored(spark)
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored.put(docs, name.replace(" ", "-"))
    return docs
