"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes what each returns as Parquet in the
shared folder and gives it to the next. All stages but the last return the columns of documents.

Nulls, empty tables, very long texts, repeated rows and further columns (whatever their names) pass through as each
operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm import bpe, decontaminate, line_dedup, shingle_join, simhash, toxicity
from lumaframe.llm.common import fold, modest_batches, saved, short_lived_shuffles, table
from lumaframe.llm.queries import TOKENIZER


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated toxicity is at least 0.5; learns from the labelled ones."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) > 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.clean(docs, toxicity.fit(docs, labels), threshold=0.5)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the lines that ten or more documents share out of the texts; every document stays."""
    return line_dedup.clean(docs, min_docs=10, min_chars=1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    Candidates come from the SimHash index (two bits) and, for those it does not reach, from one of the shingles; all are compared exactly.
    """
    return simhash.one_of_each(docs, shingle_join.near_groups(docs, size=5, similarity=0.8))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold half of a benchmark item or more."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and what they decode to; by the last stage tasks hold memory of the others, so its caches are small."""
    return bpe.encoded(docs, TOKENIZER, cache=60_000, index_bytes=1 << 20)


def _stage(function):
    """The function with fewer rows than Spark's default going to Python at once: texts may be long."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        modest_batches(spark)
        short_lived_shuffles(spark)
        return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _stage(without_toxic)),
    ("line dedup", _stage(without_common_lines)),
    ("simhash near-dedup", _stage(one_of_each_group)),
    ("benchmark decontamination", _stage(without_benchmark)),
    ("bpe", _stage(tokens)),
]

#: SQL expresses neither the trees, the tiles nor the merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
