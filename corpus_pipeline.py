"""From documents to token ids in five stages; each is written as Parquet and read again by the next.

Defined results: a null or empty text is scored as any other, counts as equal to all empty ones (one stays), is linked with
nothing, holds no benchmark item and is encoded as the end id; rows without an id stay as near copies, and leave together
where one of them holds a benchmark item, as that filter goes by id; of rows that repeat both id and text one stays; empty documents give an empty result, and without labels of both kinds every score is their share.
Columns of documents with any names pass through all stages but the last, which returns the id and its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import decontaminate, exact_dedup, ngram_join, quality, sentencepiece_codec
from tracelens.llm.common import stored, table
from tracelens.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.without_duplicates(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the end id, and digests of them and of what they decode to."""
    return sentencepiece_codec.digests(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier, the alignment and the encoding can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
