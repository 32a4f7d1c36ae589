"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of documents.

Defined results of the stages that filter: a row is judged by its id and text, so rows repeated with both go or stay together (but for near
duplicates, of which one stays); a null id is an id; columns that are not read, of any names and with any nulls, stay as they are; very long texts are
read whole; an empty table passes as an empty table. The operators' modules say what null and empty texts and ties give: language ID rejects
texts without letters, the quality classifier scores them as texts without words, texts without words are near duplicates of nothing
and hold no benchmark window, and packing gives a null text its end token alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.llm import decontaminate, jaccard, language, packing, quality
from rill.llm.common import discard, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return language.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by rules learned from all labels go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.keep_one(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens. Executors still hold what earlier stages took, so the encoder
    works in smaller calls and with a smaller cache."""
    return packing.pack(docs, call_bytes=2_000_000, cached=200_000)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no models, minimum-hash clusters or tokenizers; stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
            if k:
                discard(before)
    return docs
