"""A training-data pipeline over documents: quality, language, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of
documents; what a stage drops or repeats stays dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistaframe.llm import bpe, langid, mixing, neardup, quality
from vistaframe.llm.common import table, written

#: Words of a shingle in the near-duplicate stage (similarity 0.8 or more).
SHINGLE = 5
#: Documents below this quality score go.
LEAST_QUALITY = quality.THRESHOLD
#: Documents whose best language is less probable than this go, as do texts without a letter.
LEAST_LANGUAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier, learned from the label table, accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    model = langid.fit(docs)
    return langid.recognised(docs, model, LEAST_LANGUAGE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return neardup.deduplicated(docs, SHINGLE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as its source's target asks."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; the ids and the digests of ids and decoded text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), digests=True, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: Trained models and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
