"""Raw documents to packed sequences, a stage after the other.

Each stage takes (spark, docs, sf_dir); docs are the rows that the stage before kept. Stages but the last return the
columns of documents, with n_chars of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceweave.llm.common import cut, read
from priceweave.llm.decontaminate import decontaminate
from priceweave.llm.jaccard import keep_first
from priceweave.llm.line_dedup import clean_lines
from priceweave.llm.packing import pack_documents
from priceweave.llm.quality import keep_good


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays; a document that held nothing else goes."""
    return _counted(clean_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return keep_first(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the benchmark's windows cover is cut out of the texts."""
    return _counted(decontaminate(docs, read(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL cannot express a fitted classifier, edit distances or a tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
