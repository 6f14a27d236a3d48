"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``.

Defined cases, on the way through all stages: a null or empty text is scored as an
empty one and goes or stays by that score; line dedup and decontamination leave null
and empty texts as they are; near dedup treats all texts without words as copies of
each other and keeps one; null texts encode to no ids.  Rows that repeat in id and
text are cut alike, and near dedup keeps one of them.  Texts are processed whole,
however long.  Ties go to the smaller id (a null id first in line dedup, last in near dedup).  Columns beyond those of
``documents`` pass through; an empty table gives an empty result with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, fmindex, linededup, quality, simhash
from corpusmill.llm.common import cut, read
from corpusmill.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out of the texts."""
    ship_package(spark)
    return linededup.line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return fmindex.remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    ship_package(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: Trained scores, fingerprints and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
