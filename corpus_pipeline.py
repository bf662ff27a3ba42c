"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.  The near-dedup and
packing stages call their operators with the values of their queries.  Nulls, empty
tables and repeated rows are handled as the operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mailsieve.llm import decontaminate, langid, linededup, packing, simhash
from mailsieve.llm.queries import TOKENIZER
from mailsieve.session import checkpoint_dir, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or close to none, go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; a document of which nothing is left goes."""
    return linededup.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark text goes."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 1024 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack_sequences),
]

#: patience alignment, iterated components and the genetic algorithm have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
