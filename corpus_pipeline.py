"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``cdm_engine.llm``, reads what the stage before it kept (a Parquet table
in the shared folder) and returns the columns of documents; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cdm_engine.llm import decontaminate, langid, packing, simhash_dedup, suffix_dedup
from cdm_engine.llm._store import materialize, release
from cdm_engine.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language the models reject (no letters, or unlike any learned language)."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: Jaccard 0.8 on five-word shingles."""
    return simhash_dedup.keep_unlike(docs, size=5, least=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start in more than one place."""
    return suffix_dedup.cut_repeats(docs, width=200)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a benchmark window occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs, vocabulary_path(), capacity=4096, end_id=1)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", leaks),
    ("best-fit packing", sequences),
]

#: No stage but the fourth can be written in SQL: run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)  # the stage after it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
