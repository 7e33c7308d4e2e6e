"""A corpus pipeline: language ID, line dedup, near duplicates, mixing sources, and token ids.

Each stage takes texts of any length whole, an empty table to an empty one, and columns of any names along; null ids are ids
like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import remove_folder, shared_folder
from phonolake.llm.language_id import keep_identified
from phonolake.llm.line_dedup import line_dedup
from phonolake.llm.ngram_join import keep_one
from phonolake.llm.pareto_mix import mix
from phonolake.llm.tree_bpe import digests


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is likely enough go, null, empty and blank texts among them; repeated rows stay as often."""
    return keep_identified(docs, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go from all of them; n_chars is counted anew. Every row stays, one that loses all lines with an empty text."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least id stays, and one of repeated rows; texts without words are linked with nothing and stay."""
    return keep_one(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture takes them; a null source is one of the sources, and texts without words come as their source's share has it."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of the texts that they decode to, a row for each row; null texts are empty and have no ids."""
    return digests(docs)


STAGES = [("language ID", languages), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing sources", sources), ("token ids", tokens)]

#: Hashing tokenizers and language models is beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read by the next one.

    A stage's folder goes when the next one is written; the last one's stays, for the result is read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
