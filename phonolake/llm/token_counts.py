"""Token counts: an exact histogram of encoded lengths, and what it says for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.llm.common import read
from phonolake.llm.encoding import encoder, slices, vocabulary

#: Lengths are summed in blocks of so many, and blocks among each other.
BLOCK = 1024


def lengths(docs: DataFrame, *, text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """The encoded length of each text as n_tokens, a row for each row of docs, repeated ones too; a null or empty text has 0.

    Texts are encoded whole, however long. No rows: none come back. Other columns of docs are not looked at.
    """
    files = files or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*files)
        for batch in slices(batches, 2500):
            yield pa.record_batch([pa.array([len(x) >> 2 for x in own.packed(batch.column(0).to_pylist())], pa.int64())], names=["n_tokens"])

    return docs.select(text).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, **options) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length that occurs, each repeated row counted. No rows: none come back."""
    return lengths(docs, **options).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length taken as a context limit: sums over the documents at, beyond and below it.

    n_tokens, n_docs; docs_from, tokens_from: documents of that length or longer and their tokens; truncated_total: tokens
    left when each document is cut to the limit; docs_to: documents of that length or shorter; share_to: their share
    of all, so the q-quantile is the least n_tokens with share_to >= q. Documents of one length are one row. Suffix sums run
    within blocks of lengths and over the blocks' sums: there are as many blocks as the longest text has thousands of
    tokens at most, whatever the number of documents. No rows: none come back.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(everything).alias("docs"), F.sum("bt").over(everything).alias("tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.withColumn("docs_from", F.sum("n_docs").over(inside)).withColumn("tokens_from", F.sum("t").over(inside)).join(blocks, "block")
    h = h.withColumn("docs_from", F.col("docs_from") + F.col("ad")).withColumn("tokens_from", F.col("tokens_from") + F.col("at"))
    docs_to = F.col("docs") - F.col("docs_from") + F.col("n_docs")
    return h.select("n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"), docs_to.alias("docs_to"), (docs_to / F.col("docs")).alias("share_to"))


def answers(table: DataFrame, contexts: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, at, value): the truncated total for each context limit, those between lengths included, and quantiles of lengths.

    A limit beyond all lengths cuts nothing: it gets the sum of all tokens.
    """
    total = F.max(F.col("truncated_total"))
    above = [F.min(F.when(F.col("n_tokens") >= c, F.struct("n_tokens", "truncated_total", "docs_from"))) for c in contexts]
    cut = [F.coalesce(x["truncated_total"] - (x["n_tokens"] - F.lit(c)) * x["docs_from"], total) for x, c in zip(above, contexts, strict=True)]
    at = [F.min(F.when(F.col("share_to") >= q, F.col("n_tokens"))) for q in quantiles]
    one = table.agg(F.array(*[F.struct(F.lit("context").alias("kind"), F.lit(float(c)).alias("at"), x.cast("long").alias("value")) for c, x in zip(contexts, cut, strict=True)], *[F.struct(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), x.cast("long").alias("value")) for q, x in zip(quantiles, at, strict=True)]).alias("a"))
    return one.select(F.inline("a"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(length_histogram(read(spark, sf_dir, "documents")))
