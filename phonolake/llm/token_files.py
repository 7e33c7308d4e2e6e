"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.llm.common import checkpointed, read, shared_folder
from phonolake.llm.encoding import encoder, slices, vocabulary

#: Stripes of 16 MB let many tasks share a file; each 10,000 rows have an index entry and a Bloom filter.
ORC_OPTIONS = {"orc.stripe.size": 16 << 20, "orc.row.index.stride": 10_000, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}


def token_ids(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 2, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs, order and partitions kept, repeated rows and null ids too.

    A null text is an empty one and has the end id alone; texts are encoded whole, however long. No rows: none come
    back. Other columns of docs are not looked at.
    """
    files = files or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*files)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 2500):
            each = own.packed(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(x) + len(end) >> 2 for x in each)])
            ids = np.frombuffer(b"".join([p for x in each for p in (x, end)]), dtype="<i4")
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 2, files: tuple[str, str] | None = None) -> None:
    """Writes (doc_id, ids) of docs as ORC, ids ascending within and across files, null ids first.

    Texts are dealt out by ranges of doc_id (then of a hash of the text, so that one id can't fill a task) and sorted
    before they are encoded: looking for the ranges reads no more than the ids and texts. Repeated rows are written as often,
    null texts as empty ones. No rows: a file without rows, or none.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.xxhash64(F.lit(7), "text"))
    d = d.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    token_ids(d, end_id=end_id, files=files).write.format("orc").options(**ORC_OPTIONS).save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Rows are summed within their files and files among each other, so no task sees more than a file's rows. Rows of one
    id follow each other in the order of their files, equal rows in any. The window over files has a row for each file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("file"), batch.column("place"), batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    stored = spark.read.schema("doc_id long, ids array<int>").orc(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"), "doc_id", "ids")
    # a few numbers for each document, read twice below
    rows = checkpointed(stored.mapInArrow(digest, "file string, place long, doc_id long, n_tokens long, ids_crc32 long"))
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"), F.min(F.struct("doc_id", "file")).alias("first"))
    before = sums.withColumn("before", F.sum("in_file").over(W.orderBy("first")) - F.col("in_file")).select("file", "before")
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "place").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
