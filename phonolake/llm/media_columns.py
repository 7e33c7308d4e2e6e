"""Media columns: payloads as lossless WebP in binary columns of stored tables, and their pixel arrays and features read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import read, shared_folder
from phonolake.llm.encoding import slices
from phonolake.llm.webp import decode
from phonolake.llm.webp_writer import encode_images

#: Bytes of a row of pixels, 4 to a pixel, and rows of an image: longer payloads are several images, read in step.
ROW, ROWS = 576, 32


def payload_of(text: str | None) -> bytes:
    """UTF-8, with bytes 255 up to a positive multiple of a row."""
    b = (text or "").encode()
    return b + b"\xff" * (max(ROW, -(-len(b) // ROW) * ROW) - len(b))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload's images, one after the other. Bytes are blue, green, red and alpha of a pixel, in this order."""
    chunks = [(k, p[a : a + ROW * ROWS]) for k, p in enumerate(payloads) for a in range(0, len(p), ROW * ROWS)]
    out = [[] for _ in payloads]
    for (k, _), image in zip(chunks, encode_images([np.frombuffer(c, dtype="<u4").reshape(-1, ROW // 4) for _, c in chunks], ROW * ROWS // 4), strict=True):
        out[k].append(image)
    return [b"".join(images) for images in out]


def images_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


def pixel_arrays(media: list[bytes]) -> list[np.ndarray]:
    """For each its images' pixels, one below the other, as bytes: height x width x (blue, green, red, alpha)."""
    each = [images_of(m) for m in media]
    flat = iter(decode([i for images in each for i in images]))
    arrays = [np.concatenate([next(flat) for _ in images]) for images in each]
    return [np.ascontiguousarray(a).view(np.uint8).reshape(*a.shape, 4) for a in arrays]


def features(pixels: np.ndarray) -> str:
    """Size, mean and deviation of the samples, mean step from pixel to pixel of a row, and share of the most frequent value."""
    x = pixels.reshape(-1)
    counts = np.bincount(x, minlength=256)
    mean = float(counts @ np.arange(256)) / len(x)
    deviation = max(0.0, float(counts @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean()) if pixels.shape[1] > 1 else 0.0
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{mean:.4f}:{deviation:.4f}:{step:.4f}:{int(counts.argmax())}:{counts.max() / len(x):.4f}"


def store_media(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs: the text's UTF-8 bytes, and the images that hold them, padded.

    Null texts are empty; an empty one still has a row of padding. Texts of any length are images of ROWS rows, so that
    memory grows with a batch, and with a text's bytes where one text has more. Null ids and repeated rows are rows like
    any other, and equal texts have equal media. No rows: none come back. Other columns are not looked at.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            texts = batch.column("text").to_pylist()
            media = encode([payload_of(t) for t in texts])
            yield pa.record_batch([batch.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def load_media(media: DataFrame, *, rows: int = 4000, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_bytes, media) -> those, width, height, pixels (the pixel arrays' bytes) and feature.

    Rows are decoded together, up to so many or so many bytes of images at a time. Repeated rows come out as often; no
    rows: none come back.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            sums = np.cumsum(np.diff(_offsets(batch.column("media"))))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + most_bytes, "right")))
                yield batch.slice(start, end - start)
                start = end

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in turns(batches):
            arrays = pixel_arrays(batch.column("media").to_pylist())
            made = [pa.array([a.shape[1] for a in arrays], pa.int32()), pa.array([a.shape[0] for a in arrays], pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array([features(a) for a in arrays])]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, "width", "height", "pixels", "feature"])

    d = media.select("doc_id", "n_bytes", "media")
    return d.mapInArrow(load, "doc_id long, n_bytes long, media binary, width int, height int, pixels binary, feature string")


def _offsets(a: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], dtype=width)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written as a table in the shared folder, from which the result is read."""
    path = shared_folder(spark, "media")
    # zstd takes up the prefix codes that all images begin with
    store_media(read(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    out = load_media(spark.read.parquet(path))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
