"""Recordings from WAV files to tables and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RECORDING = "rec_id string, path string, fs int, channels int, bit_depth int, n_frames long, duration double, sample_width int, file_size long, samples array<double>, samples_ch array<array<double>>"


def parse_wav(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """fs, channels, bits and samples in [-1, 1], a row per frame. 8 bits are unsigned; 16, 24 and 32 are signed, lowest byte first."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", chunk)
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if form is None or body is None:
        raise ValueError("no format or no data")
    channels, fs, bits = form[1], form[2], form[5]
    return fs, channels, bits, decode_pcm(body, channels, bits)


def decode_pcm(body: bytes, channels: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1], a row for each whole frame."""
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if bits == 8:
        x = (np.frombuffer(body, dtype=np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 2.0**23
    elif bits in (16, 32):
        x = np.frombuffer(body, dtype=f"<i{width}") / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"{bits} bits")
    return np.clip(x, -1, 1).reshape(-1, channels)


def read_wav(spark: SparkSession, path: str, *, target_fs: int | None = None, peak: float | None = None) -> DataFrame:
    """A row per *.wav file under path: what its header says, the mono samples and those of each channel.

    With target_fs the mono samples are resampled, with peak they are scaled to it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return decode_wav(files, target_fs=target_fs, peak=peak)


def decode_wav(files: DataFrame, *, target_fs: int | None = None, peak: float | None = None) -> DataFrame:
    """read_wav for (path, content), wherever these are stored."""
    from phonolake.functions.dsp import resample

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDING.replace(", ", ",").split(",")]
        for d in batches:
            out = []
            for p, data in zip(d["path"], d["content"], strict=True):
                fs, channels, bits, x = parse_wav(data)
                mono = x.mean(axis=1)
                rate = target_fs or fs
                mono = resample(mono, fs, rate) if rate != fs else mono
                if peak and np.abs(mono).max(initial=0) > 0:
                    mono = mono / np.abs(mono).max() * peak
                out.append((p.rsplit("/", 1)[-1][:-4], p, rate, channels, bits, len(mono), len(mono) / rate, bits // 8, len(data), mono.tolist(), x.T.tolist()))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(rows, RECORDING)


def wav_bytes(x: np.ndarray, fs: int, bits: int = 16) -> bytes:
    """PCM of samples in [-1, 1] (one channel, or a row per frame)."""
    x = np.clip(np.asarray(x, dtype=float), -1, 1)
    channels = 1 if x.ndim == 1 else x.shape[1]
    body = ((x + 1) * 127.5).astype(np.uint8) if bits == 8 else (x * 32767).astype("<i2") if bits == 16 else (x * 2147483647).astype("<i4")
    if bits == 24:
        body = (x * 8388607).astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3]
    body = body.tobytes()
    form = struct.pack("<HHIIHH", 1, channels, fs, fs * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def write_wav(recordings: DataFrame, bits: int = 16) -> DataFrame:
    """(rec_id, fs, samples) -> (rec_id, content), the bytes of a WAV file, to be saved as Parquet."""
    kind = dict(recordings.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"rec_id": d["rec_id"], "content": [wav_bytes(np.asarray(x), int(fs), bits) for fs, x in zip(d["fs"], d["samples"], strict=True)]})

    return recordings.select("rec_id", "fs", "samples").mapInPandas(rows, f"rec_id {kind}, content binary")


def list_dataset(files: DataFrame, n_train: int = 3) -> DataFrame:
    """(path) of root/label/name.wav -> (path, label, rep, split): each label's first n_train paths train."""
    label = F.regexp_extract("path", r"([^/]+)/[^/]+\.wav$", 1)
    rep = F.row_number().over(W.partitionBy("label").orderBy("path"))
    return files.select("path", label.alias("label")).filter("label <> ''").withColumn("rep", rep).withColumn("split", F.when(F.col("rep") <= n_train, "train").otherwise("test"))


def role_of(path: Column) -> Column:
    """enroll, dev or test, by the file's name."""
    return F.nullif(F.regexp_extract(path, r"(enroll|dev|test)[^/]*\.wav$", 1), F.lit(""))


METADATA = "unit_id string, label string, ascii string, candidate int, speaker string, duration_s double, rms double, path string"
RATINGS = "listener_id string, sentence string, method string, intelligibility int, naturalness_mos double, continuity_score double, overall_score double"
RESULTS = "file string, true string, pred string, top1_label string, top1_score double, top2_label string, top2_score double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers, that read_csv reads again; arrays become their numbers or words with spaces between them."""
    flat = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.csv(path, header=True, mode="overwrite")


def write_csv_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under its name."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}.csv")


def read_csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in schemas.items()}


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones) from lines "word phone phone ..."; blank lines, lines that begin with # and words alone are left out, and the last line
    of a word holds. Lines are ordered by file and place."""
    d = spark.read.text(path).select(F.trim("value").alias("value"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("line"))
    d = d.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select("line", F.split("value", r"\s+").alias("f")).filter(F.size("f") >= 2)
    return d.groupBy(F.get("f", F.lit(0)).alias("word")).agg(F.max(F.struct("line", F.slice("f", F.lit(2), F.size("f")).alias("phones"))).alias("last")).select("word", "last.phones")


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
