"""WAV files as a data source: reading by byte ranges of the data chunk, writing with a commit.

    spark.dataSource.register(WavDataSource)
    spark.read.format("wav").load(folder)      # blocks of frames of all *.wav files below
    blocks.write.format("wav").save(folder)    # a file for each name

Files are reached through pyarrow's file systems (local and shared folders, S3, GCS, HDFS), by the path's scheme.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from phonolake.sources.audio import decode_pcm, wav_bytes

SCHEMA = "path string, file_size long, fs int, channels int, bit_depth int, n_frames long, at long, samples array<double>, samples_ch array<array<double>>"
#: Bytes of a partition, and frames of a row.
SPLIT, FRAMES = 32 << 20, 1 << 14
#: Frames of a file that is written at most: a longer recording is several files, and many tasks' work.
FILE_FRAMES = 1 << 24


def file_system(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Form:
    """What a file's header says, and where its samples are."""

    fs: int
    channels: int
    bits: int
    start: int
    n_frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def read_form(file, size: int) -> Form:
    """Reads chunk headers from the front until that of the data; chunks between are skipped, not read. A data chunk that is said to be longer
    than the file ends with it."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            if form is None or not form[1] or form[5] not in (8, 16, 24, 32):
                break
            return Form(form[2], form[1], form[5], at + 8, min(length, size - at - 8) // (form[1] * form[5] // 8))
        at += 8 + length + (length & 1)
    raise ValueError("no format or no data")


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, size, from, to)."""

    ranges: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split, self.frames = int(options.get("splitBytes", SPLIT)), int(options.get("blockFrames", FRAMES))
        self.least = int(options.get("partitions", 0))

    def partitions(self) -> list[InputPartition]:
        """Files are listed by size, not opened; long ones are cut, short ones share a partition. Where ranges are shorter than SPLIT and more than the
        partitions asked for, neighbours share one, so that short ranges do not make a task each."""
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, left = [[]], self.split
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".wav") and "/_" not in f.path.removeprefix(root)), key=lambda f: f.path):
            at = 0
            while at < f.size:
                n = min(left, f.size - at)
                out[-1].append((f.path, f.size, at, at + n))
                at, left = at + n, left - n
                if not left:
                    out.append([])
                    left = self.split
        length = lambda r: sum(hi - lo for _, _, lo, hi in r)
        most = min(SPLIT, sum(map(length, out)) // self.least) if self.least else 0
        shared, held = [], 0
        for r in filter(None, out):
            if not shared or held + length(r) > max(self.split, most):
                shared.append([])
                held = 0
            shared[-1] += r
            held += length(r)
        return [Ranges(r) for r in shared] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        """The frames whose first byte lies in the partition's ranges."""
        system, _ = file_system(self.path)
        for path, size, lo, hi in partition.ranges:
            with system.open_input_file(path) as file:
                form = read_form(file, size)
                frame_at = lambda byte: min(max(-(-(byte - form.start) // form.frame), 0), form.n_frames)  # noqa: B023, E731
                if lo == 0 and not form.n_frames:
                    yield path, size, form.fs, form.channels, form.bits, 0, 0, [], [[] for _ in range(form.channels)]
                a, b = frame_at(lo), frame_at(hi)
                while a < b:
                    n = min(b, (a // self.frames + 1) * self.frames) - a
                    file.seek(form.start + a * form.frame)
                    x = decode_pcm(file.read(n * form.frame), form.channels, form.bits)
                    yield path, size, form.fs, form.channels, form.bits, form.n_frames, a, x.mean(axis=1).tolist(), x.T.tolist()
                    a += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    """Tasks write files under a folder of their own; the driver moves those of the tasks that count to their places, and writes _SUCCESS last."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        import uuid

        self.path, self.bits, self.overwrite = options["path"].rstrip("/"), int(options.get("bits", 16)), overwrite
        self.attempt = f"_temporary/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Rows (name, fs, at, samples), those of a name one after the other and in order of at."""
        import uuid

        system, root = file_system(self.path)
        folder, done, parts, last = f"{root}/{self.attempt}/{uuid.uuid4().hex}", [], [], None
        system.create_dir(folder, recursive=True)

        def finish() -> None:
            name, fs = last
            own = f"{folder}/{len(done)}.wav"
            with system.open_output_stream(own) as out:
                out.write(wav_bytes(np.concatenate(parts), fs, self.bits))
            done.append((own, f"{root}/{name}.wav"))

        for r in rows:
            key = (r["name"], int(r["fs"]))
            if last not in (None, key):
                finish()
                parts = []
            last = key
            parts.append(np.asarray(r["samples"], dtype=float))
        if last is not None:
            finish()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, root = file_system(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.base_name != "_temporary":
                    (system.delete_file if f.is_file else system.delete_dir)(f.path)
        files = [x for m in messages if m is not None for x in m.files]
        for folder in sorted({place.rsplit("/", 1)[0] for _, place in files}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for _ in pool.map(lambda x: system.move(*x), files):
                pass
        system.create_dir(root, recursive=True)
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options, overwrite)


def write_wav_files(blocks: DataFrame, path: str, bits: int = 16, file_frames: int = FILE_FRAMES) -> None:
    """(rec_id, fs, at, samples) -> rec_id.wav under path, or, of recordings of file_frames or more, rec_id-<k>.wav for each so many frames.

    Blocks of a recording must not overlap, and none may reach from one file to the next: those of blocks.to_blocks do not, if their size divides file_frames.
    """
    blocks.sparkSession.dataSource.register(WavDataSource)
    part = F.floor(F.col("at") / file_frames)
    name = F.concat(F.col("rec_id").cast("string"), F.when(part > 0, F.concat(F.lit("-"), part.cast("string"))).otherwise(""))
    d = blocks.select(name.alias("name"), F.col("fs").cast("int").alias("fs"), F.col("at").cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples"))
    d.repartition("name").sortWithinPartitions("name", "at").write.format("wav").option("bits", bits).mode("overwrite").save(path)


def read_wav_blocks(spark, path: str, split_bytes: int = SPLIT, block_frames: int = FRAMES) -> DataFrame:
    """A row for each block of frames of each *.wav file under path, with what its header says; empty files have one row without samples.
    Ranges have so many bytes at most; short ones share tasks, of which there are four for each core, or more."""
    spark.dataSource.register(WavDataSource)
    return spark.read.format("wav").option("partitions", 4 * spark.sparkContext.defaultParallelism).option("splitBytes", split_bytes).option("blockFrames", block_frames).load(path)
