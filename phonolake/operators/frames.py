"""Framing and frame features on arrays: (rec_id, samples) -> (rec_id, frame_idx, t_center, frame) -> numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from phonolake.operators.blocks import with_recording
from phonolake.operators.evaluation import exact_quantiles
from phonolake.sources.folders import checkpointed

from phonolake.functions import dsp
from phonolake.functions.columns import make_window, total


def frame_signal(recordings: DataFrame, fs: int, size: int = 400, hop: int = 160, window: str | None = "hamming") -> DataFrame:
    """max(1, 1 + (N - size) // hop) frames of each recording, a short one padded with zeros, times a symmetric window."""
    n = F.size("samples")
    count = F.greatest(F.lit(1), 1 + F.floor((n - size) / hop).cast("int"))
    d = recordings.filter(n > 0).withColumn("samples", F.concat("samples", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - n))))
    d = d.select("rec_id", "samples", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_idx"))
    frame = F.slice("samples", F.col("frame_idx") * hop + 1, F.lit(size))
    if window:
        frame = F.zip_with(frame, make_window(window, size), lambda x, w: x * w)
    return d.select("rec_id", "frame_idx", ((F.col("frame_idx") * hop + size / 2) / fs).alias("t_center"), frame.alias("frame"))


def frame_energy_features(frames: DataFrame) -> DataFrame:
    """Adds energy, magnitude, rms and log_energy."""
    f = F.col("frame")
    d = frames.withColumn("energy", total(F.transform(f, lambda x: x * x))).withColumn("magnitude", total(F.transform(f, F.abs)))
    return d.withColumn("rms", F.sqrt(F.col("energy") / F.size("frame"))).withColumn("log_energy", 10 * F.log10(F.col("energy") + 1e-10))


def frame_zcr(frames: DataFrame) -> DataFrame:
    """Adds zcr: sum of |differences of signs| over 2 L, zeros counting as positive."""
    signs = F.transform("frame", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))
    size = F.size("frame")
    steps = F.zip_with(F.slice(signs, F.lit(2), size - 1), F.slice(signs, F.lit(1), size - 1), lambda a, b: F.abs(a - b))
    return frames.withColumn("zcr", total(steps) / (2 * size))


def by_frame(frames: DataFrame, f: Callable[[np.ndarray], list[np.ndarray]], added: str) -> DataFrame:
    """Adds columns of numbers, or of arrays of them, that f makes of a stack of frames of one length (rows x samples)."""
    schema = T.StructType([*frames.schema.fields, *T._parse_datatype_string(added).fields])
    kinds = to_arrow_schema(T._parse_datatype_string(added))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.column("frame")
            starts, sizes, x = frame.offsets.to_numpy()[:-1], np.diff(frame.offsets.to_numpy()), frame.values.to_numpy(zero_copy_only=False)
            made: list[list] = [[None] * len(sizes) for _ in kinds]
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                for out, v in zip(made, f(x[starts[at][:, None] + np.arange(n)]), strict=True):
                    for k, row in zip(at.tolist(), v, strict=True):
                        out[k] = row
            yield pa.record_batch([*batch.columns, *(pa.array(v, kind.type) for v, kind in zip(made, kinds, strict=True))], names=[*batch.schema.names, *kinds.names])

    return frames.mapInArrow(add, schema)


def frame_autocorr(frames: DataFrame, max_lag: int) -> DataFrame:
    """Adds r: the autocorrelation up to max_lag over that at lag 0 (as it is if that is 0); batches of frames are stacked."""

    def r(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        out = np.stack([np.einsum("ij,ij->i", x[:, : n - k], x[:, k:]) for k in range(min(max_lag, n - 1) + 1)], axis=1)
        return [out / np.where(out[:, :1] > 0, out[:, :1], 1.0)]

    return by_frame(frames, r, "r array<double>")


def estimate_pitch(frames: DataFrame, fs: int, f0_min: float = 60.0, f0_max: float = 400.0, least: float = 0.3) -> DataFrame:
    """Adds f0: fs over the first lag between fs / f0_max and fs / f0_min with the highest autocorrelation, 0 if that is under least."""
    lo, hi = int(fs / f0_max), int(fs / f0_min)
    d = frame_autocorr(frames, hi)
    part = F.slice("r", F.lit(lo + 1), F.lit(hi - lo + 1))
    best = F.array_max(part)
    lag = F.array_position(part, best) - 1 + lo
    return d.withColumn("f0", F.when(F.coalesce(best, F.lit(0.0)) >= least, fs / F.nullif(lag, F.lit(0))).otherwise(0.0)).drop("r")


def hann_pitch(frames: DataFrame, fs: int, f0_min: float = 70.0, f0_max: float = 400.0) -> DataFrame:
    """Adds f0 and lag to frames without a window: the highest autocorrelation by FFT, under a Hann window, whatever it is."""
    return by_frame(frames, lambda x: [*dsp.hann_pitch(x, fs, f0_min, f0_max)], "f0 double, lag int")


def f0_contour(frames: DataFrame, fs: int, hann: bool = False, **options) -> DataFrame:
    """(rec_id, frame_idx, t_center, f0, mean_f0), the mean over voiced frames of the recording; by hann_pitch, if hann."""
    d = (hann_pitch if hann else estimate_pitch)(frames, fs, **options).select("rec_id", "frame_idx", "t_center", "f0")
    return d.withColumn("mean_f0", F.avg(F.when(F.col("f0") > 0, F.col("f0"))).over(W.partitionBy("rec_id")))


def voicing(features: DataFrame, below: float = 35.0, zcr: float = 0.08) -> DataFrame:
    """Adds kind to rows with log_energy and zcr: silence under the recording's highest level by below, else voiced or unvoiced."""
    top = F.max("log_energy").over(W.partitionBy("rec_id"))
    return features.withColumn("kind", F.when(F.col("log_energy") < top - below, "silence").when(F.col("zcr") < zcr, "voiced").otherwise("unvoiced"))


def voicing_segments(features: DataFrame, **options) -> DataFrame:
    """Counts and shares of the kinds of frames."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    d = voicing(features, **options).groupBy("rec_id").agg(F.count("*").alias("n_frames"), *[n(k).alias(f"n_{k}") for k in ("silence", "voiced", "unvoiced")])
    return d.withColumns({f"pct_{k}": 100 * F.col(f"n_{k}") / F.col("n_frames") for k in ("silence", "voiced", "unvoiced")})


def endpoint_detect(features: DataFrame, lengths: DataFrame, size: int, hop: int, top_db: float = 30.0, zcr_thresh: float | None = 0.15, margin: int = 4) -> DataFrame:
    """(rec_id, frame_idx, log_energy, zcr) and (rec_id, len) -> (rec_id, first_frame, last_frame, start, end) in samples.

    Frames within top_db of the recording's highest level count; at each onset and offset one more does if its zcr is
    zcr_thresh or above. Then margin frames on both sides. Without zcr_thresh nothing grows, and the end is one hop later.
    """
    by = W.partitionBy("rec_id")
    near = by.orderBy("frame_idx")
    d = features.withColumn("loud", F.col("log_energy") >= F.max("log_energy").over(by) - top_db)
    if zcr_thresh is not None:
        edge = F.coalesce(F.lead("loud").over(near), F.lit(False)) | F.coalesce(F.lag("loud").over(near), F.lit(False))
        d = d.withColumn("edge", edge).withColumn("loud", F.col("loud") | (F.col("edge") & (F.col("zcr") >= zcr_thresh)))
    d = d.groupBy("rec_id").agg(F.min(F.when(F.col("loud"), F.col("frame_idx"))).alias("a"), F.max(F.when(F.col("loud"), F.col("frame_idx"))).alias("b"), F.max("frame_idx").alias("most"))
    d = d.join(lengths, "rec_id").select("rec_id", F.greatest(F.col("a") - margin, F.lit(0)).alias("first_frame"), F.least(F.col("b") + margin, F.col("most")).alias("last_frame"), "len")
    end = (F.col("last_frame") + (0 if zcr_thresh is not None else 1)) * hop + size
    return d.select("rec_id", "first_frame", "last_frame", (F.col("first_frame") * hop).alias("start"), F.least(end, F.col("len")).alias("end"))


def trim_report(bounds: DataFrame, lengths: DataFrame, fs: int) -> DataFrame:
    """Seconds before and after, and milliseconds removed."""
    d = bounds.join(lengths, "rec_id")
    after = (F.col("end") - F.col("start")) / fs
    return d.select("rec_id", (F.col("len") / fs).alias("before_s"), after.alias("after_s"), (1000 * (F.col("len") / fs - after)).alias("removed_ms"))


def transient_detect(energies: DataFrame, share: float = 0.92) -> DataFrame:
    """(rec_id, frame_idx, energy) -> frames where the energy, averaged over five frames (zeros beyond the ends), changes by
    more than that share of the recording's changes."""
    near = W.partitionBy("rec_id").orderBy("frame_idx")
    d = energies.withColumn("smooth", F.sum("energy").over(near.rowsBetween(-2, 2)) / 5)
    d = d.withColumn("change", F.coalesce(F.abs(F.col("smooth") - F.lag("smooth").over(near)), F.lit(0.0)))
    d = checkpointed(d.select("rec_id", "frame_idx", "change"))
    limit = exact_quantiles(d.select("rec_id", F.col("change").alias("v")), share).withColumnRenamed("quantile", "limit")
    d = with_recording(d, d.groupBy("rec_id").agg(F.count("*").alias("frames")).join(limit, "rec_id"), "frames")
    # as decimals, so that the frame which is the limit itself is not beyond it by its last bits
    number = lambda c: F.col(c).cast("decimal(28,12)")
    return d.filter(number("change") > number("limit")).select("rec_id", "frame_idx", "change", "limit")


def dataset_qa(recordings: DataFrame, fs: int) -> DataFrame:
    """(rec_id, label, split, samples) -> for each label and split: files, mean duration, mean peak in dB and clipped samples."""
    from phonolake.functions.columns import to_db

    peak = to_db(F.array_max(F.transform("samples", F.abs)))
    clipped = F.size(F.filter("samples", lambda x: F.abs(x) >= 0.999))
    d = recordings.select("label", "split", (F.size("samples") / fs).alias("duration"), peak.alias("peak_db"), clipped.alias("clipped"))
    return d.groupBy("label", "split").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"), F.avg("peak_db").alias("mean_peak_db"), F.sum("clipped").alias("clipped"))


def dims(vec: Column) -> Column:
    """Rows (dim, v) of a vector."""
    return F.posexplode(vec).alias("dim", "v")


def _times(k: float):
    return lambda x: k * x


def delta(features: DataFrame, win: int = 2) -> DataFrame:
    """(rec_id, frame_idx, vec) -> vec replaced by sum of k (c[t+k] - c[t-k]) over 2 sum of k^2 + 1e-10, edges repeated."""
    w = W.partitionBy("rec_id").orderBy("frame_idx")
    everything = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = features.withColumn("_first", F.first("vec").over(everything)).withColumn("_last", F.last("vec").over(everything))
    for k in range(1, win + 1):
        d = d.withColumn(f"_a{k}", F.coalesce(F.lead("vec", k).over(w), F.col("_last"))).withColumn(f"_b{k}", F.coalesce(F.lag("vec", k).over(w), F.col("_first")))
    sums = None
    for k in range(1, win + 1):
        part = F.transform(F.zip_with(f"_a{k}", f"_b{k}", lambda a, b: a - b), _times(k))
        sums = part if sums is None else F.zip_with(sums, part, lambda a, b: a + b)
    scale = 2 * sum(k * k for k in range(1, win + 1)) + 1e-10
    return d.withColumn("vec", F.transform(sums, lambda x: x / scale)).drop("_first", "_last", *[f"_{s}{k}" for s in "ab" for k in range(1, win + 1)])


def cmvn(features: DataFrame, variance: bool = True) -> DataFrame:
    """Subtracts each dimension's mean over the recording, and divides by its deviation + 1e-8."""
    d = features.select("rec_id", "frame_idx", dims(F.col("vec")))
    by = W.partitionBy("rec_id", "dim")
    v = F.col("v") - F.avg("v").over(by)
    d = d.withColumn("y", v / (F.stddev_pop("v").over(by) + 1e-8) if variance else v)
    return d.groupBy("rec_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "y"))), lambda s: s["y"]).alias("vec"))


def feature_shapes(features: DataFrame) -> DataFrame:
    """Frames and dimensions of each recording."""
    return features.groupBy("rec_id").agg(F.count("*").alias("n_frames"), F.max(F.size("vec")).alias("n_dims"))
