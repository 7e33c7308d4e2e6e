"""Spectra, filters and enhancement on recordings (rec_id, samples). One recording or batch of frames at a time goes through NumPy."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.functions import dsp
from phonolake.functions.columns import power_to_db, to_db


def per_recording(recordings: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (rec_id, *f(samples)) for each recording; schema names what follows rec_id."""
    names = ["rec_id", *(c.strip().split()[0] for c in _columns(schema))]
    kind = dict(recordings.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = [(r, *x) for r, s in zip(d["rec_id"], d["samples"], strict=True) if s is not None and len(s) for x in f(np.asarray(s, dtype=float))]
            yield pd.DataFrame(out, columns=names)

    return recordings.select("rec_id", "samples").mapInPandas(rows, f"rec_id {kind}, {schema}")


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def spectra_rows(recordings: DataFrame, fs: float, nfft: int | None = None, window: str = "hamming") -> DataFrame:
    """(rec_id, f_hz array, mag_db array, delta_f) of the one-sided spectrum, a row for each recording."""

    def one(x: np.ndarray) -> list[tuple]:
        n = nfft or dsp.next_pow2(len(x))
        return [((np.arange(n // 2 + 1) * fs / n).tolist(), dsp.to_db(np.abs(dsp.one_sided(x, dsp.window(window, len(x)), n))).tolist(), fs / n)]

    return per_recording(recordings, one, "f_hz array<double>, mag_db array<double>, delta_f double")


def fft_spectrum(recordings: DataFrame, fs: float, nfft: int | None = None, window: str = "hamming") -> DataFrame:
    """(rec_id, k, f_hz, mag, mag_db, power_db, phase, delta_f, true_res) of the one-sided spectrum.

    Tasks make two arrays for each recording; bins become rows, and levels are worked out, in Spark.
    """

    def one(x: np.ndarray) -> list[tuple]:
        n = nfft or dsp.next_pow2(len(x))
        s = dsp.one_sided(x, dsp.window(window, len(x)), n)
        return [(len(x), n, np.abs(s), np.angle(s))]

    d = per_recording(recordings, one, "len int, nfft int, mag array<double>, phase array<double>")
    d = d.select("rec_id", "len", "nfft", F.posexplode(F.arrays_zip("mag", "phase")).alias("k", "z")).select("rec_id", "len", "nfft", "k", "z.mag", "z.phase")
    return d.select("rec_id", "k", (F.col("k") * float(fs) / F.col("nfft")).alias("f_hz"), "mag", to_db(F.col("mag")).alias("mag_db"), power_to_db(F.col("mag") * F.col("mag")).alias("power_db"), "phase", (float(fs) / F.col("nfft")).alias("delta_f"), (float(fs) / F.col("len")).alias("true_res"))


def compare_nfft(recordings: DataFrame, fs: float, sizes: tuple[int, ...] = (64, 256)) -> DataFrame:
    """The spectra at several sizes, one below the other."""
    out = None
    for n in sizes:
        d = fft_spectrum(recordings, fs, n).withColumn("nfft", F.lit(n))
        out = d if out is None else out.unionAll(d)
    return out


def bases(v: np.ndarray) -> np.ndarray:
    """For each place the lowest value between it and the next higher one before it, or the beginning: a stack of falling values keeps the lowest
    one between its neighbours, so each place goes on it and off it once."""
    out, stack = np.empty(len(v)), []
    for k, x in enumerate(v.tolist()):
        low = x
        while stack and stack[-1][0] <= x:
            low = min(low, stack.pop()[1])
        out[k] = low
        stack.append((x, low))
    return out


def apart(at: np.ndarray, gap: int) -> list[int]:
    """Of places, the best first, those that no earlier chosen one is within gap of: an ordered list tells the neighbours."""
    chosen, found = [], []
    for k in at.tolist():
        i = bisect_left(found, k)
        if (i == 0 or k - found[i - 1] >= gap) and (i == len(found) or found[i] - k >= gap):
            found.insert(i, k)
            chosen.append(k)
    return chosen


def spectral_peaks(spectra: DataFrame, n_peaks: int = 6, min_db: float = -60.0, min_freq: float = 20.0, prominence: float = 3.0) -> DataFrame:
    """(rec_id, f_hz array, mag_db array, delta_f) -> each spectrum's strongest peaks, at least max(3, 20 Hz) bins apart and prominence above the
    higher of the lowest levels on their sides before a higher one. Spectra come as rows; each takes one sort and two passes."""
    kind = dict(spectra.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for rec, f, v, step in zip(d["rec_id"], d["f_hz"], d["mag_db"], d["delta_f"], strict=True):
                v = np.asarray(v, dtype=float)
                at = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) + 1
                at = at[v[at] >= min_db]
                chosen = np.array(apart(at[np.argsort(-v[at], kind="stable")], max(3, int(20 / step))), dtype=int)
                above = v - np.maximum(bases(v), bases(v[::-1])[::-1])
                chosen = chosen[(above[chosen] >= prominence) & (np.asarray(f)[chosen] > min_freq)][:n_peaks]
                out += [(rec, i, int(k), float(f[k]), float(v[k])) for i, k in enumerate(chosen, 1)]
            yield pd.DataFrame(out, columns=["rec_id", "rank", "k", "f_hz", "mag_db"])

    return spectra.select("rec_id", "f_hz", "mag_db", "delta_f").mapInPandas(rows, f"rec_id {kind}, rank int, k int, f_hz double, mag_db double")


def formula_window(name: str, n: int) -> np.ndarray:
    """A symmetric window as its formula has it, cosines being the C library's, so that each value is what SQL makes of the formula."""
    i = np.arange(n)
    turn = lambda k: np.fromiter((math.cos(k * math.pi * j / (n - 1)) for j in range(n)), float, n)
    if name == "rectangular":
        return np.ones(n)
    if n == 1:
        return np.full(1, np.nan)
    if name == "hamming":
        return 0.54 - 0.46 * turn(2)
    if name == "hann":
        return 0.5 - 0.5 * turn(2)
    if name == "blackman":
        return 0.42 - 0.5 * turn(2) + 0.08 * turn(4)
    return 1 - np.abs(2 * i.astype(float) / (n - 1) - 1)


def mean_in_order(x: np.ndarray) -> float:
    """The mean by adding one value after the other: a mean that lies on a tie of rounding is on the side where SQL has it."""
    return float(np.add.accumulate(x)[-1] / len(x))


def window_properties(windows: DataFrame, nfft: int = 8192) -> DataFrame:
    """(name, size) -> coherent gain, mean square, noise bandwidth, width of the main lobe at -3 dB in bins, and highest side lobe in dB.

    Windows without a side lobe (those of one to three samples that are flat in frequency, or all zero) have no row. Longer windows than nfft are folded, as bins ask for.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for name, n in zip(d["name"], d["size"], strict=True):
                w = formula_window(name, int(n))
                s = np.abs(np.fft.rfft(np.pad(w, (0, -len(w) % nfft)).reshape(-1, nfft).sum(axis=0)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    db = 20 * np.log10(s / w.sum() + 1e-12)
                wide = np.flatnonzero(db >= -3)
                side = db[wide[-1] + 5 :] if len(wide) else db[:0]
                if len(side):
                    gain, power = mean_in_order(w), mean_in_order(w * w)
                    out.append((name, int(n), gain, power, power / (gain * gain), 2 * wide[-1] * n / nfft, side.max()))
            yield pd.DataFrame(out, columns=["name", "size", "coherent_gain", "mean_square", "enbw", "main_lobe_bins", "side_lobe_db"])

    return windows.mapInPandas(rows, "name string, size int, coherent_gain double, mean_square double, enbw double, main_lobe_bins double, side_lobe_db double")


def side_lobe(db: np.ndarray, around: int = 10) -> float:
    """The highest level outside of the peak's surroundings."""
    k = int(db.argmax())
    return float(np.concatenate([db[: max(k - around, 0)], db[k + around :], [-200.0]]).max())


def leakage_compare(recordings: DataFrame, fs: float, nfft: int) -> DataFrame:
    """Levels of each bin under a rectangular and a Hamming window, their difference, and each spectrum's highest side lobe, beyond ten bins
    around its peak. Both spectra come from one pass."""

    def one(x: np.ndarray) -> list[tuple]:
        a, b = (dsp.to_db(np.abs(dsp.one_sided(x, dsp.window(w, len(x)), nfft))) for w in ("rectangular", "hamming"))
        return [(a, b, side_lobe(a), side_lobe(b))]

    d = per_recording(recordings, one, "rect_db array<double>, hamming_db array<double>, rect_side_db double, hamming_side_db double")
    d = d.select("rec_id", F.posexplode(F.arrays_zip("rect_db", "hamming_db")).alias("k", "z"), "rect_side_db", "hamming_side_db")
    return d.select("rec_id", "k", (F.col("k") * float(fs) / nfft).alias("f_hz"), "z.rect_db", "z.hamming_db", (F.col("z.rect_db") - F.col("z.hamming_db")).alias("diff_db"), "rect_side_db", "hamming_side_db")


def stft_spectrogram(recordings: DataFrame, fs: float, frame_ms: float = 25.0, hop_ms: float = 10.0, window: str = "hamming") -> DataFrame:
    """(rec_id, frame_idx, t, mag_db array): frames less their means under a periodic window, over the window's sum."""
    size, hop = round(fs * frame_ms / 1000), max(1, round(fs * hop_ms / 1000))
    nfft = max(32, dsp.next_pow2(size))

    def one(x: np.ndarray) -> list[tuple]:
        f = dsp.frames_of(x, size, hop)
        w = dsp.window(window, size, periodic=True)
        m = np.abs(np.fft.rfft((f - f.mean(axis=1, keepdims=True)) * w, nfft)) / w.sum()
        return [(k, (k * hop + size / 2) / fs, (20 * np.log10(r + 1e-10)).tolist()) for k, r in enumerate(m)]

    return per_recording(recordings, one, "frame_idx int, t double, mag_db array<double>")


def resolution_tradeoff(recordings: DataFrame, fs: float, frames_ms: tuple[float, ...] = (10.0, 25.0, 50.0), hop_ms: float = 10.0) -> DataFrame:
    """For each frame length: samples, bins' distance, true resolution, step and number of frames."""
    d = recordings.select("rec_id", F.size("samples").alias("n"), F.explode(F.array(*[F.lit(x) for x in frames_ms])).alias("frame_ms"))
    size = F.rint(F.col("frame_ms") * fs / 1000)
    nfft = F.greatest(F.lit(32.0), F.pow(F.lit(2.0), F.ceil(F.log2(size))))
    hop = max(1, round(fs * hop_ms / 1000))
    return d.select("rec_id", "frame_ms", size.cast("int").alias("size"), (size / fs).alias("dt"), (fs / size).alias("true_df"), (fs / nfft).alias("bin_df"), F.greatest(F.lit(1), 1 + F.floor((F.col("n") - size) / hop)).cast("int").alias("n_frames"))


def fir_taps(spark, kind: str, cutoff, fs: float, taps: int = 201) -> DataFrame:
    """A filter's taps as a table (i, b)."""
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(dsp.design_fir(kind, cutoff, fs, taps))], "i int, b double")


def fir_info(taps: DataFrame, fs: float) -> DataFrame:
    """Number of taps, group delay in samples and ms, and whether the taps are symmetric."""
    n = taps.agg((F.max("i") + 1).alias("n"))
    d = taps.crossJoin(F.broadcast(n))
    other = taps.select(F.col("i").alias("j"), F.col("b").alias("c"))
    d = d.join(other, F.col("i") == F.col("n") - 1 - F.col("j"))
    return d.groupBy("n").agg((F.max(F.abs(F.col("b") - F.col("c"))) < 1e-12).alias("symmetric")).select(F.col("n").alias("n_taps"), ((F.col("n") - 1) / 2).alias("delay"), ((F.col("n") - 1) / 2 / fs * 1000).alias("delay_ms"), "symmetric")


def filter_response(taps: DataFrame, fs: float, bins: int = 64) -> DataFrame:
    """(f_hz, mag_db, phase_deg, delay) of a table of taps, by sums of b cos and b sin: phases are unwrapped from bin to bin, and the group
    delay, in samples, is the real part of the response to i b over that to b, 0 where there is no response."""
    grid = taps.sparkSession.range(bins).select((F.col("id") * fs / 2 / bins).alias("f_hz"))
    a = 2 * float(np.pi) * F.col("f_hz") / fs * F.col("i")
    sums = [F.sum(w * g(a)).alias(n) for w, g, n in ((F.col("b"), F.cos, "re"), (F.col("b"), F.sin, "im"), (F.col("b") * F.col("i"), F.cos, "dre"), (F.col("b") * F.col("i"), F.sin, "dim"))]
    d = taps.crossJoin(grid).groupBy("f_hz").agg(*sums)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    turn, w = 2 * float(np.pi), W.orderBy("f_hz")  # a row for each bin
    d = d.withColumn("ph", F.atan2(0.0 - F.col("im"), F.col("re")))
    d = d.withColumn("jump", -turn * F.floor((F.col("ph") - F.coalesce(F.lag("ph").over(w), F.col("ph")) + float(np.pi)) / turn))
    phase = F.degrees(F.col("ph") + F.sum("jump").over(w))
    delay = F.when(power > 1e-20, (F.col("dre") * F.col("re") + F.col("dim") * F.col("im")) / power).otherwise(0.0)
    return d.select("f_hz", to_db(F.sqrt(power)).alias("mag_db"), phase.alias("phase_deg"), delay.alias("delay"))


def cutoff_3db(response: DataFrame) -> DataFrame:
    """The first frequency at -3 dB or below."""
    return response.filter("mag_db <= -3").agg(F.min("f_hz").alias("f_3db"))


def apply_fir(recordings: DataFrame, b: np.ndarray) -> DataFrame:
    return per_recording(recordings, lambda x: [(dsp.apply_fir(x, b).tolist(),)], "samples array<double>")


def filter_attenuation(recordings: DataFrame, fs: float, b: np.ndarray, nfft: int) -> DataFrame:
    """Level of each bin before less that after, from one pass."""

    def one(x: np.ndarray) -> list[tuple]:
        return [tuple(dsp.to_db(np.abs(dsp.one_sided(v, dsp.window("hamming", len(v)), nfft))) for v in (x, dsp.apply_fir(x, b)))]

    d = per_recording(recordings, one, "before_db array<double>, after_db array<double>").select("rec_id", F.posexplode(F.arrays_zip("before_db", "after_db")).alias("k", "z"))
    return d.select("rec_id", "k", (F.col("k") * float(fs) / nfft).alias("f_hz"), "z.before_db", "z.after_db", (F.col("z.before_db") - F.col("z.after_db")).alias("attenuation_db"))


def resample(recordings: DataFrame, src: int, dst: int) -> DataFrame:
    return per_recording(recordings, lambda x: [(dsp.resample(x, src, dst).tolist(),)], "samples array<double>")


def log_spectrogram(recordings: DataFrame, nfft: int = 512, hop: int = 160) -> DataFrame:
    """(rec_id, frame_idx, db array): levels under the recording's highest one."""

    def one(x: np.ndarray) -> list[tuple]:
        m = np.abs(dsp.stft(x, nfft, nfft, hop))
        db = 20 * np.log10(np.maximum(m, 1e-8))
        return [(k, r.tolist()) for k, r in enumerate(db - db.max())]

    return per_recording(recordings, one, "frame_idx int, db array<double>")


def noise_psd(noises: DataFrame, nfft: int = 512, size: int = 400, hop: int = 160) -> DataFrame:
    """(rec_id, k, p): mean power of each bin over the frames, summed up before the shuffle."""
    d = per_recording(noises, lambda x: [(np.abs(f).tolist(),) for f in dsp.stft(x, nfft, size, hop)], "mag array<double>")
    return d.select("rec_id", F.posexplode("mag").alias("k", "m")).groupBy("rec_id", "k").agg(F.avg(F.col("m") * F.col("m")).alias("p"))


def enhance(noisy: DataFrame, psd: list[float], method: str = "wiener", beta: float = 1.5, floor: float = 0.02, nfft: int = 512, size: int = 400, hop: int = 160) -> DataFrame:
    """Spectral subtraction max(|Y|^2 - beta P, floor P) or the Wiener gain, with the noisy phase, back to the length of the recording.

    psd has nfft // 2 + 1 numbers, and goes to the tasks with the code.
    """
    p = np.array(psd)

    def one(x: np.ndarray) -> list[tuple]:
        s = dsp.stft(x, nfft, size, hop)
        power = np.abs(s) ** 2
        if method == "wiener":
            clean = np.maximum(power - p, 0)
            s = s * (clean / (clean + p + 1e-12))
        else:
            s = np.sqrt(np.maximum(power - beta * p, floor * p)) * np.exp(1j * np.angle(s))
        return [(dsp.istft(s, len(x), nfft, size, hop).tolist(),)]

    return per_recording(noisy, one, "samples array<double>")


def istft_error(recordings: DataFrame, nfft: int = 64, size: int = 64, hop: int = 16) -> DataFrame:
    """(rec_id, n, error): how far a recording that went through its spectra and back is off at most."""
    return per_recording(recordings, lambda x: [(len(x), float(np.abs(dsp.istft(dsp.stft(x, nfft, size, hop), len(x), nfft, size, hop) - x).max()))], "n int, error double")


def time_stretch(recordings: DataFrame, rate: float) -> DataFrame:
    return per_recording(recordings, lambda x: [(dsp.time_stretch(x, rate, 64, 16).tolist(),)], "samples array<double>")


def pitch_shift(recordings: DataFrame, semitones: float) -> DataFrame:
    return per_recording(recordings, lambda x: [(dsp.pitch_shift(x, semitones).tolist(),)], "samples array<double>")


def top_bins(spectra: DataFrame, n: int = 3) -> DataFrame:
    """The n strongest bins of each spectrum, ties by bin."""
    rank = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("mag"), "k"))
    return spectra.withColumn("rank", rank).filter(F.col("rank") <= n)
