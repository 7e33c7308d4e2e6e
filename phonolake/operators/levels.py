"""Sample-level operators on the long form (rec_id, n, x) and on tables of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.functions.columns import quantize_uniform, to_db

CD_BITS_PER_SECOND = 44_100 * 16 * 2


def to_arrays(samples: DataFrame) -> DataFrame:
    """(rec_id, n, x) -> (rec_id, samples), in order of n."""
    return samples.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("samples"))


def to_long(recordings: DataFrame) -> DataFrame:
    return recordings.select("rec_id", F.posexplode("samples").alias("n", "x")).withColumn("n", F.col("n").cast("long"))


def recording_metadata(recordings: DataFrame) -> DataFrame:
    """Adds bit rate, estimated size, Nyquist frequency, size ratio, peak, RMS and level to rows with samples."""
    d = recordings.withColumn("bit_rate", F.col("fs").cast("long") * F.col("bit_depth") * F.col("channels")).withColumn("duration", F.size("samples") / F.col("fs"))
    d = d.withColumn("est_bytes", F.col("bit_rate") * F.col("duration") / 8).withColumn("nyquist", F.col("fs") / 2)
    d = d.withColumn("size_ratio", F.col("file_size") / F.nullif(F.col("est_bytes"), F.lit(0.0)))
    d = d.withColumn("peak", F.array_max(F.transform("samples", F.abs)))
    d = d.withColumn("rms", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size("samples"), F.lit(0))))
    return d.withColumn("dbfs", to_db(F.col("rms"))).drop("samples")


def bitrate_table(recordings: DataFrame, configs: DataFrame) -> DataFrame:
    """For each recording (rec_id, duration) and PCM configuration (config, fs, bits, channels): rate, size and saving against a CD."""
    d = recordings.select("rec_id", "duration").crossJoin(F.broadcast(configs))
    rate = F.col("fs").cast("long") * F.col("bits") * F.col("channels")
    d = d.withColumn("kbps", rate / 1000).withColumn("megabytes", rate * F.col("duration") / 8e6)
    return d.withColumn("ratio", F.lit(CD_BITS_PER_SECOND) / rate).withColumn("saving_pct", 100 * (1 - rate / F.lit(CD_BITS_PER_SECOND)))


def compression_stats(files: DataFrame) -> DataFrame:
    """Adds kbps, ratio and saving of encoded_bytes against pcm_bytes of duration seconds."""
    d = files.withColumn("kbps", F.col("encoded_bytes") * 8 / F.nullif(F.col("duration"), F.lit(0.0)) / 1000)
    d = d.withColumn("ratio", F.col("pcm_bytes") / F.nullif(F.col("encoded_bytes"), F.lit(0)))
    return d.withColumn("saving_pct", 100 * (1 - F.col("encoded_bytes") / F.nullif(F.col("pcm_bytes"), F.lit(0))))


def downmix_mono(channels: DataFrame) -> DataFrame:
    """(rec_id, channel, n, x) -> (rec_id, n, x): the mean over channels."""
    return channels.groupBy("rec_id", "n").agg(F.avg("x").alias("x"))


def channel_stats(channels: DataFrame) -> DataFrame:
    """(rec_id, channel 0 or 1, n, x) -> RMS of left, right and mono, and how far left and right differ in percent of the louder one."""
    rms = lambda c: F.sqrt(F.avg(F.when(F.col("channel") == c, F.col("x") * F.col("x"))))
    sides = channels.groupBy("rec_id").agg(rms(0).alias("rms_left"), rms(1).alias("rms_right"))
    mono = downmix_mono(channels).groupBy("rec_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms_mono"))
    most = F.greatest("rms_left", "rms_right")
    return sides.join(mono, "rec_id").withColumn("diff_pct", 100 * F.abs(F.col("rms_left") - F.col("rms_right")) / F.nullif(most, F.lit(0.0)))


def peak_normalize(samples: DataFrame, target: float = 1.0) -> DataFrame:
    """Scales each recording to the peak, silence stays."""
    peak = F.max(F.abs("x")).over(W.partitionBy("rec_id"))
    return samples.withColumn("x", F.when(peak > 0, F.col("x") / peak * target).otherwise(F.col("x")))


def rms_normalize(samples: DataFrame, target: float = 0.1, clip: float | None = 1.0, least: float = 0.0) -> DataFrame:
    """Scales each recording to the RMS and clips; recordings with an RMS up to least stay."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")).over(W.partitionBy("rec_id")))
    y = F.when(rms > least, F.col("x") * target / rms).otherwise(F.col("x"))
    return samples.withColumn("x", y if clip is None else F.least(F.greatest(y, F.lit(-clip)), F.lit(clip)))


def slice_segment(samples: DataFrame, t0: float, t1: float, fs: int) -> DataFrame:
    """Samples from t0 to t1 seconds, the last one exclusive."""
    return samples.filter((F.col("n") >= int(t0 * fs)) & (F.col("n") < int(t1 * fs)))


def pre_emphasis(samples: DataFrame, alpha: float = 0.97) -> DataFrame:
    before = F.lag("x").over(W.partitionBy("rec_id").orderBy("n"))
    return samples.withColumn("x", F.col("x") - alpha * F.coalesce(before, F.lit(0.0)))


def quantize(samples: DataFrame, bits: int) -> DataFrame:
    return samples.withColumn("x", quantize_uniform(F.col("x"), bits))


def quantization_snr(samples: DataFrame, depths: tuple[int, ...] = (4, 6, 8, 12, 16)) -> DataFrame:
    """Measured SNR of each depth and the rule 6.02 B + 4.77 - 20 log10(1 / sigma). Without noise or signal it is null."""
    each = F.explode(F.array(*[F.lit(b) for b in depths]))
    d = samples.withColumn("bits", each).withColumn("e", quantize_uniform(F.col("x"), F.col("bits").cast("double")) - F.col("x"))
    d = d.groupBy("rec_id", "bits").agg(F.avg(F.col("x") * F.col("x")).alias("signal"), F.avg(F.col("e") * F.col("e")).alias("noise"), F.stddev_pop("x").alias("sigma"))
    measured = F.when(F.col("noise") >= 1e-30, 10 * F.log10(F.col("signal") / F.nullif(F.col("noise"), F.lit(0.0))))
    theory = 6.02 * F.col("bits") + 4.77 - 20 * F.log10(1 / F.nullif(F.col("sigma"), F.lit(0.0)))
    return d.select("rec_id", "bits", measured.alias("snr_db"), theory.alias("theory_db"))


def tiled_noise(signal: DataFrame, noise: DataFrame, snrs: tuple[float, ...]) -> DataFrame:
    """(rec_id, n, x) and one noise (n, v), tiled to each signal's length -> (rec_id, n, x, v, alpha): what v is times to be added at each of snrs."""
    length = noise.agg((F.max("n") + 1).alias("len"))
    d = signal.crossJoin(F.broadcast(length)).withColumn("m", F.col("n") % F.col("len"))
    d = d.join(noise.select(F.col("n").alias("m"), "v"), "m").select("rec_id", "n", "x", "v")
    powers = d.groupBy("rec_id").agg(F.avg(F.col("x") * F.col("x")).alias("ps"), F.avg(F.col("v") * F.col("v")).alias("pv"))
    alpha = lambda s: F.sqrt((F.col("ps") + 1e-12) / ((F.col("pv") + 1e-12) * F.pow(F.lit(10.0), F.lit(float(s)) / 10)))
    return d.join(powers.select("rec_id", F.array(*[alpha(s) for s in snrs]).alias("alpha")), "rec_id")


def add_noise_at_snr(signal: DataFrame, noise: DataFrame, snrs: tuple[float, ...] = (0.0, 5.0, 10.0)) -> DataFrame:
    """(rec_id, n, x) and one noise (n, v), tiled to each signal's length -> (rec_id, snr, n, x, y, alpha), y = x + alpha v."""
    length = noise.agg((F.max("n") + 1).alias("len"))
    d = signal.crossJoin(F.broadcast(length)).withColumn("m", F.col("n") % F.col("len"))
    d = d.join(noise.select(F.col("n").alias("m"), "v"), "m").select("rec_id", "n", "x", "v")
    powers = d.groupBy("rec_id").agg(F.avg(F.col("x") * F.col("x")).alias("ps"), F.avg(F.col("v") * F.col("v")).alias("pv"))
    powers = powers.withColumn("snr", F.explode(F.array(*[F.lit(float(s)) for s in snrs])))
    alpha = F.sqrt((F.col("ps") + 1e-12) / ((F.col("pv") + 1e-12) * F.pow(F.lit(10.0), F.col("snr") / 10)))
    d = d.join(powers.select("rec_id", "snr", alpha.alias("alpha")), "rec_id")
    return d.select("rec_id", "snr", "n", "x", (F.col("x") + F.col("alpha") * F.col("v")).alias("y"), "alpha")


def snr_db(pairs: DataFrame, *keys: str, ref: str = "x", test: str = "y") -> DataFrame:
    """10 log10 of the reference's power over the difference's, for each group of sample pairs."""
    e = F.col(test) - F.col(ref)
    return pairs.groupBy(*keys).agg((10 * F.log10(F.sum(F.col(ref) * F.col(ref)) / (F.sum(e * e) + 1e-12))).alias("snr_db"))


def align_lag(ref: DataFrame, test: DataFrame, max_lag: int = 400) -> DataFrame:
    """(rec_id, n, x) twice -> (rec_id, lag, corr): the first shift up to max_lag with the highest cross-correlation.

    Each sample meets the 2 max_lag + 1 ones around it: work grows with the samples, and sums are made before the shuffle by lag.
    """
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    moved = test.withColumn("lag", lags).select("rec_id", (F.col("n") - F.col("lag")).alias("n"), "lag", F.col("x").alias("y"))
    sums = ref.join(moved, ["rec_id", "n"]).groupBy("rec_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("corr"))
    best = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("corr"), "lag"))
    return sums.withColumn("k", best).filter("k = 1").drop("k")


def time_domain_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Peak, RMS, energy, crest factor and its dB, zero-crossing rate (0 is a sign of its own) and clipping for rec_id and keys."""
    by = ["rec_id", *keys]
    d = samples.withColumn("cross", (F.signum("x") != F.lag(F.signum("x")).over(W.partitionBy(*by).orderBy("n"))).cast("int"))
    x, clipped = F.col("x"), F.sum((F.abs("x") >= 0.999).cast("int"))
    d = d.groupBy(*by).agg(F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.sum(x * x).alias("energy"), (F.sum("cross") / F.nullif(F.count("*") - 1, F.lit(0))).alias("zcr"), clipped.alias("clipped"), (100 * clipped / F.count("*")).alias("clipped_pct"))
    crest = F.col("peak") / F.nullif(F.col("rms"), F.lit(0.0))
    return d.withColumn("crest", crest).withColumn("crest_db", to_db(crest))


def compare_segments(samples: DataFrame, segments: DataFrame, fs: int) -> DataFrame:
    """Statistics of named segments (label, t0, t1) of each recording."""
    s = segments.select("label", F.floor(F.col("t0") * fs).alias("a"), F.floor(F.col("t1") * fs).alias("b"))
    d = samples.join(F.broadcast(s), (F.col("n") >= F.col("a")) & (F.col("n") < F.col("b")))
    return time_domain_stats(d, "label")


def short_time_energy(samples: DataFrame, fs: int, frame_ms: float = 20.0, hop_ms: float = 10.0) -> DataFrame:
    """Mean square of whole frames, at their centres. Each sample goes to the frames that hold it, which are summed up before the shuffle."""
    size, hop = int(fs * frame_ms / 1000), int(fs * hop_ms / 1000)
    ends = samples.groupBy("rec_id").agg((F.max("n") + 1).alias("len"))
    first = F.greatest(F.lit(0), F.floor((F.col("n") - size) / hop) + 1)
    d = samples.withColumn("frame_idx", F.explode(F.sequence(first.cast("long"), F.greatest(F.floor(F.col("n") / hop).cast("long"), first.cast("long")))))
    d = d.filter(F.col("n").between(F.col("frame_idx") * hop, F.col("frame_idx") * hop + size - 1))
    d = d.groupBy("rec_id", "frame_idx").agg((F.sum(F.col("x") * F.col("x")) / size).alias("energy"))
    d = d.join(ends, "rec_id").filter(F.col("frame_idx") * hop + size <= F.col("len"))
    return d.select("rec_id", "frame_idx", ((F.col("frame_idx") * hop + size / 2) / fs).alias("t"), "energy")
