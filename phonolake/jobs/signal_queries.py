"""Registered queries on samples, and what they are in SQL. Doubles are rounded to six places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.jobs.inputs import CHANNELS_SQL, FS, SAMPLES_SQL, channels, samples, table
from phonolake.operators import levels as L

QUERIES, SQL = {}, {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def as_decimals(c: Column, places: int = 6) -> Column:
    """Rounded as a decimal number: sums and quotients that lie on a tie but for their last bits round alike whatever adds them up."""
    return F.round(c.cast("decimal(28,12)"), places).cast("double")


def decimals_sql(x: str, places: int = 6) -> str:
    return f"round(CAST({x} AS DECIMAL(28,12)), {places})::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.to_arrays(samples(spark, sf_dir))
    return d.withColumns({"fs": F.lit(FS), "channels": F.lit(1), "bit_depth": F.lit(16), "file_size": 44 + 2 * F.size("samples")})


@query(f"""WITH {SAMPLES_SQL},
m AS (SELECT rec_id, count(*) AS c, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM sig GROUP BY rec_id)
SELECT rec_id, {FS} AS fs, 1 AS channels, 16 AS bit_depth, (44 + 2 * c)::INTEGER AS file_size, {FS * 16}::BIGINT AS bit_rate, round(c / {FS}, 6) AS duration,
  round({FS * 16} * (c / {FS}) / 8, 6) AS est_bytes, {FS / 2} AS nyquist, round((44 + 2 * c) / ({FS * 16} * (c / {FS}) / 8), 6) AS size_ratio,
  round(peak, 6) AS peak, round(rms, 6) AS rms, round(greatest(20 * log10(rms + 1e-15), -120), 6) AS dbfs FROM m""")
def recording_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recording_metadata(recordings(spark, sf_dir))


CONFIGS = [("cd", 44_100, 16, 2), ("speech", 16_000, 16, 1), ("phone", 8_000, 8, 1), ("studio", 96_000, 24, 2)]


@query(f"""WITH {SAMPLES_SQL}, d AS (SELECT rec_id, count(*) / {FS} AS duration FROM sig GROUP BY rec_id),
c(config, fs, bits, channels) AS (VALUES ('cd', 44100, 16, 2), ('speech', 16000, 16, 1), ('phone', 8000, 8, 1), ('studio', 96000, 24, 2))
SELECT rec_id, round(duration, 6) AS duration, config, fs, bits, channels, round(fs * bits * channels / 1000, 6) AS kbps, round(fs * bits * channels * duration / 8e6, 6) AS megabytes,
  round(1411200 / (fs * bits * channels), 6) AS ratio, round(100 * (1 - fs * bits * channels / 1411200), 6) AS saving_pct FROM d, c""")
def bitrate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).groupBy("rec_id").agg((F.count("*") / FS).alias("duration"))
    return L.bitrate_table(d, spark.createDataFrame(CONFIGS, "config string, fs int, bits int, channels int"))


@query("""SELECT page_id, strlen(html)::BIGINT AS pcm_bytes, (strlen(url) * 8)::BIGINT AS encoded_bytes, round(length(html) / 1000, 6) AS duration,
  round(strlen(url) * 64 / (length(html) / 1000) / 1000, 6) AS kbps, round(strlen(html) / (strlen(url) * 8), 6) AS ratio,
  round(100 * (1 - strlen(url) * 8 / strlen(html)), 6) AS saving_pct FROM pages""")
def compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return L.compression_stats(p.select("page_id", F.octet_length("html").cast("long").alias("pcm_bytes"), (F.octet_length("url") * 8).cast("long").alias("encoded_bytes"), (F.char_length("html") / 1000).alias("duration")))


@query(f"WITH {SAMPLES_SQL}{CHANNELS_SQL} SELECT rec_id, n, round(avg(x), 6) + 0.0 AS x FROM chan GROUP BY rec_id, n")
def downmix_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.downmix_mono(channels(spark, sf_dir))


@query(f"""WITH {SAMPLES_SQL}{CHANNELS_SQL},
s AS (SELECT rec_id, sqrt(avg(x * x) FILTER (WHERE channel = 0)) AS l, sqrt(avg(x * x) FILTER (WHERE channel = 1)) AS r FROM chan GROUP BY rec_id),
m AS (SELECT rec_id, sqrt(avg(x * x)) AS m FROM (SELECT rec_id, n, avg(x) AS x FROM chan GROUP BY rec_id, n) GROUP BY rec_id)
SELECT rec_id, round(l, 6) AS rms_left, round(r, 6) AS rms_right, round(m, 6) AS rms_mono, round(100 * abs(l - r) / greatest(l, r), 6) AS diff_pct FROM s JOIN m USING (rec_id)""")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.channel_stats(channels(spark, sf_dir))


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round(x / max(abs(x)) OVER (PARTITION BY rec_id) * 0.95, 6) + 0.0 AS x FROM sig")
def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.peak_normalize(samples(spark, sf_dir), 0.95)


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round(least(greatest(x * 0.1 / sqrt(avg(x * x) OVER (PARTITION BY rec_id)), -1), 1), 6) + 0.0 AS x FROM sig")
def rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rms_normalize(samples(spark, sf_dir))


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round(greatest(20 * log10(abs(x) + 1e-15), -120), 6) AS x_db, round(greatest(10 * log10(x * x + 1e-15), -120), 6) AS p_db FROM sig")
def to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonolake.functions.columns import power_to_db, to_db

    return samples(spark, sf_dir).select("rec_id", "n", to_db(F.col("x")).alias("x_db"), power_to_db(F.col("x") * F.col("x")).alias("p_db"))


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round(x, 6) + 0.0 AS x FROM sig WHERE n >= 10 AND n < 35")
def slice_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.slice_segment(samples(spark, sf_dir), 0.1, 0.35, FS)


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY rec_id ORDER BY n), 0), 6) + 0.0 AS x FROM sig")
def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pre_emphasis(samples(spark, sf_dir))


_Q = "least(greatest(round_even(least(greatest(x, -1), 1 - 2 / pow(2, {b})) / (2 / pow(2, {b})), 0) * (2 / pow(2, {b})), -1), 1 - 2 / pow(2, {b}))"


@query(f"WITH {SAMPLES_SQL} SELECT rec_id, n, round({_Q.format(b=4)}, 6) + 0.0 AS x FROM sig")
def quantize_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quantize(samples(spark, sf_dir), 4)


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT rec_id, bits, x, {_Q.format(b="bits")} - x AS e FROM sig, (VALUES (4), (6), (8), (12), (16)) AS b(bits)),
a AS (SELECT rec_id, bits, avg(x * x) AS s, avg(e * e) AS v, stddev_pop(x) AS sigma FROM q GROUP BY rec_id, bits)
SELECT rec_id, bits, round(10 * log10(s / v), 6) AS snr_db, round(6.02 * bits + 4.77 - 20 * log10(1 / sigma), 6) AS theory_db FROM a""")
def quantization_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quantization_snr(samples(spark, sf_dir))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of the first recording, in the place of a noise; no other's are numbered."""
    e = table(spark, sf_dir, "events")
    s = samples(spark, sf_dir, e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id"))  # one row
    return s.select("n", F.col("x").alias("v"))


NOISY_SQL = f"""WITH {SAMPLES_SQL}, v AS (SELECT n, x AS v FROM sig WHERE rec_id = (SELECT min(rec_id) FROM sig)),
len AS (SELECT max(n) + 1 AS len FROM v),
t AS (SELECT rec_id, sig.n, x, v FROM sig, len JOIN v ON v.n = sig.n % len.len),
p AS (SELECT rec_id, avg(x * x) AS ps, avg(v * v) AS pv FROM t GROUP BY rec_id),
noisy AS (SELECT t.rec_id, snr, n, x, x + sqrt((ps + 1e-12) / ((pv + 1e-12) * pow(10, snr / 10))) * v AS y, sqrt((ps + 1e-12) / ((pv + 1e-12) * pow(10, snr / 10))) AS alpha
  FROM t JOIN p USING (rec_id), (VALUES (0.0::DOUBLE), (5.0), (10.0)) AS s(snr))"""


@query(f"{NOISY_SQL} SELECT rec_id, snr::DOUBLE AS snr, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(alpha, 6) AS alpha FROM noisy")
def add_noise_at_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.add_noise_at_snr(samples(spark, sf_dir), noise(spark, sf_dir))


@query(f"{NOISY_SQL} SELECT rec_id, snr::DOUBLE AS snr, round(10 * log10(sum(x * x) / (sum((y - x) * (y - x)) + 1e-12)), 6) AS snr_db FROM noisy GROUP BY rec_id, snr")
def snr_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.snr_db(L.add_noise_at_snr(samples(spark, sf_dir), noise(spark, sf_dir)), "rec_id", "snr")


@query(f"""WITH {SAMPLES_SQL}, t AS (SELECT rec_id, n + 3 AS n, x AS y FROM sig),
c AS (SELECT t.rec_id, lag, sum(x * y) AS corr FROM t, range(-8, 9) AS l(lag) JOIN sig ON sig.rec_id = t.rec_id AND sig.n = t.n - lag GROUP BY t.rec_id, lag),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY corr DESC, lag) AS k FROM c)
SELECT rec_id, lag::INTEGER AS lag, round(corr, 6) + 0.0 AS corr FROM r WHERE k = 1""")
def align_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return L.align_lag(s, s.withColumn("n", F.col("n") + 3), 8)


_STATS = """max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, sum(x * x) AS energy, sum(c) / (count(*) - 1) AS zcr, sum((abs(x) >= 0.999)::INTEGER) AS clipped,
  100 * sum((abs(x) >= 0.999)::INTEGER) / count(*) AS clipped_pct"""
_ROUND = """round(peak, 6) AS peak, round(rms, 6) AS rms, round(energy, 6) AS energy, round(zcr, 6) AS zcr, clipped::BIGINT AS clipped, round(clipped_pct, 6) AS clipped_pct,
  round(peak / rms, 6) AS crest, round(greatest(20 * log10(peak / rms + 1e-15), -120), 6) AS crest_db"""


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT *, (sign(x) <> lag(sign(x)) OVER (PARTITION BY rec_id ORDER BY n))::INTEGER AS c FROM sig),
s AS (SELECT rec_id, {_STATS} FROM c GROUP BY rec_id) SELECT rec_id, {_ROUND} FROM s""")
def time_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.time_domain_stats(samples(spark, sf_dir))


@query(f"""WITH {SAMPLES_SQL}, g(label, a, b) AS (VALUES ('first', 0, 20), ('second', 20, 40)),
d AS (SELECT rec_id, label, n, x FROM sig JOIN g ON n >= a AND n < b),
c AS (SELECT *, (sign(x) <> lag(sign(x)) OVER (PARTITION BY rec_id, label ORDER BY n))::INTEGER AS c FROM d),
s AS (SELECT rec_id, label, {_STATS} FROM c GROUP BY rec_id, label) SELECT rec_id, label, {_ROUND} FROM s""")
def compare_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compare_segments(samples(spark, sf_dir), spark.createDataFrame([("first", 0.0, 0.2), ("second", 0.2, 0.4)], "label string, t0 double, t1 double"), FS)


@query(f"""WITH {SAMPLES_SQL}, f AS (SELECT rec_id, unnest(range(0, 1 + (max(n) + 1 - 16) // 8)) AS frame_idx FROM sig GROUP BY rec_id)
SELECT f.rec_id, frame_idx, round((frame_idx * 8 + 8) / 100, 6) AS t, round(sum(x * x) / 16, 6) AS energy
FROM f JOIN sig ON sig.rec_id = f.rec_id AND n BETWEEN frame_idx * 8 AND frame_idx * 8 + 15 GROUP BY f.rec_id, frame_idx""")
def short_time_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.short_time_energy(samples(spark, sf_dir), FS, 160.0, 80.0)
