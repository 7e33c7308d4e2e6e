"""Registered queries on frames, and what they are in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.jobs.inputs import FS, SAMPLES_SQL, samples, table
from phonolake.jobs.signal_queries import rounded
from phonolake.operators import frames as R
from phonolake.operators.levels import to_arrays

QUERIES, SQL = {}, {}
SIZE, HOP = 16, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_signal(to_arrays(samples(spark, sf_dir)), FS, SIZE, HOP)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_zcr(R.frame_energy_features(frames(spark, sf_dir)))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").cast("int").alias("len"))


FRAMES_SQL = f"""{SAMPLES_SQL}, len AS (SELECT rec_id, count(*) AS len FROM sig GROUP BY rec_id),
fi AS (SELECT rec_id, len, unnest(range(0, greatest(1, 1 + (len - {SIZE}) // {HOP})))::INTEGER AS frame_idx FROM len),
fr AS (SELECT fi.rec_id, frame_idx, n - frame_idx * {HOP} AS i, x * (0.54 - 0.46 * cos(2 * pi() * (n - frame_idx * {HOP}) / {SIZE - 1})) AS y
  FROM fi JOIN sig ON sig.rec_id = fi.rec_id AND n BETWEEN frame_idx * {HOP} AND frame_idx * {HOP + 0} + {SIZE - 1}),
sg AS (SELECT *, CASE WHEN y >= 0 THEN 1 ELSE -1 END - lag(CASE WHEN y >= 0 THEN 1 ELSE -1 END) OVER (PARTITION BY rec_id, frame_idx ORDER BY i) AS step FROM fr),
ft AS (SELECT rec_id, frame_idx, sum(y * y) AS energy, sum(abs(y)) AS magnitude, sum(abs(step)) / {2 * SIZE} AS zcr FROM sg GROUP BY rec_id, frame_idx),
fe AS (SELECT *, 10 * log10(energy + 1e-10) AS log_energy FROM ft)"""


@query(f"WITH {FRAMES_SQL} SELECT rec_id, frame_idx, round((frame_idx * {HOP} + {SIZE / 2}) / {FS}, 6) AS t_center, i::INTEGER AS i, round(y, 6) + 0.0 AS y FROM fr")
def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("rec_id", "frame_idx", "t_center", F.posexplode("frame").alias("i", "y"))


@query(f"WITH {FRAMES_SQL} SELECT rec_id, frame_idx, round(energy, 6) AS energy, round(magnitude, 6) AS magnitude, round(sqrt(energy / {SIZE}), 6) AS rms, round(log_energy, 6) AS log_energy FROM fe")
def frame_energy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_energy_features(frames(spark, sf_dir)).drop("frame", "t_center")


@query(f"WITH {FRAMES_SQL} SELECT rec_id, frame_idx, round(zcr, 6) AS zcr FROM fe")
def frame_zcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_zcr(frames(spark, sf_dir)).drop("frame", "t_center")


AUTOCORR_SQL = f"""{FRAMES_SQL}, lags AS (SELECT unnest(range(0, 11))::INTEGER AS lag),
ac AS (SELECT a.rec_id, a.frame_idx, lag, sum(a.y * b.y) AS r FROM fr a, lags JOIN fr b ON b.rec_id = a.rec_id AND b.frame_idx = a.frame_idx AND b.i = a.i + lag GROUP BY a.rec_id, a.frame_idx, lag),
nr AS (SELECT rec_id, frame_idx, lag, r / max(r) FILTER (WHERE lag = 0) OVER (PARTITION BY rec_id, frame_idx) AS r FROM ac)"""


@query(f"WITH {AUTOCORR_SQL} SELECT rec_id, frame_idx, lag, round(r, 6) + 0.0 AS r FROM nr")
def frame_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_autocorr(frames(spark, sf_dir), 10).select("rec_id", "frame_idx", F.posexplode("r").alias("lag", "r"))


PITCH_SQL = f"""{AUTOCORR_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, frame_idx ORDER BY r DESC, lag) AS k FROM nr WHERE lag BETWEEN 2 AND 10),
f0 AS (SELECT rec_id, frame_idx, CASE WHEN r >= 0.3 THEN {FS} / lag ELSE 0 END AS f0 FROM rk WHERE k = 1)"""


@query(f"WITH {PITCH_SQL} SELECT rec_id, frame_idx, round(f0, 6) AS f0 FROM f0")
def estimate_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.estimate_pitch(frames(spark, sf_dir), FS, 10.0, 50.0).select("rec_id", "frame_idx", "f0")


@query(f"""WITH {PITCH_SQL} SELECT rec_id, frame_idx, round((frame_idx * {HOP} + {SIZE / 2}) / {FS}, 6) AS t_center, round(f0, 6) AS f0,
  round(avg(f0) FILTER (WHERE f0 > 0) OVER (PARTITION BY rec_id), 6) AS mean_f0 FROM f0""")
def f0_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.f0_contour(frames(spark, sf_dir), FS, f0_min=10.0, f0_max=50.0)


@query(f"""WITH {FRAMES_SQL}, raw AS (SELECT fi.rec_id, frame_idx, n - frame_idx * {HOP} AS i, x FROM fi JOIN sig ON sig.rec_id = fi.rec_id AND n BETWEEN frame_idx * {HOP} AND frame_idx * {HOP} + {SIZE - 1}),
hn AS (SELECT rec_id, frame_idx, i, (x - avg(x) OVER (PARTITION BY rec_id, frame_idx)) * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE - 1})) AS y FROM raw),
hr AS (SELECT a.rec_id, a.frame_idx, b.i - a.i AS lag, sum(a.y * b.y) AS r FROM hn a JOIN hn b ON b.rec_id = a.rec_id AND b.frame_idx = a.frame_idx AND b.i - a.i BETWEEN 2 AND 9 GROUP BY ALL),
hk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, frame_idx ORDER BY r DESC, lag) AS k FROM hr) SELECT rec_id, frame_idx, round({FS} / lag, 6) AS f0, lag::INTEGER AS lag FROM hk WHERE k = 1""")
def hann_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = R.frame_signal(to_arrays(samples(spark, sf_dir)), FS, SIZE, HOP, None)
    return R.hann_pitch(raw, FS, 10.0, 50.0).select("rec_id", "frame_idx", "f0", "lag")


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT rec_id, CASE WHEN log_energy < max(log_energy) OVER (PARTITION BY rec_id) - 6 THEN 's' WHEN zcr < 0.3 THEN 'v' ELSE 'u' END AS kind FROM fe)
SELECT rec_id, count(*) AS n_frames, count(*) FILTER (WHERE kind = 's') AS n_silence, count(*) FILTER (WHERE kind = 'v') AS n_voiced, count(*) FILTER (WHERE kind = 'u') AS n_unvoiced,
  round(100 * (count(*) FILTER (WHERE kind = 's')) / count(*), 6) AS pct_silence, round(100 * (count(*) FILTER (WHERE kind = 'v')) / count(*), 6) AS pct_voiced,
  round(100 * (count(*) FILTER (WHERE kind = 'u')) / count(*), 6) AS pct_unvoiced FROM k GROUP BY rec_id""")
def voicing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.voicing_segments(features(spark, sf_dir), below=6.0, zcr=0.3)


def _bounds_sql(grow: bool) -> str:
    loud = "log_energy >= max(log_energy) OVER (PARTITION BY rec_id) - 3"
    edge = "m OR ((coalesce(lead(m) OVER w, false) OR coalesce(lag(m) OVER w, false)) AND zcr >= 0.3)" if grow else "m"
    return f"""WITH {FRAMES_SQL}, m AS (SELECT rec_id, frame_idx, zcr, {loud} AS m FROM fe), g AS (SELECT rec_id, frame_idx, {edge} AS m FROM m WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)),
b AS (SELECT rec_id, greatest(min(frame_idx) FILTER (WHERE m) - 1, 0) AS a, least(max(frame_idx) FILTER (WHERE m) + 1, max(frame_idx)) AS b FROM g GROUP BY rec_id),
bounds AS (SELECT rec_id, a AS first_frame, b AS last_frame, a * {HOP} AS start, least((b + {0 if grow else 1}) * {HOP} + {SIZE}, len)::INTEGER AS "end", len FROM b JOIN len USING (rec_id))"""


@query(f'{_bounds_sql(True)} SELECT rec_id, first_frame, last_frame, start, "end" FROM bounds')
def endpoint_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.endpoint_detect(features(spark, sf_dir), lengths(spark, sf_dir), SIZE, HOP, 3.0, 0.3, 1)


@query(f'{_bounds_sql(False)} SELECT rec_id, first_frame, last_frame, start, "end" FROM bounds')
def endpoint_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.endpoint_detect(features(spark, sf_dir), lengths(spark, sf_dir), SIZE, HOP, 3.0, None, 1)


@query(f"""{_bounds_sql(True)} SELECT rec_id, round(len / {FS}, 6) AS before_s, round(("end" - start) / {FS}, 6) AS after_s, round(1000 * (len / {FS} - ("end" - start) / {FS}), 6) + 0.0 AS removed_ms FROM bounds""")
def trim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trim_report(endpoint_detect(spark, sf_dir), lengths(spark, sf_dir), FS)


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT rec_id, frame_idx, sum(energy) OVER (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM fe),
c AS (SELECT rec_id, frame_idx, coalesce(abs(s - lag(s) OVER (PARTITION BY rec_id ORDER BY frame_idx)), 0) AS change FROM s),
l AS (SELECT rec_id, quantile_cont(change, 0.92) AS lim FROM c GROUP BY rec_id)
SELECT rec_id, frame_idx, round(change, 6) AS change, round(lim, 6) AS "limit" FROM c JOIN l USING (rec_id) WHERE change::DECIMAL(28,12) > lim::DECIMAL(28,12)""")
def transient_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transient_detect(R.frame_energy_features(frames(spark, sf_dir)))


@query(f"""WITH {SAMPLES_SQL}, r AS (SELECT rec_id, rec_id % 5 AS label, CASE WHEN rec_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(*) / {FS} AS d,
  greatest(20 * log10(max(abs(x)) + 1e-15), -120) AS p, count(*) FILTER (WHERE abs(x) >= 0.999) AS c FROM sig GROUP BY rec_id)
SELECT label, split, count(*) AS n, round(avg(d), 6) AS mean_duration, round(avg(p), 6) + 0.0 AS mean_peak_db, sum(c)::BIGINT AS clipped FROM r GROUP BY label, split""")
def dataset_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = to_arrays(samples(spark, sf_dir)).withColumn("label", F.col("rec_id") % 5).withColumn("split", F.when(F.col("rec_id") % 3 == 0, "test").otherwise("train"))
    return R.dataset_qa(r, FS)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, frame_idx, vec): each embedding as 8 frames of 8 dimensions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("frame_idx"), "v").select("rec_id", "frame_idx", F.slice("v", F.col("frame_idx") * 8 + 1, F.lit(8)).alias("vec"))


SEQUENCES_SQL = """
el AS (SELECT vec_id AS rec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
seq AS (SELECT rec_id, (k // 8)::INTEGER AS frame_idx, (k % 8)::INTEGER AS dim, v FROM el)"""
_DELTA = "(1 * (coalesce(lead(v, 1) OVER w, last_value(v) OVER e) - coalesce(lag(v, 1) OVER w, first_value(v) OVER e)) + 2 * (coalesce(lead(v, 2) OVER w, last_value(v) OVER e) - coalesce(lag(v, 2) OVER w, first_value(v) OVER e))) / (10 + 1e-10)"
_WINDOWS = "WINDOW w AS (PARTITION BY rec_id, dim ORDER BY frame_idx), e AS (PARTITION BY rec_id, dim ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def long(features: DataFrame) -> DataFrame:
    return features.select("rec_id", "frame_idx", R.dims(F.col("vec")))


@query(f"WITH {SEQUENCES_SQL}, d AS (SELECT rec_id, frame_idx, dim, {_DELTA} AS v FROM seq {_WINDOWS}) SELECT rec_id, frame_idx, dim, round(v, 6) + 0.0 AS v FROM d")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(R.delta(sequences(spark, sf_dir)))


@query(f"""WITH {SEQUENCES_SQL}, d AS (SELECT rec_id, frame_idx, dim, {_DELTA} AS v FROM seq {_WINDOWS}), dd AS (SELECT rec_id, frame_idx, dim, {_DELTA} AS v FROM d {_WINDOWS})
SELECT rec_id, frame_idx, dim, round(v, 6) + 0.0 AS v FROM dd""")
def delta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(R.delta(R.delta(sequences(spark, sf_dir))))


@query(f"WITH {SEQUENCES_SQL} SELECT rec_id, frame_idx, dim, round(v - avg(v) OVER (PARTITION BY rec_id, dim), 6) + 0.0 AS v FROM seq")
def cmn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(R.cmvn(sequences(spark, sf_dir), False))


@query(f"WITH {SEQUENCES_SQL} SELECT rec_id, frame_idx, dim, round((v - avg(v) OVER (PARTITION BY rec_id, dim)) / (stddev_pop(v) OVER (PARTITION BY rec_id, dim) + 1e-8), 6) + 0.0 AS v FROM seq")
def cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(R.cmvn(sequences(spark, sf_dir)))


@query(f"WITH {SEQUENCES_SQL} SELECT rec_id, count(DISTINCT frame_idx) AS n_frames, (max(dim) + 1)::INTEGER AS n_dims FROM seq GROUP BY rec_id")
def feature_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feature_shapes(sequences(spark, sf_dir))
