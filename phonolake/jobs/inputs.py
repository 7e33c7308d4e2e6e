"""The tables of a data folder in the shapes that the operators take, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.operators.blocks import numbered
from phonolake.operators.ngrams import tokenize

#: Samples a second that the events of a user count as.
FS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Each user's values in order of time, centred, with a peak of 1, numbered by ranges: a user of any size is the work of many tasks. Of all events, or of those given."""
    e = (table(spark, sf_dir, "events") if events is None else events).select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    stats = {"total": (F.sum("value"), F.sum), "valued": (F.count("value"), F.sum), "least": (F.min("value"), F.min), "most": (F.max("value"), F.max)}
    e = numbered(e, "user_id", ["ts", "event_id"], stats).withColumn("mean", F.col("total") / F.col("valued"))
    peak = F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least"))
    return e.select(F.col("user_id").alias("rec_id"), "n", ((F.col("value") - F.col("mean")) / F.nullif(peak, F.lit(0.0))).alias("x"))


SAMPLES_SQL = """
centred AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
  value - avg(value) OVER (PARTITION BY user_id) AS xc FROM events),
sig AS (SELECT rec_id, n, xc / max(abs(xc)) OVER (PARTITION BY rec_id) AS x FROM centred)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels: a user's samples and the same two samples later."""
    s = samples(spark, sf_dir)
    s = s.withColumn("later", 0.5 * F.lag("x", 2, 0.0).over(W.partitionBy("rec_id").orderBy("n")))
    return s.select("rec_id", "n", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("x")), F.struct(F.lit(1).alias("channel"), F.col("later").alias("x")))).alias("c")).select("rec_id", "c.channel", "n", "c.x")


CHANNELS_SQL = """,
chan AS (SELECT rec_id, 0 AS channel, n, x FROM sig
  UNION ALL SELECT rec_id, 1, n, 0.5 * lag(x, 2, 0.0) OVER (PARTITION BY rec_id ORDER BY n) FROM sig)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, speaker, k, role, vec): embeddings, numbered within their labels; 1 to 4 in 7 enrol, 5 is for development."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("label").alias("speaker"), F.col("embedding").cast("array<double>").alias("vec"))
    e = e.withColumn("k", F.row_number().over(W.partitionBy("speaker").orderBy("rec_id")))
    m = F.col("k") % 7
    return e.withColumn("role", F.when(m.between(1, 4), "enroll").when(m == 5, "dev").otherwise("test"))


VECTORS_SQL = """
numbered AS (SELECT vec_id AS rec_id, label AS speaker, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
vectors AS (SELECT *, CASE WHEN k % 7 BETWEEN 1 AND 4 THEN 'enroll' WHEN k % 7 = 5 THEN 'dev' ELSE 'test' END AS role FROM numbered)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, tokens) of conversation turns, for training."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"), tokenize(F.col("text")).alias("tokens"))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sent_id"), tokenize(F.col("text")).alias("tokens"))


def _tokens_sql(name: str, sent_id: str, source: str) -> str:
    return f"""
{name} AS (SELECT {sent_id} AS sent_id, list_concat(['<s>'], list_concat(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w <> ''), ['</s>'])) AS tokens FROM {source})"""


SENTENCES_SQL = _tokens_sql("train", "conv_id * 1000 + turn", "conversations")
HELD_OUT_SQL = _tokens_sql("test", "item_id", "benchmark")


def bigrams_sql(name: str) -> str:
    """<name>2 (sent_id, context, word) and <name>1 (sent_id, word)."""
    return f""",
{name}1 AS (SELECT sent_id, generate_subscripts(tokens, 1) AS k, unnest(tokens) AS word FROM {name}),
{name}2 AS (SELECT sent_id, before AS context, word FROM (
  SELECT sent_id, lag(word) OVER (PARTITION BY sent_id ORDER BY k) AS before, word FROM {name}1) WHERE before IS NOT NULL)"""


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth, pred, score): a document's quality label, and whether it has 300 words' length or more."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    name = lambda c: F.when(c, "good").otherwise("bad")
    return d.select("doc_id", name(F.col("quality") == 1).alias("truth"), name(F.col("n_chars") >= 1500).alias("pred"), (F.col("n_chars") / 1000).alias("score"))


CONFUSIONS_SQL = """
res AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars >= 1500 THEN 'good' ELSE 'bad' END AS pred,
  n_chars / 1000 AS score FROM labels JOIN documents USING (doc_id))"""
