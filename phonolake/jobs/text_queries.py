"""Registered queries on texts and results, and what they are in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.jobs.inputs import CONFUSIONS_SQL, HELD_OUT_SQL, SENTENCES_SQL, bigrams_sql, confusions, held_out, sentences, table
from phonolake.jobs.signal_queries import as_decimals, decimals_sql, rounded
from phonolake.operators import evaluation as E
from phonolake.operators import ngrams as N

QUERIES, SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


@query(f"""WITH {CONFUSIONS_SQL}, l(truth) AS (VALUES ('good'), ('bad'), ('unsure'))
SELECT l.truth, count(*) FILTER (WHERE pred = 'good') AS n_good, count(*) FILTER (WHERE pred = 'bad') AS n_bad, count(*) FILTER (WHERE pred = 'unsure') AS n_unsure
FROM l LEFT JOIN res ON res.truth = l.truth GROUP BY l.truth""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(confusions(spark, sf_dir), ["good", "bad", "unsure"])


@query(f"WITH {CONFUSIONS_SQL} SELECT truth, count(*) AS n, sum((truth = pred)::INTEGER)::BIGINT AS correct, round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM res GROUP BY truth")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(confusions(spark, sf_dir), "truth")


@query(f"WITH {CONFUSIONS_SQL} SELECT truth, pred, count(*) AS n FROM res WHERE truth <> pred GROUP BY truth, pred")
def confused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confused_pairs(confusions(spark, sf_dir))


@query(f"""WITH {CONFUSIONS_SQL}, u AS (SELECT 'length' AS system, truth, pred FROM res UNION ALL SELECT 'toxicity', truth, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END FROM res JOIN labels USING (doc_id))
SELECT system, count(*) AS n, sum((truth = pred)::INTEGER)::BIGINT AS correct, round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM u GROUP BY system""")
def system_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confusions(spark, sf_dir)
    other = c.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select("truth", F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("pred"))
    return E.system_compare({"length": c, "toxicity": other})


@query(f"""WITH {CONFUSIONS_SQL}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM res)
SELECT truth = pred AS correct, least(floor((score - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM res, e GROUP BY ALL""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_histogram(confusions(spark, sf_dir))


@query(f"WITH {CONFUSIONS_SQL} SELECT round(quantile_cont(score, 0.05), 6) AS threshold, count(*) AS n FROM res WHERE truth = pred")
def reject_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reject_threshold(confusions(spark, sf_dir))


@query(f"""SELECT event_id, {decimals_sql('value / 1000')} AS latency_s, (1 + user_id % 7)::DOUBLE AS duration_s, {decimals_sql('value / 1000 / (1 + user_id % 7)')} AS rtf FROM events""")
def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = E.realtime_factor(e.select("event_id", (F.col("value") / 1000).alias("latency_s"), (1 + F.col("user_id") % 7).cast("double").alias("duration_s")))
    return d.withColumns({c: as_decimals(F.col(c)) for c in ("latency_s", "rtf")})


@query("""WITH specs AS (SELECT event_type AS method, avg(value / 1000) AS latency_s, avg(value / 1000 / (1 + user_id % 7)) AS rtf, sum(strlen(coalesce(props, '')))::BIGINT AS storage, avg(abs(value - 50)) AS boundary_lsd_db FROM events GROUP BY event_type),
m AS (SELECT event_type AS method, count(*) AS n, round(avg(1 + value % 4), 6) AS naturalness, round(avg(value / 100), 6) AS continuity,
  round(100 * avg((event_id % 2)::DOUBLE), 6) AS intelligibility_pct, round(avg((1 + value % 4 + value / 100) / 2), 6) AS overall FROM events GROUP BY event_type)
SELECT m.*, round(latency_s, 6) AS latency_s, round(rtf, 6) AS rtf, storage || ' B' AS storage, round(boundary_lsd_db, 6) AS boundary_lsd_db FROM m LEFT JOIN specs USING (method)""")
def mos_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of each type of event, beside what the events say of its latency, real-time factor and size."""
    v, events = F.col("value"), table(spark, sf_dir, "events").withColumnRenamed("event_type", "method")
    e = events.select("method", (1 + v % 4).alias("naturalness_mos"), (v / 100).alias("continuity_score"), (F.col("event_id") % 2).alias("intelligibility"), ((1 + v % 4 + v / 100) / 2).alias("overall_score"))
    seconds = v / 1000
    size = F.sum(F.octet_length(F.coalesce("props", F.lit("")))).cast("string")
    specs = events.groupBy("method").agg(F.avg(seconds).alias("latency_s"), F.avg(seconds / (1 + F.col("user_id") % 7)).alias("rtf"), F.concat(size, F.lit(" B")).alias("storage"), F.avg(F.abs(v - 50)).alias("boundary_lsd_db"))
    return E.mos_summary(e, specs)


@query(f"WITH {SENTENCES_SQL}{bigrams_sql('train')} SELECT context, word, count(*) AS c FROM train2 GROUP BY context, word")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ngram_counts(sentences(spark, sf_dir))


_MODEL = f"""WITH {SENTENCES_SQL}{bigrams_sql('train')}, {HELD_OUT_SQL}{bigrams_sql('test')},
c AS (SELECT context, word, count(*) AS c FROM train2 GROUP BY context, word), x AS (SELECT context, sum(c)::BIGINT AS ctx FROM c GROUP BY context),
u AS (SELECT word, count(*) AS c1 FROM train1 GROUP BY word), one AS (SELECT count(*) AS v, sum(c1)::BIGINT AS n1 FROM u), tot AS (SELECT sum(c)::BIGINT AS n2 FROM c),
p AS (SELECT t.sent_id, t.context, t.word, ln(c.c / ctx) AS mle, ln((coalesce(c.c, 0) + 1) / (coalesce(ctx, 0) + v + 1e-10)) AS laplace, ln((coalesce(c.c, 0) + 0.5) / (coalesce(ctx, 0) + 0.5 * v)) AS add_k,
  ln(CASE WHEN c.c > 0 THEN c.c / ctx ELSE 0.4 / (n2 + v) END) AS backoff, ln(CASE WHEN c.c > 0 THEN c.c / ctx ELSE 0.4 * (coalesce(c1, 0) + 1) / (n1 + v) END) AS notebook
  FROM test2 t LEFT JOIN c USING (context, word) LEFT JOIN x USING (context) LEFT JOIN u USING (word), one, tot)"""


@query(f"""{_MODEL} SELECT sent_id, context, word, round(mle, 6) AS mle, round(laplace, 6) AS laplace, round(add_k, 6) AS add_k, round(backoff, 6) AS backoff, round(notebook, 6) AS notebook FROM p""")
def ngram_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = sentences(spark, sf_dir)
    d = N.ngrams_of(held_out(spark, sf_dir), 2)
    for name, smoothing, variant in (("mle", "mle", ""), ("laplace", "laplace", ""), ("add_k", "add_k", ""), ("backoff", "backoff", "module"), ("notebook", "backoff", "notebook")):
        d = N.ngram_logprob(d, train, 2, smoothing, variant=variant).withColumnRenamed("logprob", name)
    return d


@query(f"{_MODEL} SELECT sent_id, round(sum(laplace), 6) AS logprob, count(*) AS n_grams FROM p GROUP BY sent_id")
def sentence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sentence_logprob(held_out(spark, sf_dir), sentences(spark, sf_dir))


@query(f"{_MODEL} SELECT round(exp(-sum(laplace) / count(*)), 6) AS perplexity, count(*) AS n_grams FROM p")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.perplexity(held_out(spark, sf_dir), sentences(spark, sf_dir))


@query(f"""{_MODEL}, s AS (SELECT sent_id, count(*) AS m, CASE WHEN count(*) = count(mle) THEN sum(mle) ELSE -100 END AS mle, sum(laplace) AS laplace, sum(backoff) AS backoff FROM p GROUP BY sent_id),
o AS (SELECT ln((coalesce(c1, 0) + 1) / (n1 + v + 1e-10)) AS l FROM test1 LEFT JOIN u USING (word), one)
SELECT 'mle' AS smoothing, 2 AS n, round(exp(-sum(mle) / sum(m)), 6) AS perplexity FROM s UNION ALL SELECT 'laplace', 2, round(exp(-sum(laplace) / sum(m)), 6) FROM s
UNION ALL SELECT 'backoff', 2, round(exp(-sum(backoff) / sum(m)), 6) FROM s UNION ALL SELECT 'laplace', 1, round(exp(-sum(l) / count(*)), 6) FROM o""")
def lm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lm_compare(held_out(spark, sf_dir), sentences(spark, sf_dir))


@query(f"""{_MODEL}, ask AS (SELECT word AS context FROM u ORDER BY c1 DESC, word LIMIT 20),
g AS (SELECT context, u.word, (coalesce(c.c, 0) + 1) / (coalesce(ctx, 0) + v + 1e-10) AS p FROM ask CROSS JOIN u LEFT JOIN c USING (context, word) LEFT JOIN x USING (context), one WHERE u.word <> '<s>'),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, word) AS rank FROM g) SELECT context, word, round(p, 6) AS p, rank::INTEGER AS rank FROM r WHERE rank <= 6""")
def next_word_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = sentences(spark, sf_dir)
    return N.next_word_probs(train, N.vocabulary(train).orderBy(F.desc("c"), "word").limit(20).select(F.col("word").alias("context")))


@query(f"""{_MODEL}, ask AS (SELECT word AS context FROM u), fill AS (SELECT word FROM u WHERE word <> '<s>' ORDER BY word LIMIT 12),
seen AS (SELECT context, word, c.c FROM c JOIN ask USING (context) WHERE word <> '<s>'), cand AS (SELECT * FROM seen UNION ALL SELECT context, word, 0 FROM ask CROSS JOIN fill WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.context = ask.context AND seen.word = fill.word)),
g AS (SELECT context, word, (cand.c + 1) / (coalesce(ctx, 0) + v + 1e-10) AS p FROM cand LEFT JOIN x USING (context), one),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, word) AS rank FROM g) SELECT context, word, round(p, 6) AS p, rank::INTEGER AS rank FROM r WHERE rank <= 6""")
def next_words_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """next_word_probs, whose SQL asks the 20 most frequent contexts, for every context of the vocabulary."""
    train = sentences(spark, sf_dir)
    return N.next_word_probs(train, N.vocabulary(train).select(F.col("word").alias("context")))


_WORDS = ["the", "of", "and", "in"]


@query(f"""{_MODEL}, w(word) AS (VALUES ('the'), ('of'), ('and'), ('in')), ws AS (SELECT word AS context FROM w),
g AS (SELECT context, w.word, (coalesce(c.c, 0) + 1) / (coalesce(ctx, 0) + v + 1e-10) AS p FROM ws CROSS JOIN w LEFT JOIN c USING (context, word) LEFT JOIN x USING (context), one)
SELECT context, {', '.join(f"round(max(p) FILTER (WHERE word = '{w}'), 6) AS {w if w not in ('and', 'in') else chr(34) + w + chr(34)}" for w in _WORDS)} FROM g GROUP BY context""")
def bigram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.bigram_matrix(sentences(spark, sf_dir), _WORDS)


@query(f"""{_MODEL}, ev AS (SELECT event_id AS rec_id, event_type AS label, -value AS score, 10 AS n_frames FROM events),
l(label, prev) AS (VALUES ('the', 'of'), ('of', 'the'), ('and', 'of')), s AS (SELECT rec_id, prev, l.label, score - 3 * length(l.label) AS score, n_frames FROM ev, l),
w(weight) AS (VALUES (0.0::DOUBLE), (0.1), (0.3), (1.0)),
t AS (SELECT rec_id, weight, label, score / n_frames + weight * ln((coalesce(c.c, 0) + 0.5) / (coalesce(ctx, 0) + 0.5 * v) + 1e-10) AS total
  FROM s LEFT JOIN c ON c.context = prev AND c.word = label LEFT JOIN x ON x.context = prev, one, w),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, weight ORDER BY total DESC, label) AS k FROM t) SELECT rec_id, weight, label, round(total, 6) AS total FROM r WHERE k = 1""")
def map_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), (-F.col("value")).alias("score"), F.lit(10).alias("n_frames"))
    labels = spark.createDataFrame([("the", "of"), ("of", "the"), ("and", "of")], "label string, prev string")
    s = e.crossJoin(F.broadcast(labels)).withColumn("score", F.col("score") - 3 * F.char_length("label"))
    return N.map_rerank(s, sentences(spark, sf_dir))
