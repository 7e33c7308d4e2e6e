"""N-gram language models as tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.operators.blocks import with_recording
from phonolake.sources.folders import checkpointed


def tokenize(text: Column) -> Column:
    """Lower case, split where there are no letters, in <s> and </s>."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    return F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))


def ngrams_of(sentences: DataFrame, n: int) -> DataFrame:
    """(sent_id, tokens) -> (sent_id, context, word) for each n-gram, context being the n - 1 words before joined by spaces."""
    starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1)).otherwise(F.array().cast("array<int>"))
    d = sentences.select("sent_id", F.explode(F.transform(starts, lambda k: F.slice("tokens", k, n))).alias("g"))
    return d.select("sent_id", F.array_join(F.slice("g", 1, n - 1), " ").alias("context") if n > 1 else F.lit("").alias("context"), F.element_at("g", -1).alias("word"))


def ngram_counts(sentences: DataFrame, n: int = 2) -> DataFrame:
    return ngrams_of(sentences, n).groupBy("context", "word").agg(F.count("*").alias("c"))


def context_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("context").agg(F.sum("c").alias("context_c"))


def vocabulary(sentences: DataFrame) -> DataFrame:
    """(word, c), sentence marks included."""
    return sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def totals(sentences: DataFrame, n: int) -> DataFrame:
    """One row: v, the size of the vocabulary, and n_total, the number of n-grams."""
    v = vocabulary(sentences).agg(F.count("*").alias("v"))
    total = sentences.agg(F.sum(F.greatest(F.size("tokens") - n + 1, F.lit(0))).cast("long").alias("n_total"))
    return v.crossJoin(total)


def ngram_logprob(events: DataFrame, sentences: DataFrame, n: int = 2, smoothing: str = "laplace", k: float = 0.5, variant: str = "module") -> DataFrame:
    """Adds logprob to (…, context, word) under counts of sentences.

    mle: c / context, null where there is none; laplace: (c + 1) / (context + V + 1e-10); add_k: (c + k) / (context + k V);
    backoff: c / context, else 0.4 times the word's own estimate, which is 1 / (N + V) in the module variant of a
    model above unigrams, as it holds no unigrams, and (c1 + 1) / (N1 + V) in the notebook variant.
    """
    counts = ngram_counts(sentences, n)
    one = totals(sentences, n)
    d = events.join(counts, ["context", "word"], "left").join(context_counts(counts), "context", "left").crossJoin(F.broadcast(one))
    c, ctx, v = F.coalesce("c", F.lit(0)), F.coalesce("context_c", F.lit(0)), F.col("v")
    if smoothing == "mle":
        p = F.when(c > 0, c / F.nullif(ctx, F.lit(0)))
    elif smoothing == "laplace":
        p = (c + 1) / (ctx + v + 1e-10)
    elif smoothing == "add_k":
        p = (c + k) / (ctx + k * v)
    elif variant == "notebook":
        words = vocabulary(sentences).withColumnRenamed("c", "c1")
        n1 = words.agg(F.sum("c1").alias("n1"))
        d = d.join(words, "word", "left").crossJoin(F.broadcast(n1))
        p = F.when(c > 0, c / F.nullif(ctx, F.lit(0))).otherwise(0.4 * (F.coalesce("c1", F.lit(0)) + 1) / (F.col("n1") + v))
    else:
        own = 1 / (F.col("n_total") + v) if n > 1 else (c + 1) / (F.col("n_total") + v)
        p = F.when(c > 0, c / F.nullif(ctx, F.lit(0))).otherwise(0.4 * own if n > 1 else own)
    return d.withColumn("logprob", F.log(p)).drop("c", "context_c", "v", "n_total", "c1", "n1")


def sentence_logprob(test: DataFrame, train: DataFrame, n: int = 2, smoothing: str = "laplace", **options) -> DataFrame:
    """(sent_id, logprob, n_grams); null if an n-gram has no probability."""
    d = ngram_logprob(ngrams_of(test, n), train, n, smoothing, **options)
    whole = F.count("*") == F.count("logprob")
    return d.groupBy("sent_id").agg(F.when(whole, F.sum("logprob")).alias("logprob"), F.count("*").alias("n_grams"))


def perplexity(test: DataFrame, train: DataFrame, n: int = 2, smoothing: str = "laplace", **options) -> DataFrame:
    """exp(-sum of log probabilities / number of n-grams), -100 for a sentence that has none."""
    scored = sentence_logprob(test, train, n, smoothing, **options).select("sent_id", F.coalesce("logprob", F.lit(-100.0)).alias("ll"))
    d = test.select("sent_id", F.greatest(F.size("tokens") - n + 1, F.lit(1)).alias("m")).join(scored, "sent_id", "left")
    return d.agg(F.exp(-F.sum(F.coalesce("ll", F.lit(0.0))) / F.sum("m")).alias("perplexity"), F.sum("m").alias("n_grams"))


def lm_compare(test: DataFrame, train: DataFrame, models: tuple[tuple[str, int], ...] = (("mle", 2), ("laplace", 2), ("backoff", 2), ("laplace", 1))) -> DataFrame:
    union = None
    for smoothing, n in models:
        d = perplexity(test, train, n, smoothing).select(F.lit(smoothing).alias("smoothing"), F.lit(n).alias("n"), "perplexity")
        union = d if union is None else union.unionAll(d)
    return union


def next_word_probs(sentences: DataFrame, contexts: DataFrame, top: int = 6) -> DataFrame:
    """(context) -> the top words after it by Laplace estimate, <s> aside, ties by word. Words that never follow a context share
    one estimate below those of the words that do, so the first 2 * top words are enough to fill up."""
    counts = ngram_counts(sentences, 2)
    one = totals(sentences, 2)
    seen = contexts.join(counts, "context").filter("word <> '<s>'").select("context", "word", "c")
    fill = vocabulary(sentences).filter("word <> '<s>'").select("word")
    other = contexts.crossJoin(F.broadcast(fill.orderBy("word").limit(2 * top))).join(seen.select("context", "word"), ["context", "word"], "left_anti").withColumn("c", F.lit(0).cast("long"))
    d = seen.unionAll(other).join(context_counts(counts), "context", "left").crossJoin(F.broadcast(one))
    d = d.withColumn("p", (F.col("c") + 1) / (F.coalesce("context_c", F.lit(0)) + F.col("v") + 1e-10))
    rank = F.row_number().over(W.partitionBy("context").orderBy(F.desc("p"), "word"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top).select("context", "word", "p", "rank")


def bigram_matrix(sentences: DataFrame, words: list[str]) -> DataFrame:
    """A row for each word before, a Laplace estimate for each word after."""
    spark = sentences.sparkSession
    rows = spark.createDataFrame([(w,) for w in words], "context string")
    grid = rows.crossJoin(spark.createDataFrame([(w,) for w in words], "word string"))
    d = ngram_logprob(grid, sentences, 2, "laplace")
    return d.groupBy("context").pivot("word", words).agg(F.first(F.exp("logprob")))


def map_rerank(scores: DataFrame, sentences: DataFrame, weights: tuple[float, ...] = (0.0, 0.1, 0.3, 1.0), k: float = 0.5, vocabulary_size: int | None = None) -> DataFrame:
    """(rec_id, prev, label, score, n_frames) -> the best label of each recording and weight: score / n_frames + weight ln(P(label | prev) + 1e-10)."""
    counts = ngram_counts(sentences, 2)
    v = F.lit(vocabulary_size) if vocabulary_size else F.col("v")
    one = totals(sentences, 2).select("v")
    # probabilities are looked up once for each pair that scores ask for; frequent pairs go to all tasks, so that no pair's rows meet in one
    d = scores.withColumn("pair", F.struct("prev", "label"))
    asked = d.groupBy("pair").agg(F.count("*").alias("times")).select("pair", "pair.*", "times")
    asked = asked.join(counts.select(F.col("context").alias("prev"), F.col("word").alias("label"), "c"), ["prev", "label"], "left")
    asked = asked.join(context_counts(counts).withColumnRenamed("context", "prev"), "prev", "left").crossJoin(F.broadcast(one))
    p = (F.coalesce("c", F.lit(0)) + k) / (F.coalesce("context_c", F.lit(0)) + k * v)
    d = with_recording(d, checkpointed(asked.select("pair", "times", p.alias("p"))), "times", key="pair")
    d = d.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    d = d.withColumn("total", F.col("score") / F.col("n_frames") + F.col("weight") * F.log(F.col("p") + 1e-10))
    best = F.row_number().over(W.partitionBy("rec_id", "weight").orderBy(F.desc("total"), "label"))
    return d.withColumn("k", best).filter("k = 1").select("rec_id", "weight", "label", "total")
