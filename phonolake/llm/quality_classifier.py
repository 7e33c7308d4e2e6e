"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairs of features interact through products of low-rank vectors. Their sum over all pairs is half of (square of the sum - sum of
squares), rank by rank, so that a text is scored in time linear in its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.llm.common import fresh, read, small_batches
from phonolake.llm.encoding import slices

#: Buckets of hashed words; words whose bucket a worker keeps.
WORDS, KEEP = 4096, 200_000
#: Kinds of bytes, whose shares of a text are features.
UPPER, LOWER, DIGIT, BLANK, LINE, BANG, BAR, MARK, OTHER, HIGH = range(10)
KIND = np.array(
    [UPPER if 65 <= k < 91 else LOWER if 97 <= k < 123 else DIGIT if 48 <= k < 58 else LINE if k == 10 else BLANK if k <= 32 else BANG if k in b"!?" else BAR if k in b"|<>" else MARK if k in b"#*$%&@^~_=+\\" else OTHER if k < 128 else HIGH for k in range(256)],
    dtype=np.uint8,
)
#: Structure and metadata features, after the words' buckets.
STRUCTURE = ["upper", "lower", "digit", "blank", "line", "bang", "bar", "mark", "other", "high", "same_as_last", "distinct", "dup_lines", "word_length", "n_words", "empty", "n_chars", "no_n_chars", "other_n_chars"]
SIZE = WORDS + len(STRUCTURE)


class Buckets(dict):
    """The bucket of a word, kept for the first words that come."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode()) % WORDS
        if len(self) < KEEP and len(word) <= 64:
            self[word] = bucket
        return bucket


def features(texts: list[str | None], n_chars: list[int | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and values of each text's features, and where each one's begin, with a last end.

    A word's value is its share of the length of the text's vector of counts; shares of structure are square roots of what they
    are. A text without words has its structure alone, so none is without features.
    """
    texts = [t or "" for t in texts]
    words = [t.lower().split() for t in texts]
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    rows = np.arange(len(texts))
    own = np.repeat(rows, sizes)
    bucket = np.fromiter((buckets[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
    key, n = np.unique(own * WORDS + bucket, return_counts=True)
    row, which = key // WORDS, key % WORDS
    length = np.sqrt(np.bincount(row, weights=n.astype(float) ** 2, minlength=len(texts)))
    again = np.bincount(own[1:], weights=(bucket[1:] == bucket[:-1]) & (own[1:] == own[:-1]), minlength=len(texts))
    distinct = np.bincount(row, minlength=len(texts))
    s = np.zeros((len(texts), len(STRUCTURE)))
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        lines = [x for x in t.split("\n") if x and not x.isspace()]
        s[k, :10] = np.bincount(KIND[raw], minlength=10) / max(len(raw), 1)
        s[k, 12] = (len(lines) - len(set(lines))) / max(len(lines), 1)
        s[k, 13] = min((len(t) - sizes[k]) / max(sizes[k], 1) / 40, 1.0)
    some = np.maximum(sizes, 1)
    s[:, 10], s[:, 11] = again / some, distinct / np.minimum(some, WORDS)
    s[:, :13] = np.sqrt(np.minimum(s[:, :13], 1.0))
    s[:, 14], s[:, 15] = np.log1p(sizes) / 12, sizes == 0
    told, real = np.array([-1 if x is None else max(x, 0) for x in n_chars], dtype=float), np.array(list(map(len, texts)))
    s[:, 16], s[:, 17], s[:, 18] = np.log1p(np.maximum(told, 0)) / 16, told < 0, (told >= 0) & (told != real)
    # words, then structure, row by row
    row = np.concatenate([row, np.repeat(rows, len(STRUCTURE))])
    order = np.argsort(row, kind="stable")
    index = np.concatenate([which, np.tile(np.arange(WORDS, SIZE), len(texts))])[order]
    value = np.concatenate([n / length[row[: len(n)]], s.ravel()])[order]
    return index, value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])


@dataclass
class Machine:
    """bias, a weight for each feature, and a vector for each feature."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One for each row of sparse features, none of which is empty."""
        if len(at) < 2:
            return np.zeros(0)
        add = lambda x: np.add.reduceat(x, at[:-1], axis=0)
        v = self.vectors[index] * value[:, None]
        return self.bias + add(self.weights[index] * value) + 0.5 * (add(v) ** 2 - add(v**2)).sum(axis=1)


def chance(logits: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray, *, rank: int = 8, steps: int = 150, rate: float = 0.05, decay: float = 1e-4, seed: int = 13) -> Machine:
    """A machine for dense rows x, by Adam's steps on the weighted log loss over all of them."""
    share = float((weight * label).sum() / weight.sum())
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(x.shape[1]), np.random.default_rng(seed).normal(0, 0.05, (x.shape[1], rank))]
    x = x.astype(np.float32)
    square, mean, spread, weight = x**2, [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], weight / weight.sum()
    for step in range(1, steps + 1):
        bias, w, v = theta
        s = x @ v.astype(np.float32)
        logits = bias + x @ w.astype(np.float32) + 0.5 * ((s**2).sum(axis=1) - square @ (v**2).sum(axis=1).astype(np.float32))
        g = (weight * (chance(logits) - label)).astype(np.float32)
        slopes = [np.array([g.sum()]), x.T @ g + decay * w, x.T @ (g[:, None] * s) - (square.T @ g)[:, None] * v + decay * v]
        for k, d in enumerate(slopes):
            mean[k], spread[k] = 0.9 * mean[k] + 0.1 * d, 0.999 * spread[k] + 0.001 * d**2
            theta[k] = theta[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2])


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is kept from training: the id's CRC, as text, is 2 modulo 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars", label: str = "quality", label_docs: int = 1000, **options) -> Machine:
    """A machine that tells label 1 from label 0, by a sample of about label_docs rows of each label, chosen by a hash of the id, or of all if there are no more.

    labels has doc_id and label; ids of held_out are not looked at, nor rows without id or with another label. An id with several labels
    has the least one; an id with several rows of docs has the one whose text has the least hash. Each label weighs in training by
    all its rows in labels. Without rows of one of the labels, scores are the smoothed share of label 1.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.min("label").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Machine(float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))), np.zeros(SIZE), np.zeros((SIZE, 1)))
    below = F.when(F.col("label") == 1, F.lit(label_docs / n[1])).otherwise(F.lit(label_docs / n[0])) * float(1 << 30)
    # about label_docs rows of each label
    sample = F.broadcast(rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < below))
    told = F.lit(None) if n_chars is None else F.col(n_chars)
    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"), told.cast("long").alias("n_chars")).join(sample, F.col("_id") == F.col("id"))
    d = d.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars")).alias("x")).select("id", "label", "x.text", "x.n_chars")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in slices(batches):
            index, value, at = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), buckets)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (index.astype(np.int16), value.astype(np.float32))]
            yield pa.record_batch([batch.column("id"), batch.column("label"), *lists], names=["id", "label", "index", "value"])

    found = sorted(d.mapInArrow(extract, "id long, label int, index array<short>, value array<float>").collect(), key=lambda r: r["id"])
    x, y = np.zeros((len(found), SIZE), dtype=np.float32), np.array([r["label"] for r in found])
    for k, r in enumerate(found):
        x[k, r["index"]] = r["value"]
    if len(set(y.tolist())) < 2:  # labels of rows that docs has not
        return Machine(float(np.log((n[1] + 1) / (n[0] + 1))), np.zeros(SIZE), np.zeros((SIZE, 1)))
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    return fit(x, y, weight, **options)


def quality_scores(docs: DataFrame, machine: Machine, *, text: str = "text", n_chars: str | None = "n_chars", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with score (0 to 1, the chance of label 1) and predicted (1 from threshold on, else 0), in
    columns of these names, or of ones with _ before them where keep has them.

    Texts are scored whole, by their words, structure and n_chars alone. Null texts are empty ones, which are scored by their structure; null
    n_chars is a feature of its own. Repeated rows are rows like any other and score alike; no rows: none come back.
    """
    kept = docs.select(*(docs.columns if keep is None else keep))
    own, told, score, predicted = fresh(kept, "own_text", "told", "score", "predicted")
    d = docs.select(F.col(text).cast("string").alias(own), (F.lit(None) if n_chars is None else F.col(n_chars)).cast("long").alias(told), *kept.columns)
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in slices(batches, 1000, 4 << 20):
            chances = np.round(chance(machine.logits(*features(batch.column(0).to_pylist(), batch.column(1).to_pylist(), buckets))), 6)
            yield pa.record_batch([*batch.columns[2:], pa.array(chances, pa.float64()), pa.array((chances >= threshold).astype(np.int32))], names=[*batch.schema.names[2:], score, predicted])

    with small_batches(docs.sparkSession):
        return d.mapInArrow(work, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = train(docs, read(spark, sf_dir, "labels"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", "n_chars")
    return quality_scores(d, machine, keep=["doc_id", "held_out"])
