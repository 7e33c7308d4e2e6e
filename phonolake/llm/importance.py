"""Importance resampling towards a target distribution: hashed n-gram features, gains of their buckets, and a draw without replacement.

Each partition's n-grams are counted by DuckDB; the counts are spilled as Parquet, and Spark merges them, scores and draws.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.llm.common import LOWER, UPPER, checkpointed, read, shared_folder
from phonolake.llm.encoding import slices

#: Fixed value of the contract: what is left of ASCII for words is digits and lower-case letters.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPILLED = "is_total boolean, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"
#: Scores of one window in the running count of scores.
BIN = 256


def _gram_sql(max_n: int) -> str:
    """n-grams of each row as SQL: words by unnest, longer runs by windows over a row's words."""
    if max_n == 1:
        return "SELECT k, unnest(w) AS feature FROM words"
    ahead = ["word"]
    for n in range(1, max_n):
        ahead.append(f"{ahead[-1]} || ' ' || lead(word, {n}) OVER o")
    return f"""SELECT k, feature FROM (SELECT k, unnest(runs) AS feature FROM (
        SELECT k, [{", ".join(ahead)}] AS runs FROM (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words) WINDOW o AS (PARTITION BY k ORDER BY place)))
        WHERE feature IS NOT NULL"""


class BucketCounts:
    """A DuckDB session of one task, with zlib's CRC as a function, that counts the buckets of a batch's n-grams."""

    def __init__(self, buckets: int, max_n: int) -> None:
        import duckdb

        self.buckets, self.max_n = buckets, max_n
        # one thread, for Spark deals out the cores, and no files beside Spark's own
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})
        text, number = duckdb.sqltypes.VARCHAR, duckdb.sqltypes.BIGINT
        self.con.create_function("crc", lambda x: pa.array([zlib.crc32(s.encode()) for s in x.to_pylist()], pa.int64()), [text], number, type="arrow")

    def count(self, texts: pa.Array) -> tuple[list[tuple], tuple]:
        """For each text (k, n_words, n_features, buckets, counts), and the sums of all texts (buckets, counts)."""
        con = self.con
        batch = pa.table({"k": pa.array(range(len(texts)), pa.int64()), "text": texts.cast(pa.string())})
        con.register("batch", batch)
        con.execute(f"CREATE OR REPLACE TEMP TABLE words AS SELECT k, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{FEATURE_WORD}') AS w FROM batch")
        con.unregister("batch")
        con.execute(f"CREATE OR REPLACE TEMP TABLE found AS SELECT k, feature, count(*) AS n FROM ({_gram_sql(self.max_n)}) GROUP BY k, feature")
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE hashed AS WITH b AS (SELECT feature, crc(feature) % {self.buckets} AS bucket FROM (SELECT DISTINCT feature FROM found)) "
            "SELECT k, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM found JOIN b USING (feature) GROUP BY k, bucket"
        )
        rows = con.sql(
            "SELECT k, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(b, []) AS buckets, coalesce(c, []) AS counts FROM words "
            "LEFT JOIN (SELECT k, sum(n) AS n, list(bucket ORDER BY bucket) AS b, list(n ORDER BY bucket) AS c FROM hashed GROUP BY k) USING (k) ORDER BY k"
        ).to_arrow_table()
        total = con.sql("SELECT list(bucket) AS buckets, list(n) AS counts FROM (SELECT bucket, sum(n)::BIGINT AS n FROM hashed GROUP BY bucket)").to_arrow_table()
        return rows, total


def spill_bucket_counts(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", buckets: int = 10_000, max_n: int = 1) -> None:
    """Writes bucket counts of docs as Parquet: a row for each row of docs, and rows with the sums of some of them (is_total).

    Features are all runs of 1 to max_n words; a feature's bucket is the CRC of its UTF-8 bytes, modulo buckets. Null and
    empty texts have no features; repeated rows and null ids are rows like any other; no rows of docs: no rows. Other
    columns are not looked at. What a lost executor has written is written again by Spark's commit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(buckets, max_n)
        lists = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in slices(batches, 2500):
            rows, total = counts.count(batch.column("text"))
            n = batch.num_rows
            yield pa.record_batch(
                [pa.array([False] * n + [True]), pa.array([*batch.column("doc_id").to_pylist(), None], pa.int64()),
                 *(pa.concat_arrays([rows[c].combine_chunks().cast(pa.int64()), pa.array([None], pa.int64())]) for c in ("n_words", "n_features")),
                 *(pa.concat_arrays([rows[c].combine_chunks().cast(t), pa.array(total[c].to_pylist(), t)]) for c, t in zip(("buckets", "counts"), lists, strict=True))],
                names=["is_total", "doc_id", "n_words", "n_features", "buckets", "counts"],
            )

    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, SPILLED).write.parquet(path)


def bucket_totals(spilled: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the features of all rows by bucket, merged from the sums of spilled. No rows: none come back."""
    each = spilled.filter("is_total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for each bucket that corpus has: a thousand times the log of its smoothed share of target over that of corpus.

    Both are spilled bucket counts. Without target rows, gains are by the corpus alone. Sums are longs, quotients doubles.
    """
    total = lambda d: (d.agg(F.sum(F.col("n")).alias("n")).first()["n"] or 0) + buckets
    s, t = checkpointed(bucket_totals(corpus, "n")), checkpointed(bucket_totals(target, "n"))
    n_s, n_t = float(total(s)), float(total(t))
    both = s.join(t.select("bucket", F.col("n").alias("t")), "bucket", "left")
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log((d("t") * n_s) / (d("n") * n_t))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel number, rounded down, that the seed and the id determine; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(spilled: DataFrame, gains: DataFrame, *, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of the rows of spilled bucket counts.

    weight: the mean gain of a row's features, rounded down, 0 without any; score: weight and noise of the id. The gains go to
    all tasks as one array of so many buckets.
    """
    known = {r["bucket"]: r["gain"] for r in gains.collect()}
    array = F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(buckets))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(array, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    d = spilled.filter("not is_total").select("doc_id", "n_words", "n_features", total.alias("g"))
    weight = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return d.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, *, percent: int = 10, min_words: int = 20) -> DataFrame:
    """scored, which is read several times, with rank: of the rows with min_words or more, so many percent with the highest scores get 1, 2, 3...

    Ties go to the smaller doc_id (null first), then to fewer features; rows that are not drawn have no rank. Scores are
    integers within a range that does not grow with the rows, so that their counts tell where a score's ranks begin; ranks are given
    within each score. Equal rows are counted, not gathered. No rows: none come back.
    """
    able = scored.filter(F.col("n_words") >= min_words)
    hist = checkpointed(able.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") / BIN)))
    drawn = (hist.agg(F.sum("n").alias("n")).first()["n"] or 0) * percent // 100
    bins = hist.groupBy("bin").agg(F.sum("n").alias("in_bin"))
    bins = bins.select("bin", (F.sum("in_bin").over(W.orderBy(F.desc("bin"))) - F.col("in_bin")).alias("above"))
    inside = F.sum("n").over(W.partitionBy("bin").orderBy(F.desc("score"))) - F.col("n")
    starts = checkpointed(hist.withColumn("inside", inside).join(bins, "bin").select("score", (F.col("above") + F.col("inside")).alias("start")).filter(F.col("start") < drawn))
    least = starts.agg(F.min("score").alias("s")).first()["s"]
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    rest = scored.filter(~high).select(*out, F.lit(None).cast("long").alias("rank"))
    top = scored.filter(high).groupBy(*out).agg(F.count("*").alias("n")).join(starts, "score")
    top = top.withColumn("at", F.col("start") + F.sum("n").over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    # equal rows come back by blocks, so that no array has them all
    block = 10_000
    top = top.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    top = top.withColumn("k", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + block, F.col("n"))))).withColumn("rank", F.col("at") + F.col("k"))
    return rest.unionByName(top.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))


def importance_resampling(
    docs: DataFrame, target: DataFrame, *, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", buckets: int = 10_000, max_n: int = 1, seed: int = 2024, percent: int = 10, min_words: int = 20
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs, drawn to be like target.

    Null and empty texts have no features, weight 0 and are not drawn; repeated rows are rows like any other, with ranks that follow each
    other; a null id has the noise of an empty one. Without target rows the draw goes by the corpus alone; no rows of docs: none
    come back. Other columns of both are not looked at.
    """
    spark, spilled = docs.sparkSession, []
    for part, column, own in ((docs, text, F.col(doc_id)), (target, target_text, F.lit(None))):
        path = shared_folder(spark, "bucket-counts")
        spill_bucket_counts(part.select(own.cast("long").alias("doc_id"), F.col(column).alias("text")), path, buckets=buckets, max_n=max_n)
        spilled.append(spark.read.schema(SPILLED).parquet(path))
    gains = bucket_gains(*spilled, buckets)
    return draw(checkpointed(importance_scores(spilled[0], gains, buckets=buckets, seed=seed)), percent=percent, min_words=min_words)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 percent of the documents with 20 words or more, drawn to be like the benchmark's texts by single words."""
    return importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i AS v, 0 AS k, i::UBIGINT AS c FROM range(256) AS t(i)
  UNION ALL
  SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS crcs FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT r, unnest(w) AS f FROM d),
wanted AS (SELECT unnest(w) AS f FROM b),
forms AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM own UNION SELECT f FROM wanted)),
crc AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ((instr('0123456789ABCDEF', h[2 * i - 1:2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i:2 * i]) - 1)::UBIGINT),
    lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM forms, crc_table),
s AS (SELECT bucket, count(*) AS s FROM own JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN crc USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own) + 10000 AS n_s, (SELECT count(*) FROM wanted) + 10000 AS n_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * n_s::DOUBLE) / ((s + 1)::DOUBLE * n_t::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT r, sum(gain)::DOUBLE AS g, count(*) AS n FROM own JOIN crc USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
    (instr('0123456789abcdef', h[1:1]) - 1) * 268435456 + (instr('0123456789abcdef', h[2:2]) - 1) * 16777216 + (instr('0123456789abcdef', h[3:3]) - 1) * 1048576 + (instr('0123456789abcdef', h[4:4]) - 1) * 65536
    + (instr('0123456789abcdef', h[5:5]) - 1) * 4096 + (instr('0123456789abcdef', h[6:6]) - 1) * 256 + (instr('0123456789abcdef', h[7:7]) - 1) * 16 + instr('0123456789abcdef', h[8:8]) - 1 AS h
  FROM (SELECT *, sha256('2024:' || coalesce(doc_id::VARCHAR, '')) AS h FROM d) LEFT JOIN weights USING (r)),
final AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranked) THEN rank END::BIGINT AS rank
FROM final LEFT JOIN ranked USING (r)
"""
