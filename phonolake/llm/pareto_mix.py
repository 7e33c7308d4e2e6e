"""Mixing sources to target weights with Pareto order sampling.

Within a source documents are included with unequal probabilities: the share of a document, its copies on average, is in
proportion to its level, the logarithm of its length, as far as no document gets more than a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.llm.common import WORD, checkpointed, fresh, read, spread_join

#: Each level of the search for a source's cut tells this many bins apart.
BINS = 4096


def words_in(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def ranked_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds weight to the rows of sources: by code point of source, nulls last, weights in turn.

    Places are counted within ranges of sources and then moved by what the ranges before hold, so no task sees all.
    """
    held = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    at = held.withColumn("at", inside).join(before, "part").withColumn("at", F.col("at") + F.col("before") - 1)
    return at.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights)).cast("int"))).drop("part", "at", "before")


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target to (source, source_size, weight): shares of the sum of sizes by weight, none above most times its size.

    What the capped sources can't take goes to the others by weight, until none is above: the level rises from round to
    round, each one sum over the sources, and ends when no source is newly capped.
    """
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * most <= F.col("weight") * level
        s = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if s["n"] == capped or not s["open"]:
            break
        capped, level = s["n"], (total - s["taken"]) / s["open"]
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level or 0.0))))


def level_of(size: Column) -> Column:
    """1 for texts of no or one word, 2 for two to five, and one more for each doubling."""
    return F.floor(F.log2(size + 2)).cast("int")


def shares(sized: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, level, size) and (source, source_size, target) -> (source, level, source_size, target, share).

    share = min(most, c * level), c being such that a source's shares times sizes add up to its target. Levels go from
    the highest down: if those above are at most, c follows for the rest, and holds from the first level that it keeps within
    most. A source has as many rows as lengths have doublings, so no window grows with the documents.
    """
    d = sized.groupBy("source", "level").agg(F.sum("size").alias("s"))
    d = d.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole, above = W.partitionBy("source"), W.partitionBy("source").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    weight = F.col("level") * F.col("s")
    rest = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(above), F.lit(0))
    c = (F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("s").over(above), F.lit(0))) / F.nullif(rest, F.lit(0))
    d = d.withColumn("c", c)
    fits = F.when(F.col("c") * F.col("level") <= most, F.struct("level", "c"))
    d = d.withColumn("c", F.max(fits).over(whole)["c"])
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("c") * F.col("level"), F.lit(float(most))))).otherwise(0.0)
    return d.select("source", "level", "source_size", "target", share.alias("share"))


def pareto_copies(docs: DataFrame, *, seed: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds copies to (doc_id, source, size, share), share being the copies that a row is to get on average.

    Each row gets floor(share) certain copies. One more goes, source by source, to the rows with the smallest ranks
    until their words are as near as can be to what the fractions are to add: the rank is the odds of a random number,
    fixed by seed and the columns by, over the odds of the fraction (Pareto order sampling). Ranks are turned into numbers from 0
    to 1 and the cut is found in three levels of bins, so that no window holds more than BINS bins or the rows of
    one bin of the second level.
    """
    certain = F.floor("share").cast("long")
    d = docs.withColumn("certain", certain).withColumn("part", F.col("share") - certain)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    rank = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    d = d.withColumn("z", F.when(F.col("part") > 0, rank / (1 + rank)))
    d = d.withColumn("b1", F.floor(F.col("z") * BINS).cast("int"))
    d = d.withColumn("b2", F.floor((F.col("z") * BINS - F.col("b1")) * BINS).cast("int"))
    d = checkpointed(d)
    need = d.groupBy("source").agg(F.sum(F.col("part") * F.col("size")).alias("need"))

    def cut(rows: DataFrame, by: list[str], need: DataFrame, name: str) -> DataFrame:
        """The bin in which the words of the rows, in order of rank, pass what is needed, and what is needed of it."""
        sums = rows.groupBy("source", *by).agg(F.sum("size").alias("in_bin")).join(need.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        w = W.partitionBy("source").orderBy(by[-1])
        sums = sums.withColumn("to", F.sum("in_bin").over(w)).filter((F.col("to") > F.col("need")) & (F.col("to") - F.col("in_bin") <= F.col("need")) & (F.col("in_bin") > 0))
        return sums.select("source", F.col(by[-1]).alias(name), (F.col("need") - F.col("to") + F.col("in_bin")).alias("need"))

    ranked = d.filter(F.col("z").isNotNull())
    first = checkpointed(cut(ranked, ["b1"], need, "c1"))
    at1 = first.withColumnRenamed("source", "_source")
    in1 = ranked.join(at1.drop("need"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("b1") == F.col("c1"))).drop("_source", "c1")
    second = checkpointed(cut(in1, ["b2"], first.select("source", "need"), "c2"))
    at2 = second.withColumnRenamed("source", "_source")
    in2 = in1.join(at2, F.col("source").eqNullSafe(F.col("_source")) & (F.col("b2") == F.col("c2"))).drop("_source", "c2")
    w = W.partitionBy("source").orderBy("z", *by).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = in2.withColumn("to", F.sum("size").over(w)).filter((F.col("to") <= F.col("need")) | (F.abs(F.col("to") - F.col("need")) < F.abs(F.col("to") - F.col("size") - F.col("need"))))
    last = last.groupBy("source").agg(F.max(F.struct("z", *by)).alias("last"))
    cuts = first.select(F.col("source").alias("_source"), "c1").join(second.select(F.col("source").alias("_s2"), "c2"), F.col("_source").eqNullSafe(F.col("_s2")), "left")
    cuts = cuts.join(last.select(F.col("source").alias("_s3"), "last"), F.col("_source").eqNullSafe(F.col("_s3")), "left").drop("_s2", "_s3")
    out = spread_join(d, cuts, {"source": "_source"}, list(by), "left")
    in_order = F.coalesce(F.struct("z", *by) <= F.col("last"), F.lit(False))
    # no cut: the source's rows do not reach beyond what is needed, and all of them are taken
    more = F.when(F.col("z").isNull(), False).when(F.col("c1").isNull(), True).when(F.col("b1") != F.col("c1"), F.col("b1") < F.col("c1"))
    more = more.when(F.col("b2") != F.col("c2"), F.col("b2") < F.col("c2")).otherwise(in_order)
    return out.withColumn("copies", F.col("certain") + more.cast("long")).select(*docs.columns, "copies")


def mixture(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: str = "mix") -> DataFrame:
    """One row for each row of docs: doc_id, rid (hash of its text), source, size, source_size, target, share and copies.

    Sources, null being one of them, share the sum of all sizes (words of the whole text; null, empty and blank: 0) by
    their weights, none over most times its own size; a source without words has target 0. share, the average number of
    copies, grows with the document's level and is at most most; shares times sizes add up to the source's target, and
    pareto_copies gives whole copies. Rows of one id, source and text have one rank: they are as one document there, at the
    cut some or all of them may be in. A row never gets more than most copies. Texts of any length are rows like any other. No
    rows: none come back.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(7), F.col(text)).alias("rid"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    sized = checkpointed(sized.withColumn("level", level_of(F.col("size"))))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = checkpointed(targets(ranked_weights(sources, weights), most)).select("source", "source_size", "target")
    by_level = checkpointed(shares(sized, sources, most).withColumnsRenamed({"source": "_source", "level": "_level"}))
    d = spread_join(sized, by_level, {"source": "_source", "level": "_level"}, ["doc_id", "rid"])
    return pareto_copies(d, seed=seed, by=("doc_id", "rid"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mixture takes it, columns as they were; see mixture."""
    key, rid, src, copies = fresh(docs, "key", "rid", "src", "copies")
    taken = mixture(docs, doc_id=doc_id, text=text, source=source, **options).filter(F.col("copies") > 0)
    taken = taken.groupBy(F.col("doc_id").alias(key), F.col("rid").alias(rid), F.col("source").alias(src)).agg(F.max("copies").alias(copies))
    on = F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.lit(7), F.col(text)) == F.col(rid)) & F.col(source).eqNullSafe(F.col(src))
    out = docs.join(taken, on).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "share", "copies")
