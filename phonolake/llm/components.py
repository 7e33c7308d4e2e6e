"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): for each node of an edge the least node that it is connected to.

    Large-star and small-star in turns, until the edges are stars around their roots. Each is a minimum over a node's
    neighbours, summed up before it is shuffled, and joined back; no node's neighbours are gathered.
    """
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        e = checkpointed(small.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
