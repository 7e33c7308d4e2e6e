"""What the operators share: joins whose hot keys are dealt out."""

import pytest
from pyspark.sql import functions as F

from phonolake.llm.common import spread_join


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("hot", [True, False])
def test_spread_join(spark, how, hot):
    keys = ["a"] * 300 + [None] * 200 + ["gone"] * 150 if hot else []
    keys += [f"k{i % 2500}" for i in range(5000)]
    big = spark.createDataFrame([(i, k, i % 2, -1) for i, k in enumerate(keys)], "id long, key string, part long, _turn int").repartition(5)
    small = spark.createDataFrame([("a", 0, "A0"), ("a", 1, "A1"), (None, 0, "N"), ("unused", 0, "U"), *((f"k{i}", i % 2, f"v{i}") for i in range(0, 2500, 3))], "_key string, _part long, value string")
    found = {(k, p): v for k, p, v in small.collect()}
    want = []
    for i, k in enumerate(keys):
        match = found.get((k, i % 2))
        if how == "left_anti":
            want += [(i, k, i % 2, -1)] if match is None else []
        elif match is not None or how == "left":
            want.append((i, k, i % 2, -1, match))
    got = [tuple(r) for r in spread_join(big, small, {"key": "_key", "part": "_part"}, ["id"], how).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_spread_join_deals_out(spark):
    """A key with nearly all rows is the work of many partitions, and the others' rows are not repeated."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        big = spark.range(20_000).select("id", F.when(F.col("id") < 19_000, 0).otherwise(F.col("id")).alias("key"))
        small = big.select(F.col("key").alias("_key")).distinct()
        parts = spread_join(big, small, {"key": "_key"}, ["id"]).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == 20_000 and max(r["count"] for r in parts) < 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_spread_join_empty(spark):
    big = spark.createDataFrame([], "id long, key string")
    small = spark.createDataFrame([], "_key string, value string")
    for how in ("inner", "left"):
        d = spread_join(big, small, {"key": "_key"}, ["id"], how)
        assert d.columns == ["id", "key", "value"] and d.count() == 0
