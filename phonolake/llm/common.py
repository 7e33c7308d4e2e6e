"""What the operators share: reading tables, words and code points."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: white space is the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is. The quick way serves texts of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, so that added columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may do without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="spark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder that spark.checkpoint.dir names, which outlives any executor.

    Spark removes a copy when nothing refers to it any longer, if spark.cleaner.referenceTracking.cleanCheckpoints says so.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors and the driver see."""
    import uuid

    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes what shared_folder has named, when nothing reads it any longer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, jobs send Python no more than so many rows at a time: texts are long, and a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_join(big: DataFrame, small: DataFrame, on: dict[str, str], by: list[str], how: str = "inner", tasks: int = 256) -> DataFrame:
    """big joined with small by on (names in big to names in small, nulls equal), hot keys dealt out to many tasks by a hash of their rows' columns by.

    small has one row for a key; its names in on are dropped. Rows of big are counted by key first, with sums before the shuffle. A key with more
    than 1 / tasks of them (of the session's shuffle partitions, if these are more) goes to as many tasks as it has such shares, and
    its row of small is repeated as often; all other keys meet once. Hot keys are fewer than tasks, and only these are broadcast. A null key of big,
    with or without a row of small, is a key like any other.
    """
    names = fresh(big, "_ways", "_turn", "_at", *[f"_key{k}" for k in range(len(on))])
    ways, turn, at, keys = names[0], names[1], names[2], names[3:]
    tasks = max(tasks, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = big.count()
    counts = big.groupBy(*[F.col(a).alias(k) for a, k in zip(on, keys, strict=True)]).agg(F.count("*").alias(ways))
    hot = checkpointed(counts.filter(F.col(ways) * tasks > total).withColumn(ways, F.ceil(F.col(ways) * tasks / total).cast("int")))
    equal = lambda left, right: reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])
    same = equal(on, on.values())
    if hot.isEmpty():
        return big.join(small, same, how).drop(*on.values())
    share = F.coalesce(F.col(ways), F.lit(1))
    big = big.join(F.broadcast(hot), equal(on, keys), "left").withColumn(turn, F.pmod(F.xxhash64(F.lit(tasks), *by), share).cast("int")).drop(ways, *keys)
    small = small.join(F.broadcast(hot), equal(on.values(), keys), "left").withColumn(at, F.explode(F.sequence(F.lit(0), share - 1))).drop(ways, *keys)
    return big.join(small, same & (F.col(turn) == F.col(at)), how).drop(turn, at, *on.values())


def uneven_join(big: DataFrame, small: DataFrame, on: dict[str, str], rows: str, share: float = 1e-3) -> DataFrame:
    """big joined with small by on (names in big to names in small), where rows of small says how many rows of big have the key.

    Keys with more than that share of big are fewer than 1 / share rows of small, and are broadcast; the others are shuffled, and
    none of them can fill a task.
    """
    total = small.agg(F.sum(rows).alias("n")).first()["n"] or 0
    hot = F.broadcast(checkpointed(small.filter(F.col(rows) > total * share)))
    same = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in on.items()])
    cold = big.join(hot.select(*on.values()), same, "left_anti").join(small, same)
    return cold.unionByName(big.join(hot, same)).drop(*on.values())
