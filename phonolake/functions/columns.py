"""Column helpers over arrays and decibels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def to_db(x: Column, ref: float = 1.0, floor: float = -120.0) -> Column:
    """20 log10(|x| / ref + 1e-15), no lower than floor."""
    return F.greatest(20 * F.log10(F.abs(x) / ref + 1e-15), F.lit(floor))


def power_to_db(p: Column, floor: float = -120.0) -> Column:
    return F.greatest(10 * F.log10(p + 1e-15), F.lit(floor))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def frame_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two feature vectors."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def quantize_uniform(x: Column, bits: Column | int) -> Column:
    """Mid-tread levels of 2 / 2^bits in [-1, 1 - step], halves to the even level."""
    step = 2.0 / F.pow(F.lit(2.0), F.lit(bits) if isinstance(bits, int) else bits)
    clip = lambda v: F.least(F.greatest(v, F.lit(-1.0)), 1 - step)
    return clip(F.rint(clip(x) / step) * step)


def make_window(name: str, n: int) -> Column:
    """A symmetric window of n samples as an array column."""
    shapes = {
        "rectangular": lambda a: F.lit(1.0) + 0 * a,
        "hamming": lambda a: 0.54 - 0.46 * F.cos(a),
        "hann": lambda a: 0.5 - 0.5 * F.cos(a),
        "blackman": lambda a: 0.42 - 0.5 * F.cos(a) + 0.08 * F.cos(2 * a),
        "bartlett": lambda a: 1 - F.abs(a / float(3.141592653589793) - 1),
    }
    step = 2 * 3.141592653589793 / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: shapes[name](k.cast("double") * step)) if n > 1 else F.array(F.lit(1.0))


def first_rows(rows: DataFrame, by: str, order: str, n: int, ways: int = 64) -> DataFrame:
    """The n first rows of each by, in order: first in parts of each by, dealt out by a hash, then of what these leave, so that
    no window gathers all rows of a by."""
    d = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(ways)))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(by, "_part").orderBy(order))).filter(F.col("_k") <= n)
    return d.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("_k") <= n).drop("_part", "_k")
