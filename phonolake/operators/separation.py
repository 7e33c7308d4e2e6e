"""Blind source separation of two channels (n, x1, x2) by means over samples: no sample comes to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix_sources(s1: DataFrame, s2: DataFrame, a: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.6), (0.4, 1.0))) -> DataFrame:
    """(n, x) twice -> (n, s1, s2, x1, x2): both at RMS 1, over their common length, mixed by a."""
    return mix_pairs(s1.select("n", F.col("x").alias("a")).join(s2.select("n", F.col("x").alias("b")), "n"), a)


def mix_pairs(d: DataFrame, a: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.6), (0.4, 1.0))) -> DataFrame:
    """mix_sources of sources that are side by side (n, a, b)."""
    rms = d.agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("ra"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("rb"))
    d = d.crossJoin(F.broadcast(rms)).select("n", (F.col("a") / F.col("ra")).alias("s1"), (F.col("b") / F.col("rb")).alias("s2"))
    return d.select("*", (a[0][0] * F.col("s1") + a[0][1] * F.col("s2")).alias("x1"), (a[1][0] * F.col("s1") + a[1][1] * F.col("s2")).alias("x2"))


def mixing_condition(a: tuple[tuple[float, float], tuple[float, float]]) -> tuple[float, float]:
    """Determinant and condition number of the mixing matrix."""
    m = np.array(a)
    return float(np.linalg.det(m)), float(np.linalg.cond(m))


@dataclass
class Unmixing:
    """Means of the channels, what makes them white, the rotation found, and how the search ended: steps, the last change, and whether that was below the tolerance."""

    mean: np.ndarray
    white: np.ndarray
    w: np.ndarray
    steps: int
    change: float
    settled: bool

    def component(self, k: int) -> Column:
        row = self.w[k] @ self.white
        return float(row[0]) * (F.col("x1") - float(self.mean[0])) + float(row[1]) * (F.col("x2") - float(self.mean[1]))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(z1, z2) -> a row of bytes for each batch."""
    for b in batches:
        z = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        yield pa.RecordBatch.from_pydict({"z": pa.array([z.tobytes()], pa.binary())})


def contrast(w: np.ndarray) -> Callable[[Iterator[np.ndarray]], Iterator[np.ndarray]]:
    """What a step adds up over the samples z of a partition: products of tanh of w's rows and z, 1 - tanh^2, and the number of samples."""

    def sums(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        total = np.zeros(7)
        for z in blocks:
            t = np.tanh(w @ z)
            total += np.concatenate([(t @ z.T).ravel(), (1 - t * t).sum(axis=1), [z.shape[1]]])
        yield total

    return sums


def around(n: int, columns: int = 4096) -> Callable[[Iterator[np.ndarray]], Iterator[np.ndarray]]:
    """The sums of contrast in n even directions of half a turn, over the samples z of a partition: a row (t z1, t z2, 1 - t^2) for each direction, and the number of samples."""
    angles = np.pi * np.arange(n) / n
    w = np.stack([np.cos(angles), np.sin(angles)], axis=1)

    def sums(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        total, count = np.zeros((n, 3)), 0
        for z in blocks:
            for k in range(0, z.shape[1], columns):
                part = z[:, k : k + columns]
                t = np.tanh(w @ part)
                total += np.column_stack([t @ part.T, (1 - t * t).sum(axis=1)])
            count += z.shape[1]
        yield np.append(total.ravel(), count)

    return sums


def by_direction(sums: np.ndarray, tol: float = 1e-13) -> Callable[[np.ndarray], np.ndarray] | None:
    """The means of a step as a function of the rotation w, from the sums of around (half a turn on they are the same, or of the other sign): the trigonometric
    polynomial through them. None if its last quarter of terms is not down to tol, so that more directions are needed."""
    means = sums[:-1].reshape(-1, 3) / sums[-1]
    c = np.fft.rfft(np.concatenate([means, means * [-1, -1, 1]]), axis=0) / len(means)
    if np.abs(c[-len(c) // 4 :]).max() > tol * np.abs(c).max():
        return None
    c[0] /= 2
    terms = np.arange(len(c))

    def step(w: np.ndarray) -> np.ndarray:
        at = np.exp(1j * np.outer(np.arctan2(w[:, 1], w[:, 0]), terms))
        f = (at @ c).real
        return np.concatenate([f[:, :2].ravel(), f[:, 2]])

    return step


def unmixing(mix: DataFrame, max_iter: int = 1000, tol: float = 1e-4, passes: int = 32) -> Unmixing:
    """The independent components of x1 and x2: centred, whitened, then parallel fixed-point steps of log cosh until no row of the rotation changes
    its direction by tol, or max_iter steps are done.

    Axes of the whitening come in order of their variances and point to where x1 grows (or x2, if x1 stays), so that signs are no matter of the linear algebra at hand. Each step sums over the samples, in their two columns alone; the driver has a row of sums for each core, and 2 x 2 matrices.
    A step's means depend on the directions of two rows alone. When as many steps as passes have not settled, means of even directions are summed up, 64 in a pass, then twice as many, up to 1,024, until the polynomial through them is exact to
    1e-13; all further steps take them from it, without the samples. Where 1,024 do not do, each step goes over the samples to the end.
    """
    m = mix.agg(F.avg("x1"), F.avg("x2"), F.covar_pop("x1", "x1"), F.covar_pop("x1", "x2"), F.covar_pop("x2", "x2")).first()
    values, vectors = np.linalg.eigh(np.array([[m[2], m[3]], [m[3], m[4]]]))
    ahead = np.where(vectors[0] != 0, vectors[0], vectors[1])
    white = (vectors * np.where(ahead < 0, -1, 1) / np.sqrt(np.maximum(values, 1e-15))).T
    z = [float(white[k, 0]) * (F.col("x1") - m[0]) + float(white[k, 1]) * (F.col("x2") - m[1]) for k in (0, 1)]
    # as many partitions as cores: what a step sends to the driver is a row for each of them, however many samples there are
    d = mix.select(z[0].alias("z1"), z[1].alias("z2")).dropna().coalesce(mix.sparkSession.sparkContext.defaultParallelism)
    d = d.mapInArrow(packed, "z binary").rdd.map(lambda r: np.frombuffer(r["z"]).reshape(2, -1)).persist(StorageLevel.MEMORY_AND_DISK)

    def passed(w: np.ndarray) -> np.ndarray:
        s = np.sum(d.mapPartitions(contrast(w)).collect(), axis=0)
        return s[:6] / s[6]

    w, change, steps, means = np.array([[0.8, 0.6], [-0.6, 0.8]]), np.inf, 0, passed
    while steps < max_iter and change >= tol:
        if steps == passes:
            means = next((f for n in (64, 128, 256, 512, 1024) if (f := by_direction(np.sum(d.mapPartitions(around(n)).collect(), axis=0)))), passed)
        s = means(w)
        u, _, v = np.linalg.svd(np.array([[s[0], s[1]], [s[2], s[3]]]) - np.array([[s[4]], [s[5]]]) * w)
        change, w, steps = float(np.max(np.abs(np.abs(np.sum(u @ v * w, axis=1)) - 1))), u @ v, steps + 1
    d.unpersist()
    return Unmixing(np.array([m[0], m[1]]), white, w, steps, change, change < tol)


def fast_ica(mix: DataFrame, max_iter: int = 1000, tol: float = 1e-4) -> DataFrame:
    """Adds e1 and e2, the independent components of x1 and x2 that unmixing finds."""
    found = unmixing(mix, max_iter, tol)
    return mix.withColumns({f"e{k + 1}": found.component(k) for k in (0, 1)})


def source_correlation(separated: DataFrame) -> DataFrame:
    """Pearson correlation of each source with each estimate."""
    pairs = [(i, j) for i in (1, 2) for j in (1, 2)]
    one = separated.agg(F.array(*[F.struct(F.lit(i).alias("source"), F.lit(j).alias("estimate"), F.corr(f"s{i}", f"e{j}").alias("corr")) for i, j in pairs]).alias("c"))
    return one.select(F.inline("c"))


def resolve_ica(separated: DataFrame, peak: float = 0.85) -> DataFrame:
    """Estimates in the order and with the signs that fit the sources best (as they are, if both orders fit alike), at the peak."""
    c = {(r["source"], r["estimate"]): r["corr"] or 0.0 for r in source_correlation(separated).collect()}
    swap = abs(c[1, 2]) + abs(c[2, 1]) > abs(c[1, 1]) + abs(c[2, 2])
    order = (2, 1) if swap else (1, 2)
    tops = separated.agg(F.max(F.abs("e1")), F.max(F.abs("e2"))).first()
    scale = [(1 if c[k + 1, j] >= 0 else -1) * peak / max(tops[j - 1] or 1.0, 1e-15) for k, j in enumerate(order)]
    return separated.withColumns({f"e{k + 1}": float(scale[k]) * F.col(f"e{j}") for k, j in enumerate(order)})
