"""Viterbi and forward along time in parallel: one sequence of any length is the work of many tasks.

A block of frames is a matrix: what a path or all paths from each state before it to each state at its end add. Matrices of neighbouring blocks are
multiplied by (max, +) or by (log-sum, +), which may be done in any grouping, so products of blocks of blocks tell what comes into each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.operators.models import TINY, Hmm, stacks
from phonolake.sources.folders import checkpointed

#: Frames of a block, and elements that are combined in a row before the next level.
FRAMES, FAN = 4096, 256


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows in order of their keys -> batches that no group goes beyond, and where their groups begin."""
    held = None
    for d in batches:
        d = d if held is None else pd.concat([held, d], ignore_index=True)
        new = np.append(True, (d[keys].to_numpy()[1:] != d[keys].to_numpy()[:-1]).any(axis=1)) if len(d) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        cut = starts[-1] if len(starts) else 0
        held = d[cut:]
        if cut:
            yield d[:cut], starts[:-1]
    if held is not None and len(held):
        yield held.reset_index(drop=True), np.array([0])


def of_one_size(arrays: pd.Series, starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups whose arrays have one size: where they begin, how many rows they have, and the stack of all rows (of other groups: zeros)."""
    sizes, count = np.array([len(m) for m in arrays]), np.diff(np.append(starts, n))
    for size in np.unique(sizes):
        out, at = np.zeros((n, size)), sizes == size
        out[at] = np.stack(arrays[at].to_list())
        own = at[starts]
        yield starts[own], count[own], out


def scan(elements: DataFrame, starts: DataFrame, combine: Callable, apply: Callable, fan: int = FAN) -> DataFrame:
    """(rec_id, idx from 0 on, m) and (rec_id, e) -> (rec_id, idx, e): what e is before each element, if apply(e, m) is what it is after it.

    combine(a, b) is the element that does what a and then b do; both take stacks, a row for each of many groups. Elements are combined by so many, and these again, until a recording has one; then what comes into
    each is handed down. No group has more than so many elements of a recording, and the groups of a batch are worked on together.
    """
    kind = dict(elements.dtypes)["rec_id"]
    up, keys = F.floor(F.col("idx") / fan).cast("long").alias("up"), ["rec_id", "up"]
    in_groups = lambda d: d.repartition(*keys).sortWithinPartitions(*keys, "idx")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, starts in whole_groups(batches, keys):
            found = [None] * len(d)
            for at, count, m in of_one_size(d["m"], starts, len(d)):
                out = m[at]
                for k in range(1, count.max()):
                    more = count > k
                    out[more] = combine(out[more], m[at[more] + k])
                for k, v in zip(at.tolist(), out, strict=True):
                    found[k] = v
            yield pd.DataFrame({"rec_id": d["rec_id"].to_numpy()[starts], "idx": d["up"].to_numpy()[starts], "m": [found[k] for k in starts]})

    levels = [checkpointed(elements.select("rec_id", "idx", "m"))]
    top = levels[0].agg(F.max("idx")).first()[0] or 0
    while top > 0:
        d = in_groups(levels[-1].select("rec_id", "idx", "m", up)).mapInPandas(merge, f"rec_id {kind}, idx long, m array<double>")
        levels.append(checkpointed(d))
        top //= fan

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, starts in whole_groups(batches, keys):
            count, found = np.diff(np.append(starts, len(d))), [None] * len(d)
            for at, _, m in of_one_size(d["m"], starts, len(d)):
                own = np.isin(starts, at)
                e, n, k = np.stack(d["e"].iloc[at].to_list()), count[own], 0
                while len(at):
                    for j, v in zip((at + k).tolist(), e, strict=True):
                        found[j] = v
                    more = n > k + 1
                    at, n = at[more], n[more]
                    e = apply(e[more], m[at + k]) if len(at) else e
                    k += 1
            yield d[["rec_id", "idx"]].assign(e=found)

    e = starts.select("rec_id", F.lit(0).cast("long").alias("idx"), "e")
    for level in levels[-2::-1]:
        d = level.select("rec_id", "idx", "m", up).join(e.select("rec_id", F.col("idx").alias("up"), "e"), keys)
        e = checkpointed(in_groups(d).mapInPandas(hand_down, f"rec_id {kind}, idx long, e array<double>"))
    return e


def products(semiring: str) -> tuple[Callable, Callable, Callable]:
    """Of (max, +) or (log-sum, +): the sum over an axis, and for stacks the products of two flat matrices, and of a vector and a flat matrix."""
    add = np.max if semiring == "max" else np.logaddexp.reduce
    square = lambda m: m.reshape(len(m), int(m.shape[1] ** 0.5), -1)
    return add, lambda a, b: add(square(a)[..., None] + square(b)[:, None], axis=2).reshape(a.shape), lambda e, m: add(e[..., None] + square(m), axis=1)


def frame_blocks(frames: DataFrame, size: int) -> DataFrame:
    """(rec_id, label, frame_idx, vec) -> (rec_id, label, idx, seq): so many frames in order, of a recording's idx-th block, one after the other in one array."""
    d = frames.withColumn("idx", F.floor(F.col("frame_idx") / size).cast("long"))
    return d.groupBy("rec_id", "label", "idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))), lambda s: s["vec"])).alias("seq"))


def block_stacks(d: pd.DataFrame, models: dict[str, Hmm]) -> Iterator[tuple[Hmm, np.ndarray, np.ndarray, bool]]:
    """The blocks of a batch that have one label and length, first blocks apart: their model, places, frames, and whether they are first."""
    for (label, first), g in d.assign(first=d["idx"] == 0).reset_index(drop=True).groupby(["label", "first"]):
        dims = models[label].mean.shape[1]
        for at, x in stacks([np.asarray(s, dtype=float).reshape(-1, dims) for s in g["seq"]]):
            yield models[label], g.index.to_numpy()[at], x, bool(first)


def block_matrices(model: Hmm, x: np.ndarray, first: bool, add: Callable) -> np.ndarray:
    """What each block's frames add from each state before them to each state at their end, as flat matrices; first blocks have the start in all their rows."""
    b, a = model.log_emission(x), np.log(model.a + TINY)
    m = (np.tile(np.log(model.pi + TINY), (len(a), 1)) if first else a) + b[:, 0][:, None]
    for t in range(1, b.shape[1]):
        m = add(m[..., None] + a, axis=2) + b[:, t][:, None]
    return m.reshape(len(x), -1)


def entries(blocks: DataFrame, models: dict[str, Hmm], semiring: str, fan: int) -> DataFrame:
    """(rec_id, idx, e): the best score, or the log sum of all, of each state before each block. Before the first one, one state counts for all."""
    add, combine, apply = products(semiring)
    kind = dict(blocks.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for model, at, x, first in block_stacks(d, models):
                yield d[["rec_id", "idx"]].iloc[at].assign(m=list(block_matrices(model, x, first, add)))

    n = {label: len(m.pi) for label, m in models.items()}
    sizes = F.create_map(*[F.lit(x) for pair in n.items() for x in pair])
    starts = blocks.filter("idx = 0").select("rec_id", F.transform(F.sequence(F.lit(1), sizes[F.col("label")]), lambda k: F.when(k == 1, 0.0).otherwise(-1e300)).alias("e"))
    return scan(blocks.select("rec_id", "label", "idx", "seq").mapInPandas(rows, f"rec_id {kind}, idx long, m array<double>"), starts, combine, apply, fan)


def last_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("rec_id").agg(F.max("idx").alias("last"))


def _blocks(frames: DataFrame, models: dict[str, Hmm], size: int) -> DataFrame:
    return checkpointed(frame_blocks(frames.filter(F.col("label").isin(sorted(models))), size))


def forward_long(frames: DataFrame, models: dict[str, Hmm], size: int = FRAMES, fan: int = FAN) -> DataFrame:
    """(rec_id, label, frame_idx from 0 on, vec) -> (rec_id, label, score): the log likelihood of each recording, however long, under its label's model."""
    blocks = _blocks(frames, models, size)
    kind = dict(blocks.dtypes)["rec_id"]
    d = blocks.join(last_blocks(blocks), "rec_id").filter("idx = last").join(entries(blocks, models, "sum", fan), ["rec_id", "idx"])
    add, _, apply = products("sum")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for model, at, x, first in block_stacks(p, models):
                ends = apply(np.stack(p["e"].iloc[at].to_list()), block_matrices(model, x, first, add))
                yield p[["rec_id", "label"]].iloc[at].assign(score=np.logaddexp.reduce(ends, axis=1))

    return d.select("rec_id", "label", "idx", "seq", "e").mapInPandas(rows, f"rec_id {kind}, label string, score double")


def trace(model: Hmm, x: np.ndarray, e: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a stack of blocks the scores of the states at their ends, and for each frame which state before it is best for each state (of the first frame: in the block before)."""
    b, a = model.log_emission(x), np.log(model.a + TINY)
    d, back = np.log(model.pi + TINY) + b[:, 0] if first else e, np.zeros(b.shape, dtype=np.int16)
    for t in range(int(first), b.shape[1]):
        s = d[..., None] + a
        back[:, t] = s.argmax(axis=1)
        d = s.max(axis=1) + b[:, t]
    return d, back


def viterbi_long(frames: DataFrame, models: dict[str, Hmm], size: int = FRAMES, fan: int = FAN) -> DataFrame:
    """(rec_id, label, frame_idx from 0 on, vec) -> (rec_id, label, at, path, score): the best path of each recording, however long, in blocks from frame at on.

    Blocks learn the scores before them, then which state before them each state at their end comes from: these steps are handed from the end to the
    front as the scores were from front to end. score is the whole path's, in every block. Of equal paths that of the first state is taken.
    """
    blocks = _blocks(frames, models, size)
    kind = dict(blocks.dtypes)["rec_id"]
    d = checkpointed(blocks.join(entries(blocks, models, "max", fan), ["rec_id", "idx"]).join(last_blocks(blocks), "rec_id"))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for model, at, x, first in block_stacks(p, models):
                own = p.iloc[at]
                end, back = trace(model, x, np.stack(own["e"].to_list()), first)
                came = np.tile(np.arange(end.shape[1]), (len(at), 1))
                for k in range(x.shape[1] - 1, -1, -1):
                    came = np.take_along_axis(back[:, k], came, axis=1)
                last = (own["idx"] == own["last"]).to_numpy()
                yield own[["rec_id"]].assign(idx=own["last"] - own["idx"], m=list(came.astype(float)), exit=np.where(last, end.argmax(axis=1), np.nan), score=np.where(last, end.max(axis=1), np.nan))

    m = checkpointed(d.select("rec_id", "label", "idx", "last", "seq", "e").mapInPandas(maps, f"rec_id {kind}, idx long, m array<double>, exit double, score double"))
    step = lambda e, f: np.take_along_axis(f, e.astype(int), axis=1)
    ends = m.filter("idx = 0")
    exits = scan(m, ends.select("rec_id", F.array("exit").alias("e")), step, step, fan).select("rec_id", F.col("idx").alias("back"), F.get("e", F.lit(0)).cast("int").alias("exit"))
    d = d.withColumn("back", F.col("last") - F.col("idx")).join(exits, ["rec_id", "back"]).join(ends.select("rec_id", "score"), "rec_id")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for model, at, x, first in block_stacks(p, models):
                own = p.iloc[at]
                _, back = trace(model, x, np.stack(own["e"].to_list()), first)
                path = np.empty(x.shape[:2], dtype=np.int32)
                path[:, -1] = own["exit"]
                for k in range(x.shape[1] - 1, 0, -1):
                    path[:, k - 1] = np.take_along_axis(back[:, k], path[:, k : k + 1], axis=1)[:, 0]
                yield own[["rec_id", "label"]].assign(at=own["idx"] * size, path=list(path), score=own["score"])

    return d.select("rec_id", "label", "idx", "seq", "e", "exit", "score").mapInPandas(paths, f"rec_id {kind}, label string, at long, path array<int>, score double")
