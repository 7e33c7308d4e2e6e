"""Template matching, Gaussians and hidden Markov models over sequences (rec_id, label, seq: frames of numbers)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.functions import dsp
from phonolake.functions.columns import first_rows
from phonolake.sources.folders import checkpointed

TINY = 1e-300


def to_sequences(features: DataFrame) -> DataFrame:
    """(rec_id, frame_idx, vec) -> (rec_id, seq), in order of the frames."""
    return features.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))), lambda s: s["vec"]).alias("seq"))


def stacked(seq) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in seq])


def dtw_pairs(pairs: DataFrame, with_path: bool = False) -> DataFrame:
    """(…, seq, template) -> those columns but the sequences, with cost, path_length, score = cost / path_length and, if asked for, path:
    the pairs of frames, from the first to the last. Pairs of like lengths are worked on together."""
    keep = [c for c in pairs.columns if c not in ("seq", "template")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            x, y = [stacked(v) for v in d["seq"]], [stacked(v) for v in d["template"]]
            alike: dict[tuple[int, int], list[int]] = {}
            for k, (a, b) in enumerate(zip(x, y, strict=True)):
                alike.setdefault((len(a), len(b)), []).append(k)
            cost, steps, paths = np.empty(len(d)), np.empty(len(d), dtype=np.int64), [None] * len(d)
            for at in alike.values():
                cost[at], steps[at], came = dsp.dtw_stack(np.stack([x[k] for k in at]), np.stack([y[k] for k in at]))
                for k, c in zip(at, came, strict=True) if with_path else ():
                    paths[k] = [{"i": i, "j": j} for i, j in dsp.dtw_path(c)]
            out = d[keep].assign(cost=cost, path_length=steps, score=cost / steps)
            yield out.assign(path=paths) if with_path else out

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cost double, path_length long, score double"
    return pairs.mapInPandas(rows, schema + (", path array<struct<i:int,j:int>>" if with_path else ""))


def build_templates(sequences: DataFrame, per_label: int | None = None) -> DataFrame:
    """(label, tmpl_id, template): all sequences, or each label's first per_label, which are found by their ids alone."""
    if per_label is not None:
        first = first_rows(sequences.select("label", "rec_id"), "label", "rec_id", per_label)
        sequences = sequences.join(first, ["label", "rec_id"], "left_semi")
    return sequences.select("label", F.col("rec_id").alias("tmpl_id"), F.col("seq").alias("template"))


def ranked(scores: DataFrame, best: Column, top: int = 2) -> DataFrame:
    """(rec_id, truth, label, score) -> the top labels of each recording as columns, ties by label."""
    k = F.row_number().over(W.partitionBy("rec_id").orderBy(best, "label"))
    d = scores.withColumn("k", k).filter(F.col("k") <= top)
    picks = [x for i in range(1, top + 1) for x in (F.max(F.when(F.col("k") == i, F.col("label"))).alias(f"top{i}_label"), F.max(F.when(F.col("k") == i, F.col("score"))).alias(f"top{i}_score"))]
    return d.groupBy("rec_id", "truth").agg(*picks)


def least_by_label(tests: list[np.ndarray], templates: list[np.ndarray], labels: np.ndarray, top: int, columns: int = 192, found: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """For each label the least score of each test, where it can be among the top labels' (infinite elsewhere), and for each test how many cells were filled.

    A test's limit, the score of its top-th best label so far, begins with what was found among other templates, or else with the templates that are nearest by evenly spaced frames, one of a label. All other pairs go through
    dtw_within, so many templates of like lengths at once; only what it lets pass is scored, and lowers the limit.
    """
    found = found or {}
    names = np.array(sorted({*labels, *found}), dtype=object)
    which = np.searchsorted(names, labels)
    best, cells, top = np.full((len(tests), len(names)), np.inf), np.zeros(len(tests), dtype=np.int64), min(top, len(names))
    for name, scores in found.items():
        best[:, np.searchsorted(names, name)] = scores

    def limits(at: np.ndarray | slice) -> np.ndarray:
        return np.partition(best[at], top - 1, axis=1)[:, top - 1]

    def score(i: np.ndarray, j: np.ndarray) -> None:
        scores, filled = dsp.dtw_limited([tests[k] for k in i], [templates[k] for k in j], limits(i))
        np.fmin.at(best, (i, which[j]), scores)
        np.add.at(cells, i, filled)

    done = np.zeros(0, dtype=np.int64)
    if not np.isfinite(limits(slice(None))).all():
        i, j = dsp.nearest_of_groups(dsp.coarse(tests), dsp.coarse(templates), which, max(4 * top, 8))
        done = np.unique(i * len(templates) + j)
        score(i, j)
    for y in dsp.alike(templates):
        for x in dsp.alike(tests):
            xs, ys = np.stack([tests[k] for k in x]), np.stack([templates[k] for k in y])
            for c in range(0, len(y), columns):
                i, j = dsp.dtw_within(xs, ys[c : c + columns], limits(x))
                i, j = x[i], y[c + j]
                new = ~np.isin(i * len(templates) + j, done)
                if new.any():
                    score(i[new], j[new])
    return {n: best[:, k] for k, n in enumerate(names)}, cells


#: Bytes of templates that meet tests in one task.
PART_BYTES = 1 << 28


def in_blocks(rows: DataFrame, seq: str, size: int) -> DataFrame:
    """(…, seq) -> rows for so many sequences at most: the other columns as arrays, the sequences' lengths and their numbers as bytes. A task packs its own rows: there is no shuffle."""
    kinds = {c: t for c, t in rows.dtypes if c != seq}

    def packed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block(d: pd.DataFrame) -> pd.DataFrame:
            x = [stacked(v) for v in d[seq]]
            return pd.DataFrame({**{c: [d[c].tolist()] for c in kinds}, "lens": [[len(v) for v in x]], seq: [np.concatenate([v.ravel() for v in x]).tobytes()]})

        for d in batches:
            held.append(d)
            while sum(map(len, held)) >= size:
                d = pd.concat(held, ignore_index=True)
                yield block(d.iloc[:size])
                held = [d.iloc[size:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    d = rows.select(*kinds, seq).mapInPandas(packed_rows, ", ".join(f"{c} array<{t}>" for c, t in kinds.items()) + f", lens array<int>, {seq} binary")
    return d.select(F.monotonically_increasing_id().alias("piece"), "*")


def from_block(lens: np.ndarray, numbers: bytes) -> list[np.ndarray]:
    """The sequences of a row of in_blocks."""
    ends, x = np.cumsum(lens), np.frombuffer(numbers)
    return np.split(x.reshape(ends[-1], -1) if ends[-1] else x.reshape(0, 0), ends[:-1])


def dtw_recognize(test: DataFrame, templates: DataFrame, top: int = 2, block: int = 4096, share: bool = False) -> DataFrame:
    """(rec_id, truth, seq) against all templates: the least score of each label, ranked; with share also the share of cells that were filled.

    Sequences are packed in blocks of so many at most, and every block of tests meets every part of the templates, of about PART_BYTES, in a task of their own, which reads both where they are stored: no
    sequence is sent once for each block or pair it meets. A task takes block after block of its part, with the limits that the former ones left, and gives the least scores of its tests' top labels. Where that makes
    fewer tasks than four for each core, blocks of tests are smaller. Pairs whose score cannot be among the top labels' are left out, or ended early, by bounds from below: scores are as if all were worked out.
    """
    kinds = dict(test.dtypes) | dict(templates.dtypes)
    y = checkpointed(in_blocks(templates.select("label", "template"), "template", block))
    parts = max(1, -(-(y.agg(F.sum(F.octet_length("template"))).first()[0] or 0) // PART_BYTES))
    tests, cores = test.count(), test.sparkSession.sparkContext.defaultParallelism
    x = checkpointed(in_blocks(test.select("rec_id", "truth", "seq"), "seq", min(block, max(64, -(-tests * parts // (4 * cores))))))
    # parts and blocks of tests by ranges of their numbers, so that none has two shares
    y = y.repartitionByRange(parts, "piece").select(F.spark_partition_id().alias("part"), "label", F.col("lens").alias("template_lens"), "template")
    x = x.repartitionByRange(max(1, x.count()), "piece").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, tests, found = None, [], {}

        def rows() -> pd.DataFrame:
            least = np.stack(list(found.values()), axis=1)
            # others are behind so many labels already
            at, which = np.nonzero(least <= np.partition(least, min(top, len(found)) - 1, axis=1)[:, [min(top, len(found)) - 1]])
            first = np.diff(at, prepend=-1) > 0  # cells count once for each recording
            return pd.DataFrame({"rec_id": ids[at], "truth": truths[at], "label": np.array(list(found), dtype=object)[which], "score": least[at, which], "filled": np.where(first, filled[at], 0), "cells": np.where(first, cells[at], 0)})

        for d in batches:
            for r in d.itertuples(index=False):
                if r.piece != piece:
                    if found:
                        yield rows()
                    piece, tests, found, filled, cells = r.piece, from_block(r.lens, r.seq), {}, 0, 0
                    ids, truths = np.array(r.rec_id), np.array(r.truth, dtype=object)
                own = from_block(r.template_lens, r.template)
                found, more = least_by_label(tests, own, np.array(r.label, dtype=object), top, found=found)
                filled, cells = filled + more, cells + r.lens * np.sum(r.template_lens)
        if found:
            yield rows()

    d = x.join(y.hint("shuffle_replicate_nl"), "part").drop("part")
    d = d.mapInPandas(scores, f"rec_id {kinds['rec_id']}, truth {kinds['truth']}, label {kinds['label']}, score double, filled long, cells long")
    d = checkpointed(d) if share else d
    out = ranked(d.groupBy("rec_id", "truth", "label").agg(F.min("score").alias("score")), F.col("score").asc(), top)
    return out.join(d.groupBy("rec_id").agg((F.sum("filled") / F.sum("cells")).alias("share")), "rec_id") if share else out


def gaussian_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Densities of the rows of x under a full covariance, which must be positive definite and fit."""
    mean, cov = np.atleast_1d(mean), np.atleast_2d(cov)
    if x.shape[1] != len(mean) or cov.shape != (len(mean), len(mean)):
        raise ValueError("shapes differ")
    det = np.linalg.det(cov)
    if det <= 0:
        raise ValueError("no positive definite covariance")
    d = x - mean
    return np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)) / np.sqrt((2 * np.pi) ** len(mean) * det)


def gmm_likelihood(vectors: DataFrame, weights: list[float], means: list[list[float]], covs: list[list[list[float]]]) -> DataFrame:
    """(rec_id, vec) -> (rec_id, component, pdf, weighted, likelihood), the likelihood being the sum over components."""
    kind = dict(vectors.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            x = stacked(d["vec"]) if len(d) else np.zeros((0, len(means[0])))
            p = [gaussian_density(x, np.array(m), np.array(c)) for m, c in zip(means, covs, strict=True)]
            total = sum(w * q for w, q in zip(weights, p, strict=True))
            for k, (w, q) in enumerate(zip(weights, p, strict=True)):
                yield pd.DataFrame({"rec_id": d["rec_id"], "component": k, "pdf": q, "weighted": w * q, "likelihood": total})

    return vectors.select("rec_id", "vec").mapInPandas(rows, f"rec_id {kind}, component int, pdf double, weighted double, likelihood double")


def bayes_score(scores: DataFrame, lm_scale: float = 1.0, word_penalty: float = 0.0) -> DataFrame:
    """(rec_id, label, log_acoustic, log_language) -> each recording's best label: acoustic + scale * language + penalty."""
    d = scores.withColumn("score", F.col("log_acoustic") + lm_scale * F.col("log_language") + word_penalty)
    k = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("score"), "label"))
    return d.withColumn("k", k).filter("k = 1").select("rec_id", "label", "score")


def mllr_adapt(vec: Column, a: list[list[float]], b: list[float]) -> Column:
    """A mean moved to A mean + b."""
    return F.array(*[sum((F.get(vec, F.lit(j)) * float(x) for j, x in enumerate(row)), F.lit(float(c))) for row, c in zip(a, b, strict=True)])


def map_adapt(observations: DataFrame, priors: DataFrame, tau: float = 10.0) -> DataFrame:
    """(state, dim, z, x) and (state, dim, prior) -> (tau prior + sum z x) / (tau + sum z)."""
    d = observations.groupBy("state", "dim").agg(F.sum(F.col("z") * F.col("x")).alias("zx"), F.sum("z").alias("zs"))
    d = priors.join(d, ["state", "dim"], "left").fillna(0.0, ["zx", "zs"])
    return d.select("state", "dim", ((tau * F.col("prior") + F.col("zx")) / (tau + F.col("zs"))).alias("mean"))


def split_gain(rows: DataFrame) -> DataFrame:
    """(node, side 0 or 1, a, b) -> gain of splitting each node's rows of two numbers by side: 1/2 N (D (1 + ln 2 pi) + ln det) of all
    less those of both sides. Null where a side has no spread."""
    forms = lambda c: [F.count(F.when(c, 1)).alias("n"), F.covar_pop(F.when(c, F.col("a")), F.when(c, F.col("a"))).alias("aa"), F.covar_pop(F.when(c, F.col("a")), F.when(c, F.col("b"))).alias("ab"), F.covar_pop(F.when(c, F.col("b")), F.when(c, F.col("b"))).alias("bb")]
    parts = [F.struct(*forms(c)).alias(name) for name, c in (("p", F.lit(True)), ("l", F.col("side") == 0), ("r", F.col("side") == 1))]
    d = rows.groupBy("node").agg(*parts)

    def value(x: str) -> Column:
        det = F.col(x)["aa"] * F.col(x)["bb"] - F.col(x)["ab"] * F.col(x)["ab"]
        return F.when(det > 0, 0.5 * F.col(x)["n"] * (2 * (1 + float(np.log(2 * np.pi))) + F.log(det)))

    return d.select("node", F.col("p")["n"].alias("n"), (value("p") - value("l") - value("r")).alias("gain"))


@dataclass
class Hmm:
    """A model with diagonal Gaussians: start, transitions, means and variances."""

    pi: np.ndarray
    a: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        """For frames x, or stacks of sequences, the log density of each state."""
        d = x[..., None, :] - self.mean
        return -0.5 * (x.shape[-1] * np.log(2 * np.pi) + (d * d / self.var + np.log(self.var)).sum(axis=-1))

    def forward(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods and log forward variables, for log emissions b of a sequence or of a stack of sequences of one length."""
        a = np.log(self.a + TINY)
        out = np.empty_like(b)
        out[..., 0, :] = np.log(self.pi + TINY) + b[..., 0, :]
        for t in range(1, b.shape[-2]):
            out[..., t, :] = np.logaddexp.reduce(out[..., t - 1, :, None] + a, axis=-2) + b[..., t, :]
        return np.logaddexp.reduce(out[..., -1, :], axis=-1), out

    def backward(self, b: np.ndarray) -> np.ndarray:
        a = np.log(self.a + TINY)
        out = np.zeros_like(b)
        for t in range(b.shape[-2] - 2, -1, -1):
            out[..., t, :] = np.logaddexp.reduce(a + (b[..., t + 1, :] + out[..., t + 1, :])[..., None, :], axis=-1)
        return out

    def viterbi(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score and path of each sequence of a stack, or of one sequence."""
        if x.ndim == 2:
            score, path = self.viterbi(x[None])
            return score[0], path[0].tolist()
        b, a = self.log_emission(x), np.log(self.a + TINY)
        d, back = np.log(self.pi + TINY) + b[:, 0], []
        for t in range(1, b.shape[1]):
            s = d[:, :, None] + a
            back.append(s.argmax(axis=1))
            d = s.max(axis=1) + b[:, t]
        path = [d.argmax(axis=1)]
        for k in reversed(back):
            path.append(np.take_along_axis(k, path[-1][:, None], axis=1)[:, 0])
        return d.max(axis=1), np.stack(path[::-1], axis=1)

    def sums(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What a stack of sequences of one length adds to the sums of a step; variances are about the means so far."""
        b = self.log_emission(x)
        ll, f = self.forward(b)
        r = self.backward(b)
        g = np.exp(f + r - ll[:, None, None])
        g /= np.maximum(g.sum(axis=-1, keepdims=True), TINY)
        xi = np.exp(f[:, :-1, :, None] + np.log(self.a + TINY) + (b[:, 1:] + r[:, 1:])[:, :, None, :] - ll[:, None, None, None])
        d = x[..., None, :] - self.mean
        return {"ll": np.array([[ll.sum()]]), "pi": g[:, 0].sum(axis=0)[None], "a": xi.sum(axis=(0, 1)), "den": g[:, :-1].sum(axis=(0, 1))[None], "g": g.sum(axis=(0, 1))[None], "mean": np.einsum("nts,ntd->sd", g, x), "var": np.einsum("nts,ntsd->sd", g, d * d)}

    def updated(self, s: dict[str, np.ndarray], floor: float, prior: float = 0.0) -> Hmm:
        a = s["a"] / (s["den"].T + TINY) * (self.a > 0)
        g = s["g"].T + TINY
        return Hmm(s["pi"][0] / (s["pi"].sum() + TINY), a / (a.sum(axis=1, keepdims=True) + TINY), s["mean"] / g, np.maximum((s["var"] + prior) / g, floor))


#: How models of isolated words are trained, where loops leave sooner and variances may be small.
WORD_SETTINGS = {"loop": 0.6, "floor": 1e-6, "tol": 1e-4}

#: Frames of a stack at most, and numbers of a label's sequences that are trained in one task, at most (an eighth of these in any case).
STACK_FRAMES, TASK_NUMBERS = 1 << 16, 1 << 23


def stacks(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Sequences of one length together: their places and the stack, of about STACK_FRAMES frames at most. Empty ones are left out."""
    alike: dict[int, list[int]] = {}
    for k, x in enumerate(sequences):
        if len(x):
            alike.setdefault(len(x), []).append(k)
    for n, at in alike.items():
        step = max(1, STACK_FRAMES // n)
        for k in range(0, len(at), step):
            yield at[k : k + step], np.stack([sequences[j] for j in at[k : k + step]])


def added(model: Hmm, parts: list[np.ndarray], total: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The sums of a step over stacks."""
    for x in parts:
        s = model.sums(x)
        total = s if total is None else {name: total[name] + v for name, v in s.items()}
    return total


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, seq) -> a row for each stack: its label, shape and bytes."""
    for d in batches:
        for label, g in d.groupby("label"):
            for _, x in stacks([stacked(v) for v in g["seq"]]):
                yield pd.DataFrame({"label": [label], "shape": [list(x.shape)], "x": [x.tobytes()]})


def step_sums(now: dict[str, Hmm]):
    """What a step adds up for each label of now over the stacks of a partition."""

    def sums(stacks_: Iterator[tuple[str, np.ndarray]]) -> Iterator[dict[str, dict[str, np.ndarray]]]:
        total: dict[str, dict[str, np.ndarray]] = {}
        for label, x in stacks_:
            if label in now:
                total[label] = added(now[label], [x], total.get(label))
        yield total

    return sums


def settled(it: int, ll: float, last: float | None, tol: float) -> bool:
    """Whether training ends with a step: from the fourth on, when the log likelihood changes by less than tol."""
    return it > 2 and abs(ll - last) < tol


def left_right(n: int, loop: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    a = np.diag([loop] * (n - 1) + [1.0]) + np.diag([1 - loop] * (n - 1), 1)
    return np.eye(n)[0], a


def first_models(sequences: DataFrame, n_states: int, loop: float, floor: float, full: bool) -> dict[str, Hmm]:
    """Means from evenly spaced frames of each label, its sequences one after the other by rec_id; variances all alike.

    The places are found among the sequences' lengths; one row for each label and state comes to the driver.
    """
    d = sequences.withColumn("n", F.size("seq")).filter("n > 0")
    w = W.partitionBy("label").orderBy("rec_id")
    # windows see lengths alone; sequences are joined for the few that hold a place
    lengths = d.select("label", "rec_id", "n").withColumn("to", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("label")))
    at = F.floor((F.col("total") - 1) * F.col("state") / max(n_states - 1, 1))
    places = lengths.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1)))).withColumn("at", at - (F.col("to") - F.col("n"))).filter("at >= 0 AND at < n")
    d2 = d.select("label", "rec_id", "seq").join(places.select("label", "rec_id", "state", "at"), ["label", "rec_id"]).select("label", "state", F.get("seq", F.col("at").cast("int")).alias("mean"))
    v = d.select("label", F.explode("seq").alias("x")).select("label", F.posexplode("x").alias("dim", "x")).groupBy("label", "dim").agg(F.var_pop("x").alias("v")).groupBy("label").agg(F.avg("v").alias("v"))
    out: dict[str, dict[int, np.ndarray]] = {}
    variance = {}
    for r in d2.join(v, "label").collect():
        out.setdefault(r["label"], {})[r["state"]] = np.array(r["mean"], dtype=float)
        variance[r["label"]] = r["v"] + floor
    pi, a = left_right(n_states, loop)
    if full:
        pi, a = np.full(n_states, 1 / n_states), np.full((n_states, n_states), (1 - loop) / max(n_states - 1, 1)) + np.eye(n_states) * (loop - (1 - loop) / max(n_states - 1, 1))
    return {label: Hmm(pi, a, m := np.stack([means[k] for k in range(n_states)]), np.full_like(m, variance[label])) for label, means in out.items()}


def hmm_train(
    sequences: DataFrame, n_states: int = 5, n_iter: int = 80, tol: float = 1e-3, loop: float = 0.7, floor: float = 1e-4, full: bool = False, start: dict[str, Hmm] | None = None, prior: float = 0.0
) -> tuple[dict[str, Hmm], list[tuple[str, int, float, bool]]]:
    """Baum-Welch for all labels of (rec_id, label, seq) at once: the models, and each iteration's log likelihood and whether it was the last.

    Labels with up to TASK_NUMBERS numbers are trained in a task each, all their steps in one job, unless one has more than an eighth of that and more than two
    cores' share of all. Of the others tasks sum up, step by step, what their sequences add, which are stacked once for all steps; the driver has a few numbers of
    each core for each label, and the models. A label is
    done when its log likelihood changes by less than tol, from the fourth iteration on. It begins with start, or else as first_models has it.
    """
    sequences = checkpointed(sequences.select("rec_id", "label", "seq").filter(F.size("seq") > 0))
    models = dict(start) if start else first_models(sequences, n_states, loop, floor, full)
    sizes = sequences.groupBy("label").agg(F.sum(F.size("seq") * F.size(F.get("seq", F.lit(0)))).alias("n"))
    numbers, cores = {r["label"]: r["n"] for r in sizes.collect()}, sequences.sparkSession.sparkContext.defaultParallelism
    most = min(TASK_NUMBERS, max(TASK_NUMBERS // 8, 2 * sum(numbers.values()) // cores))
    small = {label for label, n in numbers.items() if n <= most and label in models}
    log, last, open_ = [], {}, set(models) - small

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["label"].iloc[0]
        m, parts, lls, done = models[label], [x for _, x in stacks([stacked(v) for v in rows.sort_values("rec_id")["seq"]])], [], False
        while len(lls) < n_iter and not done:
            s = added(m, parts)
            m, ll = m.updated(s, floor, prior), float(s["ll"][0, 0])
            done = settled(len(lls), ll, lls[-1] if lls else None, tol)
            lls.append(ll)
        return pd.DataFrame([(label, m.pi.tolist(), m.a.tolist(), m.mean.tolist(), m.var.tolist(), lls, done)], columns=["label", "pi", "a", "mean", "var", "lls", "done"])

    if small:
        d = sequences.filter(F.col("label").isin(sorted(small))).groupBy("label").applyInPandas(whole, "label string, pi array<double>, a array<array<double>>, mean array<array<double>>, var array<array<double>>, lls array<double>, done boolean")
        for r in d.collect():
            models[r["label"]] = Hmm(np.array(r["pi"]), np.array(r["a"]), np.array(r["mean"]), np.array(r["var"]))
            log += [(r["label"], k, ll, r["done"] and k == len(r["lls"]) - 1) for k, ll in enumerate(r["lls"])]
    if not open_:
        return models, log
    # as many partitions as cores: a step is a job without a shuffle
    d = sequences.filter(F.col("label").isin(sorted(open_))).select("label", "seq").coalesce(cores).mapInPandas(packed, "label string, shape array<int>, x binary")
    d = d.rdd.map(lambda r: (r["label"], np.frombuffer(r["x"]).reshape(r["shape"]))).persist(StorageLevel.MEMORY_AND_DISK)
    for it in range(n_iter):
        sums: dict[str, dict[str, np.ndarray]] = {}
        for part in d.mapPartitions(step_sums({k: models[k] for k in open_})).collect():
            for label, own in part.items():
                sums[label] = {name: sums[label][name] + v for name, v in own.items()} if label in sums else own
        for label, own in sums.items():
            models[label], ll = models[label].updated(own, floor, prior), float(own["ll"][0, 0])
            done = settled(it, ll, last.get(label), tol)
            log.append((label, it, ll, done))
            last[label] = ll
            if done:
                open_.discard(label)
        if not open_:
            break
    d.unpersist()
    return models, log


def packed_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec) -> a row of bytes for each batch, dimension by dimension."""
    for b in batches:
        if x := b.column("vec").drop_null():
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            yield pa.RecordBatch.from_pydict({"x": pa.array([x.T.tobytes()], pa.binary())})


def nearest_sums(centres: list[list[float]]):
    """What a step adds up over the vectors of a partition: for each centre, of those next to it (the first, if more are), the sum of each dimension and the number."""

    def sums(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        total = np.zeros((len(centres), len(centres[0]) + 1))
        for x in blocks:
            d = np.stack([sum((v - c) * (v - c) for v, c in zip(x, centre, strict=True)) for centre in centres])
            near = np.where(np.isnan(d), np.inf, d).argmin(axis=0)
            for k in range(len(centres)):
                own = x[:, near == k]
                total[k] += [*own.sum(axis=1), own.shape[1]]
        yield total

    return sums


def k_means(vectors: DataFrame, k: int, n_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> np.ndarray:
    """(vec) -> k centres, in order of their numbers, by seeding in proportion to squared distances and Lloyd's steps until no centre moves by tol of the
    vectors' mean variance.

    Each seed and each step is one pass, steps without a shuffle over vectors that are packed once: of the vectors the one with the greatest u^(1/d^2) is the next seed, u being a hash of the vector between 0 and 1 and
    d^2 its squared distance to the seeds so far; steps are sums and counts by the nearest centre, a row of them for each core. Equal vectors are likely the same seed. Fewer
    vectors than k that differ: fewer centres.
    """
    size = len(vectors.select("vec").first()["vec"])
    each = [F.get("vec", F.lit(j)) for j in range(size)]
    far = lambda c: sum(((x - float(v)) * (x - float(v)) for x, v in zip(each, c, strict=True)), F.lit(0.0))
    u = (F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    centres: list[list[float]] = []
    while len(centres) < k:
        d2 = F.lit(1.0) if not centres else F.array_min(F.array(*[far(c) for c in centres]))
        best = vectors.select(F.when(d2 > 0, F.log(u) / d2).alias("key"), "vec").dropna().agg(F.max(F.struct("key", "vec")).alias("b")).first()["b"]
        if best is None:
            break
        centres.append(list(best["vec"]))
    spread = vectors.agg(sum((F.var_pop(x) for x in each), F.lit(0.0)).alias("v")).first()["v"] / size
    x = vectors.select("vec").coalesce(vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(packed_vectors, "x binary")
    x = x.rdd.map(lambda r: np.frombuffer(r["x"]).reshape(size, -1)).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(n_iter):
        s = np.sum(x.mapPartitions(nearest_sums(centres)).collect(), axis=0)
        new = [(own[:-1] / own[-1]).tolist() if own[-1] else c for own, c in zip(s, centres, strict=True)]
        moved = sum((a - b) ** 2 for p, q in zip(centres, new, strict=True) for a, b in zip(p, q, strict=True))
        centres = new
        if moved <= tol * spread:
            break
    x.unpersist()
    return np.array(sorted(centres))


def clustered_start(sequences: DataFrame, n_states: int, label: str, floor: float = 1e-3, seed: int = 42) -> dict[str, Hmm]:
    """One model with all transitions for all sequences (label, seq): means are the centres of the frames, variances those of all frames, start and transitions even."""
    frames = checkpointed(sequences.select(F.explode("seq").alias("vec")))
    centres = k_means(frames, n_states, seed=seed)
    var = frames.agg(*[F.var_pop(F.get("vec", F.lit(j))) for j in range(centres.shape[1])]).first()
    n = len(centres)
    return {label: Hmm(np.full(n, 1 / n), np.full((n, n), 1 / n), centres, np.tile(np.array(var, dtype=float) + floor, (n, 1)))}


def models_table(spark, models: dict[str, Hmm]) -> DataFrame:
    """(label, state, pi, trans, mean, var), to be saved as Parquet."""
    rows = [(label, k, float(m.pi[k]), m.a[k].tolist(), m.mean[k].tolist(), m.var[k].tolist()) for label, m in models.items() for k in range(len(m.pi))]
    return spark.createDataFrame(rows, "label string, state int, pi double, trans array<double>, mean array<double>, var array<double>")


def models_from(table: DataFrame) -> dict[str, Hmm]:
    d = table.toPandas().sort_values(["label", "state"])
    return {label: Hmm(g["pi"].to_numpy(), stacked(g["trans"]), stacked(g["mean"]), stacked(g["var"])) for label, g in d.groupby("label")}


def hmm_log_emission(frames: DataFrame, models: DataFrame) -> DataFrame:
    """(rec_id, frame_idx, vec) and a table of models -> (rec_id, frame_idx, label, state, log_b)."""
    d = frames.crossJoin(models.select("label", "state", "mean", "var"))
    terms = F.zip_with(F.zip_with("vec", "mean", lambda x, m: (x - m) * (x - m)), F.col("var"), lambda q, v: q / v + F.log(v))
    return d.select("rec_id", "frame_idx", "label", "state", (-0.5 * (F.size("vec") * float(np.log(2 * np.pi)) + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))).alias("log_b"))


def hmm_scores(sequences: DataFrame, models: dict[str, Hmm]) -> DataFrame:
    """(rec_id, seq) -> (rec_id, label, score): log likelihoods under each model, of all sequences of one length in a batch at once."""
    kind = dict(sequences.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ids = d["rec_id"].to_numpy()
            for at, x in stacks([stacked(s) for s in d["seq"]]):
                for label, m in models.items():
                    yield pd.DataFrame({"rec_id": ids[at], "label": label, "score": m.forward(m.log_emission(x))[0]})

    return sequences.select("rec_id", "seq").mapInPandas(rows, f"rec_id {kind}, label string, score double")


def hmm_recognize(test: DataFrame, models: dict[str, Hmm], top: int = 2) -> DataFrame:
    d = hmm_scores(test, models).join(test.select("rec_id", "truth"), "rec_id")
    return ranked(d, F.col("score").desc(), top)


def hmm_viterbi(sequences: DataFrame, models: dict[str, Hmm]) -> DataFrame:
    """(rec_id, label, seq) -> (rec_id, label, score, path) under the label's own model."""
    kind = dict(sequences.dtypes)["rec_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for label, g in d.groupby("label"):
                ids = g["rec_id"].to_numpy()
                for at, x in stacks([stacked(s) for s in g["seq"]]) if label in models else ():
                    score, path = models[label].viterbi(x)
                    yield pd.DataFrame({"rec_id": ids[at], "label": label, "score": score, "path": path.tolist()})

    return sequences.select("rec_id", "label", "seq").mapInPandas(rows, f"rec_id {kind}, label string, score double, path array<int>")


def score_table(scores: DataFrame, labels: list[str]) -> DataFrame:
    """(rec_id, label, score) -> a row for each recording and a column for each label."""
    return scores.groupBy("rec_id").pivot("label", labels).agg(F.max("score"))


def hmm_state_durations(paths: DataFrame, hop_ms: float = 10.0) -> DataFrame:
    d = paths.select("rec_id", "label", F.explode("path").alias("state")).groupBy("rec_id", "label", "state").agg(F.count("*").alias("n_frames"))
    return d.withColumn("ms", F.col("n_frames") * hop_ms)
