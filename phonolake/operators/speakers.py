"""Speaker identification and verification with vectors (rec_id, speaker, vec)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.functions.columns import first_rows, norm
from phonolake.operators.frames import cmvn, delta, dims
from phonolake.sources.folders import checkpointed


def unit_length(vec: Column) -> Column:
    return F.transform(vec, lambda x: x / (norm(vec) + 1e-12))


def gathered(d: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("vec"))


def speaker_embedding(features: DataFrame) -> DataFrame:
    """(rec_id, frame_idx, vec) -> (rec_id, vec): means, then deviations of the dimensions over the frames, to unit length."""
    d = features.select("rec_id", dims(F.col("vec"))).groupBy("rec_id", "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    d = d.select("rec_id", "dim", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("m").alias("y")), F.struct(F.lit(1).alias("part"), F.col("s").alias("y")))).alias("e")).select("rec_id", "dim", "e.*")
    return gathered(d, ["rec_id"], ["part", "dim"], "y").withColumn("vec", unit_length(F.col("vec")))


def speaker_models(enroll: DataFrame, first: int | None = None) -> DataFrame:
    """(rec_id, speaker, vec) -> (speaker, vec): the mean of each speaker's first recordings, to unit length."""
    if first:
        enroll = enroll.join(first_rows(enroll.select("speaker", "rec_id"), "speaker", "rec_id", first), ["speaker", "rec_id"], "left_semi")
    d = enroll.select("speaker", dims(F.col("vec"))).groupBy("speaker", "dim").agg(F.avg("v").alias("y"))
    return gathered(d, ["speaker"], ["dim"], "y").withColumn("vec", unit_length(F.col("vec")))


def met_blocks(test: DataFrame, models: DataFrame, found: Callable, schema: str, block: int = 4096) -> DataFrame:
    """found(recordings, speakers, scores) for blocks of about so many recordings (rec_id, speaker, vec) and blocks of as many models, each two in a task
    of their own: scores are the cosines of all their pairs, by one product of matrices. Vectors are sent once for each block they meet.
    """
    size = lambda d: max(1, -(-d.count() // block))
    n_test, n_models = size(test), size(models)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    test, models = checkpointed(test.select("rec_id", "speaker", "vec")), checkpointed(models.select("speaker", "vec"))
    own = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  new columns, for both may come from one table
    x = test.select(*own("rec_id", "speaker", "vec"), F.pmod(F.xxhash64("rec_id"), F.lit(n_test)).cast("int").alias("a"), every(n_models).alias("b"))
    y = models.select(*own("speaker", "vec"), every(n_test).alias("a"), F.pmod(F.xxhash64("speaker"), F.lit(n_models)).cast("int").alias("b"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return found(left.iloc[:0], right.iloc[:0], np.zeros((0, 0)))
        u, v = np.stack(left["vec"].to_numpy()).astype(float), np.stack(right["vec"].to_numpy()).astype(float)
        return found(left, right, u @ v.T / (np.sqrt((u * u).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1)) + 1e-12))

    return x.groupBy("a", "b").cogroup(y.groupBy("a", "b")).applyInPandas(meet, schema)


def verification_trials(test: DataFrame, models: DataFrame, block: int = 4096) -> DataFrame:
    """(claim, actual, rec_id, score, genuine) for each recording and speaker."""
    kinds = dict(test.dtypes)

    def pairs(left: pd.DataFrame, right: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        claim, actual = np.tile(right["speaker"], len(left)), np.repeat(left["speaker"].to_numpy(), len(right))
        return pd.DataFrame({"claim": claim, "actual": actual, "rec_id": np.repeat(left["rec_id"].to_numpy(), len(right)), "score": scores.ravel(), "genuine": (claim == actual).astype(np.int32)})

    return met_blocks(test, models, pairs, f"claim {kinds['speaker']}, actual {kinds['speaker']}, rec_id {kinds['rec_id']}, score double, genuine int", block)


def speaker_identify(test: DataFrame, models: DataFrame, block: int = 4096) -> DataFrame:
    """(rec_id, actual, pred, score, margin): the speaker with the highest score, ties to the least, and how far it is ahead of the next.

    A task keeps a recording's two best of its models; of these the two best of all are taken, the windows of which keep two rows themselves before the shuffle.
    """
    kinds = dict(test.dtypes)

    def best(left: pd.DataFrame, right: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        order = np.argsort(right["speaker"].to_numpy(), kind="stable")
        names, scores = right["speaker"].to_numpy()[order], scores[:, order]
        top = np.argsort(-scores, axis=1, kind="stable")[:, :2]
        n = top.shape[1]
        return pd.DataFrame({"rec_id": np.repeat(left["rec_id"].to_numpy(), n), "actual": np.repeat(left["speaker"].to_numpy(), n), "pred": names[top.ravel()], "score": np.take_along_axis(scores, top, axis=1).ravel()})

    d = met_blocks(test, models, best, f"rec_id {kinds['rec_id']}, actual {kinds['speaker']}, pred {kinds['speaker']}, score double", block)
    d = d.withColumn("k", F.row_number().over(W.partitionBy("rec_id", "actual").orderBy(F.desc("score"), "pred"))).filter("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return d.groupBy("rec_id", "actual").agg(pick(1, "pred").alias("pred"), pick(1, "score").alias("score"), (pick(1, "score") - pick(2, "score")).alias("margin"))


def threshold_sweep(trials: DataFrame, num: int = 401, fine: int = 1000, reach: float = 0.005) -> DataFrame:
    """(theta, far, frr) over num thresholds from -1 to 1 and fine ones over the scores' range and reach beyond.

    Thresholds are evenly spaced, so a score's place among them follows from its value, corrected by the neighbouring
    thresholds: there is no join of trials and thresholds, and counts are added up over the thresholds alone.
    """
    ends = trials.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    d = trials.crossJoin(F.broadcast(ends))  # one row
    coarse = lambda k: -1 + 2 * k / (num - 1)
    dense = lambda k: F.col("lo") - reach + (F.col("hi") - F.col("lo") + 2 * reach) * k / (fine - 1)
    a = _error_rates(d, ends, num, coarse, (F.col("score") + 1) * (num - 1) / 2)
    b = _error_rates(d, ends, fine, dense, (F.col("score") - F.col("lo") + reach) * (fine - 1) / (F.col("hi") - F.col("lo") + 2 * reach))
    return a.unionAll(b).distinct()


def _error_rates(trials: DataFrame, ends: DataFrame, num: int, theta: Callable[[Column], Column], guess: Column) -> DataFrame:
    """Rates at theta(0) to theta(num - 1); guess: about which of these a score is at."""
    k = F.least(F.greatest(F.floor(guess), F.lit(-1)), F.lit(num - 1))
    # thresholds up to the score
    place = F.when((k + 1 < num) & (theta(k + 1) <= F.col("score")), k + 2).when((k >= 0) & (theta(k) > F.col("score")), k).otherwise(k + 1)
    counts = trials.groupBy(place.alias("place")).agg(F.count(F.when(F.col("genuine") == 1, 1)).alias("g"), F.count(F.when(F.col("genuine") == 0, 1)).alias("i"))
    rows = trials.sparkSession.range(num + 1).join(counts, F.col("id") == F.col("place"), "left").fillna(0, ["g", "i"])
    below, every = W.orderBy("id"), W.partitionBy()  # num + 1 rows
    d = rows.select("id", F.sum("g").over(below).alias("g_low"), F.sum("i").over(below).alias("i_low"), F.sum("g").over(every).alias("gs"), F.sum("i").over(every).alias("is_")).filter(F.col("id") < num)
    d = d.crossJoin(F.broadcast(ends))
    return d.select(theta(F.col("id")).alias("theta"), (1 - F.col("i_low") / F.nullif(F.col("is_"), F.lit(0))).alias("far"), (F.col("g_low") / F.nullif(F.col("gs"), F.lit(0))).alias("frr"))


def equal_error(sweep: DataFrame) -> DataFrame:
    """The first threshold with the least |FAR - FRR|."""
    gap = F.round(F.abs(F.col("far") - F.col("frr")), 12)
    return sweep.agg(F.min(F.struct(gap.alias("gap"), "theta", "far", "frr")).alias("b")).select("b.theta", "b.far", "b.frr")


def verify_at_threshold(trials: DataFrame, theta: float) -> DataFrame:
    """FAR counts impostors at theta or above, FRR genuine ones under it."""
    hit = (F.col("score") >= theta).cast("double")
    return trials.agg(F.avg(F.when(F.col("genuine") == 0, hit)).alias("far"), F.avg(F.when(F.col("genuine") == 1, 1 - hit)).alias("frr"), F.count("*").alias("n"))


#: Deltas beside the features, means subtracted first, and how many recordings enrol.
ABLATION = (("baseline", True, False, 4), ("no delta", False, False, 4), ("cmn", True, True, 4), ("enroll 1", True, False, 1), ("enroll 2", True, False, 2))


def speaker_ablation(features: DataFrame, roles: DataFrame, configs: tuple[tuple[str, bool, bool, int], ...] = ABLATION) -> DataFrame:
    """(rec_id, frame_idx, vec) and (rec_id, speaker, role) -> (config, accuracy_pct, mean_margin) of identification."""
    union, made = None, {}
    for name, with_delta, cmn, first in configs:
        if (with_delta, cmn) not in made:  # embeddings once for each kind of features
            f = cmvn(features, False) if cmn else features
            if with_delta:
                f = delta(f.withColumn("_own", F.col("vec"))).select("rec_id", "frame_idx", F.concat("_own", "vec").alias("vec"))
            made[with_delta, cmn] = checkpointed(speaker_embedding(f).join(roles, "rec_id"))
        e = made[with_delta, cmn]
        d = speaker_identify(e.filter("role = 'test'"), speaker_models(e.filter("role = 'enroll'"), first))
        d = d.agg((100 * F.avg((F.col("pred") == F.col("actual")).cast("double"))).alias("accuracy_pct"), F.avg("margin").alias("mean_margin")).select(F.lit(name).alias("config"), "accuracy_pct", "mean_margin")
        union = d if union is None else union.unionAll(d)
    return union
