"""Models over sequences against plain versions: pruned matching, training in tasks and step by step, clusters, paths along time, blocked scores, exact quantiles, peaks."""

import numpy as np
import pytest

from phonolake.functions import dsp
from phonolake.operators import evaluation, models, separation, speakers, spectral, timeline

R = np.random.default_rng(11)


def sequences(spark, n, dims=3):
    rows = [(k, f"w{k % 4}", R.normal(loc=k % 4, size=(int(R.integers(1, 9)), dims)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "rec_id long, label string, seq array<array<double>>"), rows


def test_pruned_matching_has_the_same_scores(spark):
    """The two best labels and their scores are those of all pairs; part of the cells is never filled."""
    tests, a = sequences(spark, 40)
    templates, b = sequences(spark, 60)
    test = tests.selectExpr("rec_id", "label AS truth", "seq")
    got = models.dtw_recognize(test, models.build_templates(templates), block=16, share=True).collect()
    assert len(got) == 40 and all(0 < r["share"] <= 1 for r in got) and np.mean([r["share"] for r in got]) < 0.9
    for r in got:
        x = np.array(a[r["rec_id"]][2])
        best = {}
        for _, label, y in b:
            cost, steps = dsp.dtw(x, np.array(y))
            best[label] = min(best.get(label, np.inf), cost / steps)
        (l1, s1), (l2, s2) = sorted(best.items(), key=lambda z: (z[1], z[0]))[:2]
        assert (r["top1_label"], r["top2_label"]) == (l1, l2) and (r["top1_score"], r["top2_score"]) == pytest.approx((s1, s2))


def test_bounds_are_below_the_scores():
    xs, ys = ([R.normal(size=(int(R.integers(1, 12)), 4)) for _ in range(12)] for _ in range(2))
    assert (dsp.dtw_bounds(xs, ys) <= dsp.dtw_scores(xs, ys)).all()
    score, filled = dsp.dtw_limited(xs, ys, np.full(12, np.inf))
    assert np.allclose(score, np.diag(dsp.dtw_scores(xs, ys))) and filled.tolist() == [len(x) * len(y) for x, y in zip(xs, ys, strict=True)]


def test_training_in_tasks_and_step_by_step(spark, monkeypatch):
    """Labels that fit a task and labels that do not get the same models, and likelihoods never fall."""
    d, _ = sequences(spark, 60)
    small, log = models.hmm_train(d, 3, 12)
    monkeypatch.setattr(models, "TASK_NUMBERS", 0)
    large, steps = models.hmm_train(d, 3, 12)
    assert small.keys() == large.keys() and sorted((x[0], x[1], x[3]) for x in log) == sorted((x[0], x[1], x[3]) for x in steps)
    for k, m in small.items():
        assert all(np.allclose(getattr(m, f), getattr(large[k], f)) for f in ("pi", "a", "mean", "var"))
        lls = [x[2] for x in sorted(log, key=lambda x: x[1]) if x[0] == k]
        assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:], strict=False))


def test_clusters(spark):
    """Three far clouds are found from any order; fewer different vectors than clusters give fewer centres."""
    x = np.concatenate([R.normal(loc=c, scale=0.2, size=(200, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    d = spark.createDataFrame([(v.tolist(),) for v in R.permutation(x)], "vec array<double>")
    assert np.allclose(models.k_means(d, 3), [(0, 0), (0, 9), (5, 5)], atol=0.1)
    assert models.k_means(spark.createDataFrame([([1.0],), ([1.0],), ([2.0],)], "vec array<double>"), 3).tolist() == [[1.0], [2.0]]


def test_segments_up_to_their_names(spark):
    """Sequences that dwell in three far states are cut where they change, whatever the states are called."""
    rows, truth = [], {}
    for k in range(12):
        states = np.repeat(R.permutation(3), R.integers(5, 9, 3))
        truth[k] = states
        rows.append((k, "all", (states[:, None] * 6.0 + R.normal(scale=0.3, size=(len(states), 2))).tolist()))
    s = spark.createDataFrame(rows, "rec_id long, label string, seq array<array<double>>")
    m, log = models.hmm_train(s, 3, 100, 1e-2, start=models.clustered_start(s, 3, "all"), prior=1e-2)
    assert log[-1][3]
    found = {r["rec_id"]: np.array(r["path"]) for r in models.hmm_viterbi(s, m).collect()}
    named = {}
    for k, states in truth.items():
        for a, b in zip(states.tolist(), found[k].tolist(), strict=True):
            assert named.setdefault(a, b) == b
    assert len(set(named.values())) == 3


@pytest.mark.parametrize(("size", "fan"), [(3, 2), (7, 3), (100, 4)])
def test_paths_along_time(spark, size, fan):
    """Blocks of any size give the path and the likelihood of the whole sequence."""
    m = models.Hmm(np.array([0.6, 0.3, 0.1]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]]), R.normal(size=(3, 2)), np.full((3, 2), 0.8))
    seqs = {1: R.normal(size=(61, 2)), 2: R.normal(size=(1, 2)), 3: R.normal(size=(7, 2)), 4: R.normal(size=(42, 2))}
    frames = spark.createDataFrame([(k, "m" if k < 4 else "other", t, v.tolist()) for k, x in seqs.items() for t, v in enumerate(x)], "rec_id long, label string, frame_idx long, vec array<double>").repartition(3)
    paths = {}
    for r in sorted(timeline.viterbi_long(frames, {"m": m}, size, fan).collect(), key=lambda r: r["at"]):
        paths.setdefault(r["rec_id"], []).extend(r["path"])
        assert r["score"] == pytest.approx(m.viterbi(seqs[r["rec_id"]][None])[0][0])
    assert paths == {k: m.viterbi(seqs[k][None])[1][0].tolist() for k in (1, 2, 3)}
    scores = {r["rec_id"]: r["score"] for r in timeline.forward_long(frames, {"m": m}, size, fan).collect()}
    assert scores == pytest.approx({k: float(m.forward(m.log_emission(seqs[k]))[0]) for k in (1, 2, 3)})


def test_blocked_scores(spark):
    """All trials, and the two best of each recording, in blocks as in one."""
    test = spark.createDataFrame([(k, k % 5, R.normal(size=4).tolist()) for k in range(23)], "rec_id long, speaker long, vec array<double>")
    enrolled = spark.createDataFrame([(k, R.normal(size=4).tolist()) for k in range(9)] + [(9, [1.0, 2.0, 3.0, 4.0]), (10, [2.0, 4.0, 6.0, 8.0])], "speaker long, vec array<double>")
    one, many = (sorted(map(tuple, speakers.verification_trials(test, enrolled, n).collect())) for n in (4096, 3))
    assert len(one) == 23 * 11 and np.allclose([x[3] for x in one], [x[3] for x in many]) and [x[:3] for x in one] == [x[:3] for x in many]
    best = {}
    for claim, _, rec, score, _ in one:
        best.setdefault(rec, []).append((-round(score, 12), claim))
    for n in (4096, 3):
        for r in speakers.speaker_identify(test, enrolled, n).collect():
            (a, name), (b, _) = sorted(best[r["rec_id"]])[:2]
            assert r["pred"] == name or abs(a - b) < 1e-9
            assert (r["score"], r["margin"]) == pytest.approx((-a, b - a), abs=1e-9)


def test_exact_quantiles(spark):
    """As sorting has them: ties, one value, two values, huge and tiny ranges, nulls."""
    own = {1: [3.0], 2: [1.0, 2.0], 3: [5.0] * 40, 4: R.normal(size=5000).tolist(), 5: (10.0 ** R.uniform(-200, 200, 3000)).tolist(), 6: R.integers(0, 4, 999).astype(float).tolist()}
    d = spark.createDataFrame([(k, v) for k, x in own.items() for v in x] + [(4, None), (7, None)], "rec_id long, v double")
    for share in (0.0, 0.05, 0.5, 0.92, 1.0):
        got = {r["rec_id"]: r["quantile"] for r in evaluation.exact_quantiles(d, share, 16).collect()}
        assert got == pytest.approx({k: float(np.quantile(x, share)) for k, x in own.items()}, rel=1e-12)


def test_peaks_against_all_pairs():
    """Bases by a stack and distances by an ordered list are those of looking at all others."""
    for _ in range(50):
        v = R.integers(0, 12, 60).astype(float)
        want = [min(v[max([j for j in range(k) if v[j] > v[k]], default=-1) + 1 : k + 1]) for k in range(60)]
        assert spectral.bases(v).tolist() == want
        at, chosen = R.permutation(60)[:30], []
        for k in at.tolist():
            if all(abs(k - c) >= 4 for c in chosen):
                chosen.append(k)
        assert spectral.apart(at, 4) == chosen


def test_separation_tells_its_end(spark):
    n = 3000
    d = spark.range(n).selectExpr("id AS n", "(id % 7) - 3.0 AS x"), spark.range(n).selectExpr("id AS n", "sin(id / 5) AS x")
    found = separation.unmixing(separation.mix_sources(*d))
    assert found.settled and found.steps < 1000 and found.change < 1e-4
    short = separation.unmixing(separation.mix_sources(*d), max_iter=1)
    assert short.steps == 1 and short.settled == (short.change < 1e-4)
