"""What the fourth round's findings were about, by their numbers."""

import numpy as np
import pytest

from phonolake.functions import dsp
from phonolake.operators import cepstral, models, separation

R = np.random.default_rng(44)


def test_f1_steps_that_do_not_settle_are_not_jobs(spark):
    """After the first steps all others come from means by direction, with the same rotation, in few jobs; with a far sample more directions are taken, or none."""
    d = spark.range(0, 3000, 1, 8).selectExpr("id AS n", "sin(id) + 0.3 * sign(sin(id * 0.37)) AS x1", "0.5 * sin(id) + sign(sin(id * 0.37)) AS x2")
    far = d.selectExpr("n", "x1 + if(n = 7, 30, 0) AS x1", "x2")
    sc = spark.sparkContext
    for mix, max_iter in ((d, 300), (far, 12)):
        sc.setJobGroup("f1", "")
        found = separation.unmixing(mix, max_iter, 0.0, passes=4)
        jobs = len(sc.statusTracker().getJobIdsForGroup("f1"))
        sc.setJobGroup("", "")
        want = separation.unmixing(mix, 12, 0.0, passes=12)
        assert found.steps == max_iter and jobs < 20 and np.allclose(np.abs(found.w), np.abs(want.w), atol=1e-9)


def test_f1_means_by_direction():
    """As a pass over the samples has them, for rotations and reflections; None where the polynomial is not exact yet."""
    z = R.normal(size=(2, 5000))
    sums = [next(separation.around(n)(iter([z[:, :3000], z[:, 3000:]]))) for n in (4, 128)]
    step = separation.by_direction(sums[1])
    assert separation.by_direction(sums[0]) is None
    for angle in (0.0, 1.0, 4.0):
        w = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        for v in (w, w[::-1]):
            s = next(separation.contrast(v)(iter([z])))
            assert step(v) == pytest.approx(s[:6] / s[6], abs=1e-12)


def dtw_tables(spark, x, y, labels):
    test = spark.createDataFrame([(k, "t", v.tolist()) for k, v in enumerate(x)], "rec_id long, truth string, seq array<array<double>>")
    tmpl = spark.createDataFrame([(labels[k], k, v.tolist()) for k, v in enumerate(y)], "label string, tmpl_id long, template array<array<double>>")
    return test, tmpl


def test_f2_f3_blocks_are_not_shuffled_to_those_they_meet(spark, monkeypatch):
    """Many parts and blocks: the same two best labels and scores as of all pairs, and the tasks' rows alone are shuffled after the blocks are stored, two for each test and part."""
    monkeypatch.setattr(models, "PART_BYTES", 4096)
    x, y = [R.normal(size=(int(R.integers(1, 6)), 3)) for _ in range(90)], [R.normal(size=(int(R.integers(1, 6)), 3)) for _ in range(200)]
    labels = [f"w{k % 5}" for k in range(200)]
    test, tmpl = dtw_tables(spark, x, y, labels)
    d = models.dtw_recognize(test, tmpl, block=16, share=True)
    plan = models.dtw_recognize(test, tmpl, block=16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "cogroup" not in plan.lower() and "FlatMapCoGroups" not in plan
    want = dsp.dtw_scores(x, y)
    least = np.stack([want[:, [n == m for m in labels]].min(axis=1) for n in sorted(set(labels))], axis=1)
    got = {r["rec_id"]: r for r in d.collect()}
    assert len(got) == 90
    for k, r in got.items():
        order = np.argsort(least[k], kind="stable")[:2]
        assert [r["top1_label"], r["top2_label"]] == [f"w{n}" for n in order] and (r["top1_score"], r["top2_score"]) == pytest.approx(tuple(least[k][order]))
        assert 0 < r["share"] <= 1


def test_f2_frames_of_a_clip_stay_in_its_row(spark):
    """Sequences are as frames grouped again have them, without a shuffle; empty and missing clips have no row."""
    d = spark.createDataFrame([(k, f"w{k % 2}", R.normal(size=64).tolist()) for k in range(6)] + [(6, "w0", []), (7, "w1", None)], "rec_id long, label string, samples array<double>")
    for options in ({}, {"trim": False, "dims": 13}, {"snr_db": 10.0}):
        got = cepstral.clip_sequences(d, 100, 16, 8, 64, **options)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = models.to_sequences(cepstral.clip_features(d, 100, 16, 8, 64, **options)).join(d.select("rec_id", "label"), "rec_id")
        assert sorted(got.select("rec_id", "label", "seq").collect()) == sorted(want.select("rec_id", "label", "seq").collect())


def test_f3_limits_are_handed_on():
    """What was found among other templates is kept and leaves fewer cells to fill; the scores are those of all pairs."""
    x, y = list(R.normal(size=(30, 8, 8))), list(R.normal(size=(400, 8, 8)))
    labels = np.array([f"w{k % 5}" for k in range(400)], dtype=object)
    first, _ = models.least_by_label(x, y[:200], labels[:200], 2)
    both, more = models.least_by_label(x, y[200:], labels[200:], 2, found=first)
    _, alone = models.least_by_label(x, y[200:], labels[200:], 2)
    want = dsp.dtw_scores(x, y)
    want = np.stack([want[:, labels == n].min(axis=1) for n in sorted(set(labels))], axis=1)
    assert np.allclose(np.sort(np.stack(list(both.values()), axis=1), axis=1)[:, :2], np.sort(want, axis=1)[:, :2]) and more.sum() < alone.sum()
