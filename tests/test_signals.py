"""Operators on small signals with known answers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.functions import dsp
from phonolake.operators import frames, levels, models, separation, spectral, speakers, units
from phonolake.sources import audio


def recordings(spark, **signals):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in signals.items()], "rec_id string, samples array<double>")


def test_sine_has_one_peak(spark):
    x = np.sin(2 * np.pi * 8 * np.arange(64) / 64)
    d = spectral.fft_spectrum(recordings(spark, a=x), 64, 64, "rectangular").toPandas()
    assert d.loc[d["mag"].idxmax(), "k"] == 8
    assert d["mag"].max() == pytest.approx(1)
    p = spectral.spectral_peaks(spectral.spectra_rows(recordings(spark, a=x), 1024, 64), min_freq=20).toPandas()
    assert p["k"].tolist() == [8]


def test_impulse_gives_taps(spark):
    b = dsp.design_fir("lowpass", 100, 1000, 21)
    assert np.allclose(b, b[::-1]) and b.sum() == pytest.approx(1)
    x = np.zeros(64)
    x[30] = 1
    y = spectral.apply_fir(recordings(spark, a=x), b).first()["samples"]
    assert np.allclose(y[20:41], b)
    info = spectral.fir_info(spectral.fir_taps(spark, "highpass", 100, 1000, 20), 1000).first()
    assert (info["n_taps"], info["symmetric"]) == (21, True)


def test_constant_signal(spark):
    d = levels.to_long(recordings(spark, a=[0.5] * 40))
    s = levels.time_domain_stats(d).first()
    assert (s["zcr"], s["peak"], s["crest"]) == (0, 0.5, pytest.approx(1))
    f = frames.frame_signal(recordings(spark, a=[0.5] * 10), 100, 16, 8, None)
    assert f.count() == 1 and len(f.first()["frame"]) == 16


def test_endpoints_of_a_tone(spark):
    x = np.concatenate([np.zeros(1600), np.sin(np.arange(1600)), np.zeros(1600)])
    f = frames.frame_zcr(frames.frame_energy_features(frames.frame_signal(recordings(spark, a=x), 1000, 80, 40)))
    b = frames.endpoint_detect(f, spark.createDataFrame([("a", len(x))], "rec_id string, len int"), 80, 40, margin=0).first()
    assert abs(b["start"] - 1600) <= 80 and abs(b["end"] - 3200) <= 80


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_round_trip(spark, tmp_path, bits, channels):
    x = np.sin(np.arange(200) / 7)[:, None] * np.array([[0.9, 0.4]])[:, :channels]
    (tmp_path / "one.wav").write_bytes(audio.wav_bytes(x, 8000, bits))
    r = audio.read_wav(spark, str(tmp_path)).first()
    assert (r["rec_id"], r["fs"], r["channels"], r["bit_depth"], r["n_frames"]) == ("one", 8000, channels, bits, 200)
    assert np.abs(np.array(r["samples_ch"]).T - x).max() < 2 / 2 ** (bits - 1) + 1e-4
    assert audio.parse_wav(audio.write_wav(audio.read_wav(spark, str(tmp_path)), 16).first()["content"])[2] == 16


def test_lexicon_and_dataset(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("# c\n\nba b a\nmo\nba b aa\n")
    assert [tuple(r) for r in audio.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()] == [("ba", ["b", "aa"])]
    files = spark.createDataFrame([(f"/d/{w}/{w}_{k}.wav",) for w in ("a", "b") for k in range(4)], "path string")
    d = audio.list_dataset(files, 3).toPandas()
    assert d[d["split"] == "test"]["path"].tolist() == ["/d/a/a_3.wav", "/d/b/b_3.wav"]
    t = models.models_table(spark, {"w": models.Hmm(*models.left_right(2), np.zeros((2, 1)), np.ones((2, 1)))})
    audio.save_models(t, str(tmp_path / "m"))
    assert np.allclose(models.models_from(audio.load_models(spark, str(tmp_path / "m")))["w"].a, [[0.7, 0.3], [0, 1]])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=70, max_size=300))
def test_istft_inverts_stft(x):
    x = np.array(x)
    assert np.allclose(dsp.istft(dsp.stft(x, 64, 64, 16), len(x), 64, 64, 16), x, atol=1e-9)
    assert len(dsp.resample(x, 100, 40)) == -(-len(x) * 2 // 5)


def slow_dtw(x, y):
    best = {}
    for i in range(len(x)):
        for j in range(len(y)):
            c = float(np.linalg.norm(x[i] - y[j]))
            ways = [best[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in best]
            before = min(ways, key=lambda w: w[0]) if ways else (0.0, 0)
            best[i, j] = (c + before[0], before[1] + 1)
    return best[len(x) - 1, len(y) - 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_dtw(a, b):
    x, y = np.array(a, dtype=float)[:, None], np.array(b, dtype=float)[:, None]
    got, want = dsp.dtw(x, y), slow_dtw(x, y)
    assert got[0] == pytest.approx(want[0]) and got[1] == want[1]
    assert dsp.dtw(x, x)[0] == 0


def test_blocks_of_sequences(spark):
    """Sequences of unlike lengths in small blocks get the least score of each label, as all pairs one by one give it; paths add up."""
    r = np.random.default_rng(3)
    seq = lambda: r.integers(0, 4, (int(r.integers(1, 6)), 2)).astype(float)
    test, tmpl = [(k, "t", seq()) for k in range(11)], [(f"l{k % 3}", k, seq()) for k in range(17)]
    t = spark.createDataFrame([(k, x, v.tolist()) for k, x, v in test], "rec_id long, truth string, seq array<array<double>>")
    m = spark.createDataFrame([(x, k, v.tolist()) for x, k, v in tmpl], "label string, tmpl_id long, template array<array<double>>")
    score = lambda x, y: (w := slow_dtw(x, y))[0] / w[1]
    for got in models.dtw_recognize(t, m, block=4).collect():
        x = test[got["rec_id"]][2]
        least = sorted((min(score(x, v) for n, _, v in tmpl if n == name), name) for name in ("l0", "l1", "l2"))
        assert (got["top1_score"], got["top2_score"]) == (pytest.approx(least[0][0]), pytest.approx(least[1][0])) and got["truth"] == "t"
        assert least[0][0] == pytest.approx(next(s for s, n in least if n == got["top1_label"]))
    assert models.dtw_recognize(t.filter("1 = 0"), m).count() == 0 == models.dtw_recognize(t, m.filter("1 = 0")).count()
    pairs = spark.createDataFrame([(k, test[k][2].tolist(), tmpl[k][2].tolist()) for k in range(11)], "k long, seq array<array<double>>, template array<array<double>>")
    for got in models.dtw_pairs(pairs, with_path=True).collect():
        x, y, path = test[got["k"]][2], tmpl[got["k"]][2], [(p["i"], p["j"]) for p in got["path"]]
        assert path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1) and len(path) == got["path_length"]
        assert all((b[0] - a[0], b[1] - a[1]) in ((1, 0), (0, 1), (1, 1)) for a, b in zip(path, path[1:], strict=False))
        assert sum(np.linalg.norm(x[i] - y[j]) for i, j in path) == pytest.approx(got["cost"])


def test_first_rows_and_reject_threshold(spark):
    from phonolake.functions.columns import first_rows
    from phonolake.operators import evaluation

    rows = [(f"l{k % 3}", (7 * k) % 101) for k in range(101)]
    got = first_rows(spark.createDataFrame(rows, "label string, rec_id long"), "label", "rec_id", 4, ways=5).collect()
    assert sorted((r["label"], r["rec_id"]) for r in got) == [x for n in ("l0", "l1", "l2") for x in sorted(v for v in rows if v[0] == n)[:4]]
    r = np.random.default_rng(2)
    for scores in (r.normal(size=500), np.round(r.normal(size=300)), np.full(20, 3.0), np.array([1.5])):
        d = spark.createDataFrame([("a", "a", float(x)) for x in scores] + [("a", "b", -99.0)], "truth string, pred string, score double")
        for share in (0.05, 0.5, 1.0):
            one = evaluation.reject_threshold(d, share, bins=16).first()
            assert one["n"] == len(scores) and one["threshold"] == pytest.approx(np.quantile(scores, share))


def test_thresholds_against_counting(spark):
    r = np.random.default_rng(8)
    trials = [(float(np.round(x, 2)), int(g)) for x, g in zip(r.uniform(-1, 1, 300), r.integers(0, 2, 300), strict=True)] + [(-1.0, 0), (1.0, 1), (0.1, 0), (0.1, 1)]
    got = speakers.threshold_sweep(spark.createDataFrame(trials, "score double, genuine int"), 21, 50).collect()
    assert len(got) >= 70
    for row in got:
        t = row["theta"]
        assert row["far"] == pytest.approx(np.mean([s >= t for s, g in trials if not g])) and row["frr"] == pytest.approx(np.mean([s < t for s, g in trials if g]))


def test_pitch_under_a_hann_window(spark):
    x = np.sin(2 * np.pi * 20 * np.arange(200) / 1000)
    d = frames.hann_pitch(frames.frame_signal(recordings(spark, a=x), 1000, 150, 50, None), 1000, 10, 100).collect()
    assert len(d) == 2 and all(abs(r["f0"] - 20) < 1.5 for r in d)


def test_csv_and_phases(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, [1, 2]), ("b,c", 2, None)], "k string, n int, v array<int>")
    audio.write_csv_tables({"t": d}, str(tmp_path))
    back = audio.read_csv_tables(spark, str(tmp_path), {"t": "k string, n int, v string"})["t"]
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1, "1 2"), ("b,c", 2, None)]
    taps = spectral.fir_taps(spark, "lowpass", 100, 1000, 21)
    r = spectral.filter_response(taps, 1000, 32).orderBy("f_hz").toPandas()
    assert np.allclose(r["delay"][:6], 10) and np.allclose(r["phase_deg"][:6], -360 * r["f_hz"][:6] / 1000 * 10)


def test_dtw_of_a_stretched_sequence():
    assert dsp.dtw(np.array([[0.0], [1], [2]]), np.array([[0.0], [1], [1], [2]]))[0] == 0


def test_hmm_by_enumeration():
    m = models.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0], [1.0]]), np.array([[1.0], [0.5]]))
    x = np.array([[0.1], [0.9], [0.4]])
    b = np.exp(m.log_emission(x))
    paths = {(i, j, k): m.pi[i] * b[0, i] * m.a[i, j] * b[1, j] * m.a[j, k] * b[2, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    assert m.forward(m.log_emission(x))[0] == pytest.approx(np.log(sum(paths.values())))
    score, path = m.viterbi(x)
    assert tuple(path) == max(paths, key=paths.get) and score == pytest.approx(np.log(max(paths.values())))


def test_training_rises(spark):
    r = np.random.default_rng(0)
    rows = [(k, w, (np.repeat([0.0, c, 2 * c], 4)[:, None] + r.normal(0, 0.2, (12, 2))).tolist()) for k, (w, c) in enumerate([("a", 1.0), ("b", -1.0)] * 6)]
    s = spark.createDataFrame(rows, "rec_id long, label string, seq array<array<double>>")
    ms, log = models.hmm_train(s, 3, 8)
    for w in ("a", "b"):
        ll = [x[2] for x in log if x[0] == w]
        assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:], strict=False))
    got = models.hmm_recognize(s.withColumnRenamed("label", "truth"), ms).toPandas()
    assert (got["truth"] == got["top1_label"]).all()


def test_known_answers(spark):
    v = spark.createDataFrame([(1, [3.0])], "rec_id int, vec array<double>")
    assert models.gmm_likelihood(v, [0.6, 0.4], [[2.0], [5.0]], [[[1.0]], [[2.0]]]).first()["likelihood"] == pytest.approx(0.1867, abs=5e-5)
    with pytest.raises(ValueError, match="positive"):
        models.gaussian_density(np.zeros((1, 2)), np.zeros(2), np.ones((2, 2)))


def test_separation(spark):
    n = 2000
    a = spark.range(n).select(F.col("id").alias("n"), ((F.col("id") % 7) - 3.0).alias("x"))
    b = spark.range(n).select(F.col("id").alias("n"), F.sin(F.col("id") / 5).alias("x"))
    d = separation.source_correlation(separation.resolve_ica(separation.fast_ica(separation.mix_sources(a, b)))).toPandas()
    assert (d[d["source"] == d["estimate"]]["corr"] > 0.99).all()


def test_verification(spark):
    t = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 1), (0.7, 0), (0.2, 0), (0.1, 0), (0.0, 0), (-0.5, 0), (-0.9, 0)], "score double, genuine int")
    v = speakers.verify_at_threshold(t, 0.7).first()
    assert (round(v["far"], 6), round(v["frr"], 6)) == (round(1 / 6, 6), round(1 / 3, 6))
    s = speakers.threshold_sweep(t, 21, 10).toPandas().sort_values("theta")
    assert s["far"].is_monotonic_decreasing and s["frr"].is_monotonic_increasing


def test_unit_selection_against_all_paths(spark):
    import itertools

    r = np.random.default_rng(1)
    target = {(s, p, c): float(r.integers(0, 9)) for s in range(3) for p in range(s + 1, 5) for c in (1, 2, 3)}
    join = {(a, b): float(r.integers(0, 9)) for a in (1, 2, 3) for b in (1, 2, 3)}
    pos = spark.createDataFrame([(s, p, "u", c, t) for (s, p, c), t in target.items()], "sent_id long, pos int, unit string, candidate int, target_cost double")
    edges = spark.createDataFrame([(f"u#{a}", f"u#{b}", j) for (a, b), j in join.items()], "left string, right string, join_cost double")
    for row in units.unit_selection(pos, edges).collect():
        places = range(row["sent_id"] + 1, 5)
        cost = lambda path: sum(target[row["sent_id"], p, c] for p, c in zip(places, path, strict=True)) + sum(join[x] for x in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert row["cost"] == min(map(cost, itertools.product((1, 2, 3), repeat=len(places)))) == cost(tuple(row["path"]))


def test_crossfade(spark):
    u = spark.createDataFrame([(1, 0, [1.0] * 10), (1, 1, [0.0] * 10)], "sent_id long, pos int, samples array<double>")
    r = units.crossfade_concat(u, 4).first()
    assert len(r["samples"]) == 16 and r["boundaries"] == [0, 8] and r["samples"][6:10] == pytest.approx([1, 2 / 3, 1 / 3, 0])


def test_models_are_whole(spark):
    """All enrolled sequences are templates, training goes on until it settles, and every context has its next words."""
    from phonolake.jobs import registry

    sf = "/root/testdata/sf0.001"
    far = [(k, "a", [[9.0 + k], [1.0]]) for k in range(4)] + [(4, "a", [[0.0], [0.0]]), (5, "b", [[1.0], [1.0]])]
    t = models.build_templates(spark.createDataFrame(far, "rec_id long, label string, seq array<array<double>>"))
    test = spark.createDataFrame([(9, "a", [[0.0], [0.0]])], "rec_id long, truth string, seq array<array<double>>")
    assert models.dtw_recognize(test, t).first()["top1_label"] == "a"
    last = {}
    for r in registry.QUERIES["hmm_convergence"](spark, sf).orderBy("iteration").collect():
        last[r["label"]] = r
    assert last and all(r["converged"] or r["iteration"] == 79 for r in last.values())
    contexts = registry.QUERIES["next_words_of_all"](spark, sf).groupBy("context").count()
    assert contexts.count() > 20 and contexts.filter("count <> 6").count() == 0


def test_all_units_are_candidates(spark):
    """The least cost over every candidate, as all combinations give it, and over all parts at most that of two of each brand."""
    from itertools import product

    from phonolake.jobs import registry

    rng = np.random.default_rng(5)
    inv = [(u, k, float(rng.uniform(0.2, 0.5)), float(rng.integers(40, 110)) / 1000) for u in "ab" for k in range(12)]
    seqs = {1: "aba", 2: "b", 3: "aab", 4: "axb"}
    i = spark.createDataFrame(inv, "unit string, candidate long, duration_s double, rms double")
    p = spark.createDataFrame([(s, k, u) for s, us in seqs.items() for k, u in enumerate(us)], "sent_id long, pos int, unit string")
    t = {(u, k): (2 * ((d - 0.35) / 0.1) ** 2 + 5 * ((r - 0.08) / 0.02) ** 2, r) for u, k, d, r in inv} | {("x", -1): (0.0, None)}

    def cost(us, ks):
        c = [t[x] for x in zip(us, ks, strict=True)]
        return sum(x[0] for x in c) + sum(100 * abs(a[1] - b[1]) + 0.5 * (u != v) for a, b, u, v in zip(c, c[1:], us, us[1:]) if None not in (a[1], b[1]))

    got = units.least_cost(p, i).collect()
    assert len(got) == len(seqs)
    for r in got:
        us = seqs[r["sent_id"]]
        assert r["cost"] == pytest.approx(min(cost(us, ks) for ks in product(*[[k for v, k in t if v == u] for u in us])))
        assert r["cost"] == pytest.approx(cost(us, r["path"]))
    sf = "/root/testdata/sf0.001"
    q = registry.QUERIES
    j = q["unit_selection"](spark, sf).withColumnRenamed("cost", "lattice").join(q["unit_selection_of_all"](spark, sf), "sent_id")
    assert j.count() > 0 and j.filter("abs(cost - lattice) > 1e-6").count() == 0


def test_joins_of_short_and_unequal_units(spark):
    """Edges are as long as the shorter unit allows, by the formulas of the specification; 25 ms are 400 samples."""
    r = np.random.default_rng(6)
    units_ = {str(n): r.uniform(-1, 1, n) for n in (0, 1, 10, 200, 399, 400, 800)}
    pairs = [(a, b) for a in units_ for b in units_]
    got = units.join_cost(spark.createDataFrame(pairs, "left string, right string"), spark.createDataFrame([(k, x.tolist()) for k, x in units_.items()], "key string, samples array<double>")).collect()
    assert len(got) == len(pairs)
    for row in got:
        a, b = units_[row["left"]], units_[row["right"]]
        n = min(400, len(a), len(b))
        if not n:
            assert (row["join_cost"], row["boundary_lsd"]) == (0, 0)
            continue
        x, y = a[len(a) - n :], b[:n]
        db = [20 * np.log10(np.maximum(np.abs(np.fft.rfft(v * np.hanning(n), 512)), 1e-8)) for v in (x, y)]
        lsd, rms = np.mean((db[0] - db[1]) ** 2), [np.sqrt(np.mean(v**2) + 1e-12) for v in (x, y)]
        assert row["join_cost"] == pytest.approx(lsd + 100 * abs(rms[0] - rms[1]))
        assert row["boundary_lsd"] == pytest.approx(lsd if n == 400 else 0)
