"""NumPy kernels on one recording or a stack of frames, for use inside tasks."""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def window(name: str, n: int, periodic: bool = False) -> np.ndarray:
    m = n + 1 if periodic else n
    return {"rectangular": np.ones, "hamming": np.hamming, "hann": np.hanning, "blackman": np.blackman, "bartlett": np.bartlett}[name](m)[:n]


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """max(1, 1 + (N - size) // hop) rows; a short signal is padded."""
    x = np.pad(x, (0, max(0, size - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def to_db(x: np.ndarray, floor: float = -120.0) -> np.ndarray:
    return np.maximum(20 * np.log10(np.abs(x) + 1e-15), floor)


def one_sided(x: np.ndarray, w: np.ndarray, nfft: int) -> np.ndarray:
    """Complex one-sided spectrum over N times the window's coherent gain, doubled but for the first and the last bin."""
    s = np.fft.rfft(x * w, nfft) / (x.shape[-1] * w.mean())
    s[..., 1:-1] *= 2
    return s


def design_fir(kind: str, cutoff: float | tuple[float, float], fs: float, taps: int = 201, shape: str = "hamming") -> np.ndarray:
    """Windowed-sinc low-pass, high-pass, band-pass or band-stop with unit gain in the middle of its pass band."""
    if taps % 2 == 0 and kind in ("highpass", "bandstop"):
        taps += 1
    n = np.arange(taps) - (taps - 1) / 2
    edges = np.atleast_1d(cutoff).astype(float) / (fs / 2)
    bands = {"lowpass": [(0.0, edges[0])], "highpass": [(edges[0], 1.0)], "bandpass": [(edges[0], edges[-1])], "bandstop": [(0.0, edges[0]), (edges[-1], 1.0)]}[kind]
    h = sum(b * np.sinc(b * n) - a * np.sinc(a * n) for a, b in bands) * window(shape, taps)
    a, b = bands[0]
    middle = 0.0 if a == 0 else 1.0 if b == 1 else (a + b) / 2
    return h / np.sum(h * np.cos(np.pi * n * middle))


def apply_fir(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Causal filtering, moved back by the group delay, zeros at the end."""
    d = (len(b) - 1) // 2
    y = np.convolve(x, b)[: len(x)]
    return np.concatenate([y[d:], np.zeros(min(d, len(x)))])


def frequency_response(b: np.ndarray, n: int, fs: float) -> tuple[np.ndarray, np.ndarray]:
    f = np.linspace(0, fs / 2, n, endpoint=False)
    return f, np.exp(-2j * np.pi * np.outer(f / fs, np.arange(len(b)))) @ b


def resampling_filter(up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """A Kaiser low-pass of half length 10 max(up, down), with gain up."""
    half = 10 * max(up, down)
    h = np.sinc(np.arange(-half, half + 1) / max(up, down)) / max(up, down) * np.kaiser(2 * half + 1, beta)
    return h * (up / h.sum())


def resample(x: np.ndarray, src: int, dst: int, beta: float = 5.0) -> np.ndarray:
    """Polyphase: zeros between samples, a Kaiser low-pass of half length 10 max(up, down), every down-th sample, clipped to ±1."""
    g = np.gcd(src, dst)
    up, down = dst // g, src // g
    if up == down:
        return x
    half, h = 10 * max(up, down), resampling_filter(up, down, beta)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.clip(np.convolve(wide, h)[half : half + len(wide)][::down], -1.0, 1.0)


def centred_window(nfft: int, size: int) -> np.ndarray:
    """A periodic Hann window in the middle of a frame."""
    w = np.zeros(nfft)
    a = (nfft - size) // 2
    w[a : a + size] = window("hann", size, periodic=True)
    return w


def stft(x: np.ndarray, nfft: int = 512, size: int = 400, hop: int = 160) -> np.ndarray:
    """Frames x bins, centred, with a periodic Hann window in the middle of each frame."""
    w = centred_window(nfft, size)
    padded = np.pad(x, nfft // 2)
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, nfft)[::hop] * w, axis=-1)


def istft(s: np.ndarray, length: int, nfft: int = 512, size: int = 400, hop: int = 160) -> np.ndarray:
    w = centred_window(nfft, size)
    y, norm = np.zeros(nfft + hop * (len(s) - 1)), np.zeros(nfft + hop * (len(s) - 1))
    for k, f in enumerate(np.fft.irfft(s, nfft, axis=-1) * w):
        y[k * hop : k * hop + nfft] += f
        norm[k * hop : k * hop + nfft] += w * w
    y = np.where(norm > 1e-11, y / np.maximum(norm, 1e-11), y)[nfft // 2 :]
    return np.pad(y[:length], (0, max(0, length - len(y))))


def mel(f: np.ndarray | float) -> np.ndarray | float:
    return 1125 * np.log(1 + np.asarray(f) / 700)


def mel_filterbank(nfft: int, n_mels: int, fs: float, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """Triangles, n_mels x (nfft // 2 + 1), corners at bins floor((nfft + 1) f / fs) of evenly spaced mels."""
    f = 700 * (np.exp(np.linspace(mel(fmin), mel(fmax or fs / 2), n_mels + 2) / 1125) - 1)
    b = np.floor((nfft + 1) * f / fs)
    k = np.arange(nfft // 2 + 1)
    lo, mid, hi = b[:-2, None], b[1:-1, None], b[2:, None]
    up, down = (k - lo) / (mid - lo + EPS), (hi - k) / (hi - mid + EPS)
    return np.where((k >= lo) & (k < mid), up, 0.0) + np.where((k >= mid) & (k < hi), down, 0.0)


def dct2(x: np.ndarray, n: int, ortho: bool = False) -> np.ndarray:
    """The first n coefficients of an unscaled (or orthonormal) DCT-II of the last axis."""
    size = x.shape[-1]
    basis = np.cos(np.pi * np.outer(np.arange(size) + 0.5, np.arange(n)) / size)
    if ortho:
        basis *= np.where(np.arange(n) == 0, np.sqrt(1 / size), np.sqrt(2 / size))
    return x @ basis


def log_mel(x: np.ndarray, fs: float, size: int, hop: int, nfft: int, n_mels: int, fmin: float = 0.0, alpha: float = 0.97) -> np.ndarray:
    x = np.concatenate([x[:1], x[1:] - alpha * x[:-1]])
    power = np.abs(np.fft.rfft(frames_of(x, size, hop) * window("hamming", size), nfft)) ** 2 / nfft
    return np.log(power @ mel_filterbank(nfft, n_mels, fs, fmin).T + EPS)


def mfcc(x: np.ndarray, fs: float, size: int, hop: int, nfft: int, n_mels: int = 24, n_mfcc: int = 13, fmin: float = 0.0, cmn: bool = True) -> np.ndarray:
    c = dct2(log_mel(x, fs, size, hop, nfft, n_mels, fmin), n_mfcc)
    return c - c.mean(axis=0) if cmn and len(c) > 1 else c


def slaney_mel(f: np.ndarray) -> np.ndarray:
    f = np.asarray(f, dtype=float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (np.log(6.4) / 27))


def slaney_bank(nfft: int, n_mels: int, fs: float) -> np.ndarray:
    """Triangles of equal area on a scale that is linear up to 1 kHz."""
    m = np.linspace(slaney_mel(0.0), slaney_mel(fs / 2), n_mels + 2)
    f = np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    k = np.fft.rfftfreq(nfft, 1 / fs)
    lo, mid, hi = f[:-2, None], f[1:-1, None], f[2:, None]
    return np.maximum(0, np.minimum((k - lo) / (mid - lo), (hi - k) / (hi - mid))) * 2 / (hi - lo)


def mel_db(x: np.ndarray, fs: float, n_mels: int, nfft: int = 512, size: int = 400, hop: int = 160, top_db: float = 80.0, relative: bool = False) -> np.ndarray:
    p = np.abs(stft(x, nfft, size, hop)) ** 2 @ slaney_bank(nfft, n_mels, fs).T
    db = 10 * np.log10(np.maximum(p, 1e-10)) - (10 * np.log10(max(p.max(), 1e-10)) if relative else 0.0)
    return np.maximum(db, db.max() - top_db)


def deltas(c: np.ndarray, win: int = 2) -> np.ndarray:
    t = np.arange(len(c))
    at = lambda k: c[np.clip(t + k, 0, len(c) - 1)]
    return sum(k * (at(k) - at(-k)) for k in range(1, win + 1)) / (2 * sum(k * k for k in range(1, win + 1)) + EPS)


def normalized(c: np.ndarray) -> np.ndarray:
    return (c - c.mean(axis=0)) / (c.std(axis=0) + 1e-8)


def endpoints(x: np.ndarray, size: int, hop: int, top_db: float = 30.0, margin: int = 4) -> tuple[int, int]:
    """Sample bounds of frames within top_db of the loudest one, with a margin; one hop beyond the last one."""
    e = 10 * np.log10(np.sum((frames_of(x, size, hop) * window("hamming", size)) ** 2, axis=1) + EPS)
    loud = np.flatnonzero(e >= e.max() - top_db)
    a, b = max(int(loud[0]) - margin, 0), min(int(loud[-1]) + margin, len(e) - 1)
    return a * hop, min((b + 1) * hop + size, len(x))


def feature_39(x: np.ndarray, fs: float, size: int, hop: int, nfft: int, trim: bool = True, cmvn: bool = True, n_mels: int = 26, fmin: float = 20.0) -> np.ndarray:
    if trim:
        a, b = endpoints(x, size, hop)
        x = x[a:b]
    c = mfcc(np.pad(x, (0, max(0, size - len(x)))), fs, size, hop, nfft, n_mels, 13, fmin, cmn=False)
    d = deltas(c)
    f = np.hstack([c, d, deltas(d)])
    return normalized(f) if cmvn else f


def time_stretch(x: np.ndarray, rate: float, nfft: int = 512, hop: int = 128) -> np.ndarray:
    """Phase vocoder: spectra at steps of rate, phases carried on by the measured advance."""
    s = stft(x, nfft, nfft, hop)
    at = np.arange(0, len(s), rate)
    s = np.vstack([s, np.zeros((2, s.shape[1]))])
    expected = 2 * np.pi * hop * np.arange(s.shape[1]) / nfft
    phase, out = np.angle(s[0]), []
    for t in at:
        k, f = int(t), t - int(t)
        out.append(((1 - f) * np.abs(s[k]) + f * np.abs(s[k + 1])) * np.exp(1j * phase))
        step = np.angle(s[k + 1]) - np.angle(s[k]) - expected
        phase = phase + expected + step - 2 * np.pi * np.round(step / (2 * np.pi))
    return istft(np.array(out), int(round(len(x) / rate)), nfft, nfft, hop)


def pitch_shift(x: np.ndarray, semitones: float) -> np.ndarray:
    """Stretched, then read faster or slower: the length stays."""
    rate = 2.0 ** (-semitones / 12)
    y = time_stretch(x, rate)
    return np.interp(np.linspace(0, len(y) - 1, len(x)), np.arange(len(y)), y) if len(y) else x


def dtw_stack(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stacks of sequences (pairs x n x dims and pairs x m x dims) the cost and length of each best path, and where each cell came
    from: 0 up, 1 left, 2 along the diagonal, in which order ties go. Cells of an anti-diagonal are done together, for all pairs."""
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    c = np.zeros((pairs, n, m))
    for d in range(x.shape[2]):
        c += (x[:, :, None, d] - y[:, None, :, d]) ** 2
    c = np.sqrt(c)
    d = np.full((pairs, n + 1, m + 1), np.inf)
    steps = np.zeros((pairs, n + 1, m + 1), dtype=np.int32)
    came = np.zeros((pairs, n, m), dtype=np.int8)
    d[:, 0, 0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        before = np.stack([d[:, i - 1, j], d[:, i, j - 1], d[:, i - 1, j - 1]])
        which = before.argmin(axis=0)
        d[:, i, j] = c[:, i - 1, j - 1] + before.min(axis=0)
        steps[:, i, j] = 1 + np.choose(which, [steps[:, i - 1, j], steps[:, i, j - 1], steps[:, i - 1, j - 1]])
        came[:, i - 1, j - 1] = which
    return d[:, n, m], steps[:, n, m].astype(np.int64), came


def dtw_path(came: np.ndarray) -> list[tuple[int, int]]:
    """The cells of one pair's best path, from the first to the last."""
    i, j = came.shape[0] - 1, came.shape[1] - 1
    path = [(i, j)]
    while i or j:
        which = came[i, j]
        i, j = i - (which != 1), j - (which != 0)
        path.append((i, j))
    return path[::-1]


def dtw(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Cost and length of the best path of two sequences."""
    cost, steps, _ = dtw_stack(x[None], y[None])
    return float(cost[0]), int(steps[0])


def dtw_scores(xs: list[np.ndarray], ys: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """Cost over path length of each of xs with each of ys; pairs of like lengths are done together, so many cells at a time."""
    out = np.empty((len(xs), len(ys)))
    by_length = lambda v: {n: np.array([k for k, s in enumerate(v) if len(s) == n]) for n in {len(s) for s in v}}
    for n, a in by_length(xs).items():
        for m, b in by_length(ys).items():
            x, y = np.stack([xs[k] for k in a]), np.stack([ys[k] for k in b])
            i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
            step = max(1, cells // (n * m))
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                cost, steps, _ = dtw_stack(x[p], y[q])
                out[a[p], b[q]] = cost / steps
    return out


def hann_pitch(frames: np.ndarray, fs: float, f0_min: float, f0_max: float) -> tuple[np.ndarray, np.ndarray]:
    """f0 and lag of each row of frames: less its mean, under a Hann window, at the highest autocorrelation by FFT of lags from fs / f0_max
    on and below fs / f0_min; 0 where there is no such lag."""
    size = frames.shape[1]
    x = (frames - frames.mean(axis=1, keepdims=True)) * np.hanning(size)
    nfft = next_pow2(2 * size - 1)
    r = np.fft.irfft(np.abs(np.fft.rfft(x, nfft)) ** 2, nfft)[:, :size]
    r = r / (r[:, :1] + 1e-12)
    lo, hi = int(fs / f0_max), min(int(fs / f0_min), size - 1)
    lag = r[:, lo:hi].argmax(axis=1) + lo if hi > lo else np.zeros(len(x), dtype=np.int64)
    return np.where(lag > 0, fs / np.maximum(lag, 1), 0.0), lag


def dtw_bounds(tests: list[np.ndarray], templates: list[np.ndarray]) -> np.ndarray:
    """For each test and template a bound from below on their score: each frame of one costs at least its distance to the box of all frames of
    the other, the first and the last pair cost what they do, and no path is longer than both sequences less one frame."""
    out = np.zeros((len(tests), len(templates)))
    where, ends = np.concatenate(tests), np.cumsum([0, *map(len, tests)])
    lows, highs = (np.stack([f(x, axis=0) for x in tests]) for f in (np.min, np.max))
    first, last = np.stack([x[0] for x in tests]), np.stack([x[-1] for x in tests])
    lens = np.diff(ends)
    for k, y in enumerate(templates):
        beyond = np.sqrt((np.maximum(np.maximum(y.min(axis=0) - where, where - y.max(axis=0)), 0) ** 2).sum(axis=1))
        rows = np.add.reduceat(beyond, ends[:-1])
        cols = np.sqrt((np.maximum(np.maximum(lows[:, None] - y, y - highs[:, None]), 0) ** 2).sum(axis=2)).sum(axis=1)
        corners = np.sqrt(((first - y[0]) ** 2).sum(axis=1)) + np.where(lens + len(y) > 2, np.sqrt(((last - y[-1]) ** 2).sum(axis=1)), 0.0)
        # a last bit less, so that rounding never makes it too high
        out[:, k] = np.maximum(np.maximum(rows, cols), corners) * (1 - 1e-12) / (lens + len(y) - 1)
    return out


def alike(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the sequences of each length."""
    lens = np.array([len(x) for x in sequences])
    return [np.flatnonzero(lens == n) for n in np.unique(lens)]


def coarse(sequences: list[np.ndarray], frames: int = 8) -> np.ndarray:
    """Each sequence as one vector of so many of its frames, evenly spaced."""
    return np.stack([x[np.arange(frames) * (len(x) - 1) // (frames - 1)].ravel() for x in sequences])


def nearest_of_groups(x: np.ndarray, y: np.ndarray, group: np.ndarray, n: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y): of each row of x its nearest row of y in each group, for the n nearest groups."""
    members = [np.flatnonzero(group == g) for g in np.unique(group)]
    at, who = [], []
    for k in range(0, len(x), rows):
        part = x[k : k + rows]
        d, pick = np.empty((len(part), len(members))), np.empty((len(part), len(members)), dtype=np.int64)
        for g, own in enumerate(members):
            far = (y[own] ** 2).sum(axis=1) - 2 * part @ y[own].T
            best = far.argmin(axis=1)
            d[:, g], pick[:, g] = far[np.arange(len(part)), best], own[best]
        near = np.argsort(d, axis=1, kind="stable")[:, :n]
        at.append(np.repeat(np.arange(k, k + len(part)), near.shape[1]))
        who.append(np.take_along_axis(pick, near, axis=1).ravel())
    return np.concatenate(at), np.concatenate(who)


def dtw_within(x: np.ndarray, y: np.ndarray, limit: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places (row of x, row of y) of two stacks of sequences that hold all pairs whose score is limit[row of x] or less.

    A score is the mean cost of one path. With costs in parts of the limit and one more for each step along the diagonal, all paths have n + m - 1 to spend, so no pair is left out
    whose least sum of these is that or less. Squared distances are products of matrices in single precision, made less by more than their rounding can be; sums of what is not negative are
    off by a share of themselves, which is allowed for. Numbers that are not negative have the order of their bits, so that least ones are found among integers, which is faster. So many
    rows of x are done at a time, in the same memory.
    """
    (n, size), m, u = x.shape[1:], y.shape[1], 2.0**-24
    scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
    x, y, w = x / scale, y / scale, (1 / np.maximum(limit / scale, 1e-3) ** 2)[:, None, None]
    less = 1 - u * (2 * size + 16)
    sx, sy = less * (x**2).sum(axis=2), less * (y**2).sum(axis=2)
    a = np.concatenate([-2 * x * w, sx[..., None] * w, np.broadcast_to(w, (*sx.shape, 1))], axis=2).astype(np.float32).transpose(1, 0, 2).copy()
    b = np.concatenate([y, np.ones((*sy.shape, 1)), sy[..., None]], axis=2).astype(np.float32).transpose(1, 2, 0).copy()
    most = np.float32((n + m - 1) * (1 + 4 * u * (n + m + size + 16)))
    held, at, who = np.empty((m + 4, min(rows, len(x)), len(y)), np.float32), [], []
    for k in range(0, len(x), rows):
        tile = held[:, : len(x) - k]
        i, j = np.nonzero(_least_sums(a[:, k : k + rows], b, tile) <= most)
        at.append(i + k)
        who.append(j)
    return np.concatenate(at), np.concatenate(who)


def _least_sums(a: np.ndarray, b: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The least sums along the paths of dtw_within for frames a (n x rows) and b (m x columns), in memory for m + 4 arrays of rows x columns."""
    # each array with its bits as integers
    (_, zero), (least, bits), *free = [(v, v.view(np.int32)) for v in held]
    zero[:] = 0
    one, row = np.float32(1), []
    for i in range(len(a)):
        diagonal = None
        for j in range(len(b)):
            new = d, own = free.pop()
            np.matmul(a[i], b[j], out=d)
            np.maximum(own, zero, out=own)
            np.sqrt(d, out=d)
            if i and j:
                np.add(diagonal[0], one, out=least)
                np.minimum(bits, row[j][1], out=bits)
                np.minimum(bits, row[j - 1][1], out=bits)
                d += least
            elif i or j:
                d += row[j][0] if i else row[j - 1][0]
            if diagonal is not None:
                free.append(diagonal)
            if i:
                diagonal, row[j] = row[j], new
            else:
                row.append(new)
        if diagonal is not None:
            free.append(diagonal)
    return row[-1][0]


def dtw_limited(x: list[np.ndarray], y: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs of sequences, infinite for those that are ended because all their paths' scores are beyond limit, and how many cells
    each pair filled. Pairs of like lengths are worked on together, cells of an anti-diagonal at once; three diagonals are kept."""
    score, filled = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        alike.setdefault((len(a), len(b)), []).append(k)
    for (n, m), at in alike.items():
        step = max(1, (1 << 22) // (n * m))
        for z in range(0, len(at), step):
            own = np.array(at[z : z + step])
            a, b = np.stack([x[k] for k in own]), np.stack([y[k] for k in own])
            most = limit[own] * (n + m - 1) * (1 + 1e-12)
            # costs and lengths of the last two diagonals, by rows of the grid with a border
            d1, d2 = (np.full((len(own), n + 1), np.inf) for _ in range(2))
            s1, s2 = (np.zeros((len(own), n + 1), dtype=np.int64) for _ in range(2))
            d2[:, 0] = 0.0
            for k in range(2, n + m + 1):
                i = np.arange(max(1, k - m), min(n, k - 1) + 1)
                cost = np.sqrt(((a[:, i - 1] - b[:, k - i - 1]) ** 2).sum(axis=2))
                before = np.stack([d1[:, i - 1], d1[:, i], d2[:, i - 1]])
                which = before.argmin(axis=0)
                now, length = np.full_like(d1, np.inf), np.zeros_like(s1)
                now[:, i] = cost + before.min(axis=0)
                length[:, i] = 1 + np.choose(which, [s1[:, i - 1], s1[:, i], s2[:, i - 1]])
                filled[own] += len(i)
                d2, d1, s2, s1 = d1, now, s1, length
                # a path goes through one of two neighbouring diagonals
                if k % 4 == 0 and k < n + m:
                    keep = np.minimum(d1.min(axis=1), d2.min(axis=1)) <= most
                    if not keep.all():
                        own, a, b, most, d1, d2, s1, s2 = (v[keep] for v in (own, a, b, most, d1, d2, s1, s2))
                        if not len(own):
                            break
            if len(own):
                score[own] = d1[:, n] / s1[:, n]
    return score, filled
