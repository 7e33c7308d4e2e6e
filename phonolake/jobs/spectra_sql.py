"""SQL for spectra, cepstra, enhancement and sequence models: sums over bins and samples that DuckDB works out by itself."""

from __future__ import annotations

import numpy as np

from phonolake.jobs.frame_queries import SEQUENCES_SQL
from phonolake.jobs.inputs import FS, SAMPLES_SQL

#: Levels are rounded to six places.
DB = "greatest(20 * log10({m} + 1e-15), -120)"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of numbers; whole ones stay whole."""
    cell = lambda v: str(v) if isinstance(v, int) else f"{float(v)!r}::DOUBLE"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def taps(name: str, count: int, edge: float) -> str:
    """A Hamming-windowed low-pass (i, b) with its edge as a share of half the rate, its sum being 1."""
    half = (count - 1) // 2
    return f"""{name} AS (SELECT i, h / sum(h) OVER () AS b FROM (
  SELECT i, CASE WHEN i = {half} THEN {edge}::DOUBLE ELSE sin(pi() * {edge} * (i - {half})) / (pi() * (i - {half})) END * (0.54 - 0.46 * cos(2 * pi() * i / {count - 1})) AS h FROM range({count}) AS r(i)))"""


def mel_bank(name: str, nfft: int, n_mels: int, fs: int, fmin: float = 0.0) -> str:
    """Triangles (m, k, w) with their corners at bins of evenly spaced mels; only what is not zero."""
    lo, hi = f"1125 * ln(1 + {fmin}::DOUBLE / 700)", f"1125 * ln(1 + {fs / 2}::DOUBLE / 700)"
    return f"""{name}_f AS (SELECT j, 700 * (exp(({lo} + j * (({hi} - {lo}) / {n_mels + 1})) / 1125) - 1) AS f FROM range({n_mels + 2}) AS r(j)),
{name}_c AS (SELECT j, floor(round({nfft + 1} * f / {fs}, 9)) AS b FROM {name}_f),
{name}_t AS (SELECT x.j AS m, k, x.b AS lo, y.b AS mid, z.b AS hi FROM {name}_c x JOIN {name}_c y ON y.j = x.j + 1 JOIN {name}_c z ON z.j = x.j + 2, range({nfft // 2 + 1}) AS r(k)),
{name} AS (SELECT m, k, w FROM (SELECT m, k, CASE WHEN k >= lo AND k < mid THEN (k - lo) / (mid - lo + 1e-10) WHEN k >= mid AND k < hi THEN (hi - k) / (hi - mid + 1e-10) ELSE 0 END AS w FROM {name}_t) WHERE w <> 0)"""


def slaney_bank(name: str, nfft: int, n_mels: int, fs: int) -> str:
    """Triangles (m, k, w) of equal area on a scale that is linear up to 1 kHz and logarithmic above."""
    top = f"CASE WHEN {fs / 2} < 1000 THEN {fs / 2}::DOUBLE * 3 / 200 ELSE 15 + ln({fs / 2}::DOUBLE / 1000) / (ln(6.4) / 27) END"
    return f"""{name}_m AS (SELECT j, j * ({top}) / {n_mels + 1} AS mel FROM range({n_mels + 2}) AS r(j)),
{name}_f AS (SELECT j, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(6.4) / 27) END AS f FROM {name}_m),
{name}_t AS (SELECT x.j AS m, k, k * {fs}::DOUBLE / {nfft} AS v, x.f AS lo, y.f AS mid, z.f AS hi FROM {name}_f x JOIN {name}_f y ON y.j = x.j + 1 JOIN {name}_f z ON z.j = x.j + 2, range({nfft // 2 + 1}) AS r(k)),
{name} AS (SELECT m, k, w FROM (SELECT m, k, greatest(0, least((v - lo) / (mid - lo), (hi - v) / (hi - mid))) * 2 / (hi - lo) AS w FROM {name}_t) WHERE w <> 0)"""


def stft(src: str, p: str, nfft: int, size: int, hop: int, x: str = "x") -> str:
    """src (rec_id, n, x) -> {p}len (rec_id, len), {p}s (rec_id, t, k, re, im): centred frames under a periodic Hann window in their middle."""
    a = (nfft - size) // 2
    return f"""{p}len AS (SELECT rec_id, max(n) + 1 AS len FROM {src} GROUP BY rec_id),
{p}fi AS (SELECT rec_id, unnest(range(0, len // {hop} + 1))::INTEGER AS t FROM {p}len),
{p}fr AS (SELECT f.rec_id, t, n - t * {hop} + {nfft // 2} AS i, {x} AS x FROM {p}fi f JOIN {src} s ON s.rec_id = f.rec_id AND n BETWEEN t * {hop} - {nfft // 2 - a} AND t * {hop} - {nfft // 2 - a} + {size - 1}),
{p}w AS (SELECT rec_id, t, i, x * (0.5 - 0.5 * cos(2 * pi() * (i - {a}) / {size})) AS y FROM {p}fr),
{p}s AS (SELECT rec_id, t, k::INTEGER AS k, sum(y * cos(2 * pi() * k * i / {nfft})) AS re, -sum(y * sin(2 * pi() * k * i / {nfft})) AS im FROM {p}w, range({nfft // 2 + 1}) AS r(k) GROUP BY ALL)"""


def istft(src: str, lengths: str, p: str, nfft: int, size: int, hop: int) -> str:
    """src (rec_id, t, k, re, im) and lengths (rec_id, len) -> {p}y (rec_id, n, x): overlap-add over the windows' squares."""
    a, half = (nfft - size) // 2, nfft // 2
    return f"""{p}win AS (SELECT i, CASE WHEN i BETWEEN {a} AND {a + size - 1} THEN 0.5 - 0.5 * cos(2 * pi() * (i - {a}) / {size}) ELSE 0 END AS w FROM range({nfft}) AS r(i)),
{p}f AS (SELECT rec_id, t, i, w, w * sum(CASE WHEN k IN (0, {half}) THEN re * cos(2 * pi() * k * i / {nfft}) ELSE 2 * (re * cos(2 * pi() * k * i / {nfft}) - im * sin(2 * pi() * k * i / {nfft})) END) / {nfft} AS y
  FROM {src}, {p}win GROUP BY rec_id, t, i, w),
{p}o AS (SELECT rec_id, t * {hop} + i - {half} AS n, sum(y) AS y, sum(w * w) AS norm FROM {p}f GROUP BY 1, 2),
{p}all AS (SELECT rec_id, len, unnest(range(0, len))::BIGINT AS n FROM {lengths}),
{p}y AS (SELECT g.rec_id, g.n, coalesce(CASE WHEN norm > 1e-11 THEN y / norm ELSE y END, 0) AS x FROM {p}all g LEFT JOIN {p}o o ON o.rec_id = g.rec_id AND o.n = g.n)"""


def spectrum(src: str, p: str, nfft: int) -> str:
    """src (rec_id, n, x) -> {p}q (rec_id, k, mag): the whole recording under a Hamming window of its length, one-sided."""
    return f"""{p}rep AS (SELECT rec_id, count(*) AS len FROM {src} GROUP BY rec_id),
{p}ww AS (SELECT s.rec_id, n, x, len, 0.54 - 0.46 * cos(2 * pi() * n / (len - 1)) AS w FROM {src} s JOIN {p}rep USING (rec_id) WHERE n < {nfft}),
{p}cg AS (SELECT rec_id, avg(0.54 - 0.46 * cos(2 * pi() * i / (len - 1))) AS cg FROM (SELECT rec_id, len, unnest(range(0, len)) AS i FROM {p}rep) GROUP BY rec_id),
{p}fq AS (SELECT rec_id, k, len, sum(x * w * cos(2 * pi() * k * n / {nfft})) AS re, sum(x * w * sin(2 * pi() * k * n / {nfft})) AS im FROM {p}ww, range({nfft // 2 + 1}) AS r(k) GROUP BY ALL),
{p}q AS (SELECT rec_id, k::INTEGER AS k, sqrt(re * re + im * im) / (len * cg) * CASE WHEN k IN (0, {nfft // 2}) THEN 1 ELSE 2 END AS mag FROM {p}fq JOIN {p}cg USING (rec_id))"""


def log_mel(src: str, p: str, size: int, hop: int, nfft: int, n_mels: int, fmin: float = 0.0) -> str:
    """src (rec_id, n, x) -> {p}lm (rec_id, t, m, v): pre-emphasis, Hamming frames, power, triangles, logarithm. Recordings have size samples or more."""
    return f"""{mel_bank(p + "bank", nfft, n_mels, FS, fmin)}, {p}pe AS (SELECT rec_id, n, x - 0.97 * coalesce(lag(x) OVER (PARTITION BY rec_id ORDER BY n), 0) AS x FROM {src}),
{p}fi AS (SELECT rec_id, unnest(range(0, greatest(1, 1 + (count(*) - {size}) // {hop})))::INTEGER AS t FROM {src} GROUP BY rec_id),
{p}fr AS (SELECT f.rec_id, t, n - t * {hop} AS i, x * (0.54 - 0.46 * cos(2 * pi() * (n - t * {hop}) / {size - 1})) AS y FROM {p}fi f JOIN {p}pe s ON s.rec_id = f.rec_id AND n BETWEEN t * {hop} AND t * {hop} + {size - 1}),
{p}ft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * i / {nfft})) AS re, sum(y * sin(2 * pi() * k * i / {nfft})) AS im FROM {p}fr, range({nfft // 2 + 1}) AS r(k) GROUP BY ALL),
{p}pw AS (SELECT rec_id, t, k, (re * re + im * im) / {nfft} AS p FROM {p}ft),
{p}bd AS (SELECT rec_id, t, m, sum(w * p) AS e FROM {p}pw JOIN {p}bank USING (k) GROUP BY ALL),
{p}lm AS (SELECT f.rec_id, f.t, r.m::INTEGER AS m, ln(coalesce(e, 0) + 1e-10) AS v FROM {p}fi f CROSS JOIN range({n_mels}) AS r(m) LEFT JOIN {p}bd b ON b.rec_id = f.rec_id AND b.t = f.t AND b.m = r.m)"""


def dct(src: str, p: str, n: int, size: int, ortho: bool = False) -> str:
    """src (rec_id, t, m, v) -> {p}c (rec_id, t, dim, v)."""
    scale = f" * CASE WHEN j = 0 THEN sqrt(1 / {size}) ELSE sqrt(2 / {size}) END" if ortho else ""
    return f"{p}c AS (SELECT rec_id, t, j::INTEGER AS dim, sum(v * cos(pi() * (m + 0.5) * j / {size})){scale} AS v FROM {src}, range({n}) AS r(j) GROUP BY rec_id, t, j)"


def delta(src: str, name: str) -> str:
    near = "(1 * (coalesce(lead(v, 1) OVER w, last_value(v) OVER e) - coalesce(lag(v, 1) OVER w, first_value(v) OVER e)) + 2 * (coalesce(lead(v, 2) OVER w, last_value(v) OVER e) - coalesce(lag(v, 2) OVER w, first_value(v) OVER e))) / (10 + 1e-10)"
    windows = "WINDOW w AS (PARTITION BY rec_id, dim ORDER BY t), e AS (PARTITION BY rec_id, dim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"{name} AS (SELECT rec_id, t, dim, {near} AS v FROM {src} {windows})"


_LONG = "rec_id, t AS frame_idx, {dim} AS dim, round(v, 6) + 0.0 AS v"

LOG_MEL = f"WITH {SAMPLES_SQL}, {log_mel('sig', 'a', 16, 8, 64, 8)} SELECT {_LONG.format(dim='m')} FROM alm"
MFCC = f"""WITH {SAMPLES_SQL}, {log_mel('sig', 'a', 16, 8, 64, 8)}, {dct('alm', 'b', 8, 8)},
c AS (SELECT rec_id, t, dim, CASE WHEN count(*) OVER s > 1 THEN v - avg(v) OVER s ELSE v END AS v FROM bc WINDOW s AS (PARTITION BY rec_id, dim)) SELECT {_LONG.format(dim='dim')} FROM c"""

FEATURE_39 = f"""WITH {SAMPLES_SQL}, efi AS (SELECT rec_id, count(*) AS len, unnest(range(0, greatest(1, 1 + (count(*) - 16) // 8)))::INTEGER AS t FROM sig GROUP BY rec_id),
ee AS (SELECT f.rec_id, t, len, 10 * log10(sum(pow(x * (0.54 - 0.46 * cos(2 * pi() * (n - t * 8) / 15)), 2)) + 1e-10) AS e FROM efi f JOIN sig s ON s.rec_id = f.rec_id AND n BETWEEN t * 8 AND t * 8 + 15 GROUP BY ALL),
el AS (SELECT *, e >= max(e) OVER (PARTITION BY rec_id) - 30 AS loud FROM ee),
eb AS (SELECT rec_id, greatest(min(t) FILTER (WHERE loud) - 4, 0) * 8 AS a, least((least(max(t) FILTER (WHERE loud) + 4, max(t)) + 1) * 8 + 16, max(len)) AS z FROM el GROUP BY rec_id),
cut AS (SELECT rec_id, n - a AS n, x FROM sig JOIN eb USING (rec_id) WHERE n >= a AND n < z),
{log_mel('cut', 'a', 16, 8, 64, 26, 20.0)}, {dct('alm', 'b', 13, 26)}, {delta('bc', 'd1')}, {delta('d1', 'd2')},
f AS (SELECT rec_id, t, dim, v FROM bc UNION ALL SELECT rec_id, t, dim + 13, v FROM d1 UNION ALL SELECT rec_id, t, dim + 26, v FROM d2),
c AS (SELECT rec_id, t, dim, (v - avg(v) OVER s) / (stddev_pop(v) OVER s + 1e-8) AS v FROM f WINDOW s AS (PARTITION BY rec_id, dim)) SELECT {_LONG.format(dim='dim')} FROM c"""


def _bands(n_mels: int) -> str:
    return f"""{SAMPLES_SQL}, {stft('sig', 'z', 64, 32, 8)}, {slaney_bank('bank', 64, n_mels, FS)},
e AS (SELECT rec_id, t, m, sum(w * (re * re + im * im)) AS e FROM zs JOIN bank USING (k) GROUP BY ALL),
g AS (SELECT f.rec_id, f.t, r.m::INTEGER AS m, 10 * log10(greatest(coalesce(e, 0), 1e-10)) AS v FROM zfi f CROSS JOIN range({n_mels}) AS r(m) LEFT JOIN e ON e.rec_id = f.rec_id AND e.t = f.t AND e.m = r.m)"""


MEL_DB = f"WITH {_bands(8)}, h AS (SELECT rec_id, t, m, greatest(v - max(v) OVER (PARTITION BY rec_id), -80) AS v FROM g) SELECT {_LONG.format(dim='m')} FROM h"
MFCC_LIBRARY = f"WITH {_bands(16)}, h AS (SELECT rec_id, t, m, greatest(v, max(v) OVER (PARTITION BY rec_id) - 80) AS v FROM g), {dct('h', 'b', 8, 16, True)} SELECT {_LONG.format(dim='dim')} FROM bc"

LOG_SPECTROGRAM = f"""WITH {SAMPLES_SQL}, {stft('sig', 'z', 16, 16, 8)}, d AS (SELECT f.rec_id, f.t, r.k::INTEGER AS k, 20 * log10(greatest(coalesce(sqrt(re * re + im * im), 0), 1e-8)) AS db
  FROM zfi f CROSS JOIN range(9) AS r(k) LEFT JOIN zs s ON s.rec_id = f.rec_id AND s.t = f.t AND s.k = r.k)
SELECT rec_id, t AS frame_idx, k, round(db - max(db) OVER (PARTITION BY rec_id), 6) + 0.0 AS db FROM d"""
NOISE_PSD = f"WITH {SAMPLES_SQL}, {stft('sig', 'z', 32, 24, 8)} SELECT rec_id, k, round(avg(re * re + im * im), 6) + 0.0 AS p FROM zs GROUP BY rec_id, k"


def _enhanced(noisy: str) -> str:
    """noisy: tables up to noise_rec (rec_id, n, x) and loud (rec_id, n, x)."""
    return f"""{noisy}, {stft('noise_rec', 'v', 32, 24, 8)}, psd AS (SELECT k, avg(re * re + im * im) AS p FROM vs GROUP BY k), {stft('loud', 'y', 32, 24, 8)},
gains AS (SELECT method, s.rec_id, t, k, re, im, CASE WHEN method = 'wiener' THEN greatest(re * re + im * im - p, 0) / (greatest(re * re + im * im - p, 0) + p + 1e-12)
  ELSE sqrt(greatest(re * re + im * im - 1.5 * p, 0.02 * p)) / sqrt(re * re + im * im) END AS g FROM ys s JOIN psd USING (k), (VALUES ('subtract'), ('wiener')) AS m(method)),
kept AS (SELECT {{key}} AS rec_id, t, k, g * re AS re, g * im AS im FROM gains {{where}})"""


_NOISY = """{samples}, v AS (SELECT n, x AS v FROM sig WHERE rec_id = (SELECT min(rec_id) FROM sig)), noise_rec AS (SELECT 0 AS rec_id, n, v AS x FROM v), vn AS (SELECT max(n) + 1 AS len FROM v),
tt AS (SELECT rec_id, sig.n, x, v FROM sig, vn JOIN v ON v.n = sig.n % vn.len), pp AS (SELECT rec_id, avg(x * x) AS ps, avg(v * v) AS pv FROM tt GROUP BY rec_id),
dirty AS (SELECT tt.rec_id, snr, n, x, x + sqrt((ps + 1e-12) / ((pv + 1e-12) * pow(10, snr / 10))) * v AS y FROM tt JOIN pp USING (rec_id), (VALUES {snrs}) AS s(snr)),
loud AS (SELECT rec_id * 100 + snr::INTEGER AS rec_id, n, y AS x FROM dirty)""".replace("{samples}", SAMPLES_SQL)


def enhanced(method: str) -> str:
    head = _enhanced(_NOISY.format(snrs="(5.0::DOUBLE)")).format(key="rec_id", where=f"WHERE method = '{method}'")
    return f"WITH {head}, {istft('kept', 'ylen', 'o', 32, 24, 8)} SELECT (rec_id // 100)::BIGINT AS rec_id, n, round(x, 6) + 0.0 AS x FROM oy"


REPORT = f"""WITH {_enhanced(_NOISY.format(snrs="(0.0::DOUBLE), (5.0), (10.0)")).format(key="rec_id * 10 + (method = 'wiener')::INTEGER", where="")},
both_len AS (SELECT rec_id * 10 + w AS rec_id, len FROM ylen, (VALUES (0), (1)) AS m(w)), {istft('kept', 'both_len', 'o', 32, 24, 8)},
a AS (SELECT rec_id, snr, 10 * log10(sum(x * x) / (sum((y - x) * (y - x)) + 1e-12)) AS snr_in FROM dirty GROUP BY rec_id, snr),
b AS (SELECT d.rec_id, snr, o.rec_id % 10 AS w, 10 * log10(sum(d.x * d.x) / (sum((o.x - d.x) * (o.x - d.x)) + 1e-12)) AS snr_out FROM dirty d JOIN oy o ON o.rec_id // 10 = d.rec_id * 100 + snr::INTEGER AND o.n = d.n GROUP BY ALL)
SELECT snr, CASE w WHEN 1 THEN 'wiener' ELSE 'subtract' END AS method, round(avg(snr_in), 6) + 0.0 AS snr_in, round(avg(snr_out), 6) AS snr_out, round(avg(snr_out - snr_in), 6) + 0.0 AS gain FROM a JOIN b USING (rec_id, snr) GROUP BY snr, w"""


def stretched(rate: float, nfft: int, hop: int) -> str:
    """Tables up to uy (rec_id, n, x): the phase vocoder, whose phases are sums of measured advances."""
    at = f"(j * {rate!r}::DOUBLE)"
    return f"""{SAMPLES_SQL}, {stft('sig', 'z', nfft, nfft, hop)}, n_fr AS (SELECT rec_id, len, len // {hop} + 1 AS frames, round_even(len / {rate!r}::DOUBLE, 0)::BIGINT AS out FROM zlen),
pad AS (SELECT rec_id, t, k, re, im FROM zs UNION ALL SELECT rec_id, frames + e, k, 0, 0 FROM n_fr, range(2) AS q(e), range({nfft // 2 + 1}) AS r(k)),
pol AS (SELECT rec_id, t::BIGINT AS t, k, sqrt(re * re + im * im) AS mag, atan2(im, re) AS ang FROM pad),
steps AS (SELECT rec_id, j, floor({at})::BIGINT AS t, {at} - floor({at}) AS f FROM (SELECT rec_id, frames, unnest(range(0, ceil(frames / {rate!r}::DOUBLE)::BIGINT)) AS j FROM n_fr) WHERE {at} < frames),
two AS (SELECT s.rec_id, j, a.k, (1 - f) * a.mag + f * b.mag AS mag, b.ang - a.ang AS go, c.ang AS first FROM steps s JOIN pol a ON a.rec_id = s.rec_id AND a.t = s.t JOIN pol b ON b.rec_id = s.rec_id AND b.t = s.t + 1 AND b.k = a.k
  JOIN pol c ON c.rec_id = s.rec_id AND c.t = 0 AND c.k = a.k),
ph AS (SELECT rec_id, j, k, mag, first + coalesce(sum(go) OVER (PARTITION BY rec_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ph FROM two),
new AS (SELECT rec_id, j AS t, k, mag * cos(ph) AS re, mag * sin(ph) AS im FROM ph), new_len AS (SELECT rec_id, out AS len FROM n_fr), {istft('new', 'new_len', 'u', nfft, nfft, hop)}"""


TIME_STRETCH = f"WITH {stretched(0.8, 64, 16)} SELECT rec_id, count(*)::INTEGER AS n, round(sum(x * x), 6) AS energy FROM uy GROUP BY rec_id"


PITCH_SHIFT = f"""WITH {stretched(2.0 ** (-2.0 / 12), 512, 128)}, pos AS (SELECT rec_id, len AS n, out, unnest(range(0, len)) * (out - 1)::DOUBLE / greatest(len - 1, 1) AS p FROM n_fr),
lo AS (SELECT a.rec_id, a.n, p, x AS a, least(floor(p)::BIGINT + 1, out - 1) AS next FROM pos a JOIN uy ON uy.rec_id = a.rec_id AND uy.n = floor(p)::BIGINT)
SELECT lo.rec_id, lo.n::INTEGER AS n, round(sum(pow(a + (p - floor(p)) * (uy.x - a), 2)), 6) AS energy FROM lo JOIN uy ON uy.rec_id = lo.rec_id AND uy.n = next GROUP BY lo.rec_id, lo.n"""

# windows are symmetric, so that bins from the middle on tell all
WINDOW_PROPERTIES = f"""WITH {SAMPLES_SQL}, sizes AS (SELECT DISTINCT size FROM (SELECT count(*)::INTEGER AS size FROM sig GROUP BY rec_id)), pos AS (SELECT size, unnest(range(0, size)) AS i FROM sizes),
w AS (SELECT name, size, i, CASE name WHEN 'rectangular' THEN 1.0::DOUBLE WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * i / (size - 1)) WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * i / (size - 1))
  WHEN 'blackman' THEN 0.42 - 0.5 * cos(2 * pi() * i / (size - 1)) + 0.08 * cos(4 * pi() * i / (size - 1)) ELSE 1 - abs(2 * i::DOUBLE / (size - 1) - 1) END AS w FROM pos, (VALUES ('rectangular'), ('hamming'), ('hann'), ('blackman'), ('bartlett')) AS n(name)),
p AS (SELECT name, size, avg(w) AS cg, avg(w * w) AS ms, sum(w) AS top FROM w GROUP BY name, size),
turn AS (SELECT k, cos(2 * pi() * k / 8192) AS c, sin(2 * pi() * k / 8192) AS s FROM range(8192) AS r(k)),
s AS (SELECT name, size, r.k, sqrt(pow(sum(w * c), 2) + pow(sum(w * s), 2)) AS m FROM w, range(4097) AS r(k) JOIN turn ON turn.k = (r.k * i) % 8192 GROUP BY name, size, r.k),
db AS (SELECT name, size, k, 20 * log10(m / top + 1e-12) AS db FROM s JOIN p USING (name, size)), h AS (SELECT name, size, max(k) AS h FROM db WHERE db >= -3 GROUP BY name, size),
side AS (SELECT name, size, max(db) AS side FROM db JOIN h USING (name, size) WHERE k >= h + 5 GROUP BY name, size)
SELECT name, size, round(cg, 6) AS coherent_gain, round(ms, 6) AS mean_square, round(ms / (cg * cg), 6) AS enbw, round(2 * h * size / 8192, 6) AS main_lobe_bins, round(side, 6) AS side_lobe_db FROM p JOIN h USING (name, size) JOIN side USING (name, size)"""


def _resampled(src: int, dst: int) -> str:
    g = int(np.gcd(src, dst))
    up, down = dst // g, src // g
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) / max(up, down) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    return f"""{SAMPLES_SQL}, {values('taps', 'i, h', [(int(k), float(v)) for k, v in zip(n, h, strict=True)])}, rl AS (SELECT rec_id, count(*) AS len FROM sig GROUP BY rec_id),
ro AS (SELECT rec_id, unnest(range(0, (len * {up} + {down - 1}) // {down})) AS n FROM rl),
res AS (SELECT o.rec_id, o.n, least(greatest(sum(h * x), -1), 1) AS x FROM ro o JOIN sig s ON s.rec_id = o.rec_id JOIN taps ON i = o.n * {down} - s.n * {up} GROUP BY o.rec_id, o.n)"""


RESAMPLE = f"WITH {_resampled(FS, 40)} SELECT rec_id, n, round(x, 6) + 0.0 AS x FROM res"
RESAMPLE_SPECTRUM = f"WITH {_resampled(FS, 40)}, {spectrum('res', 'a', 64)} SELECT rec_id, k, k * 40 / 64 AS f_hz, round({DB.format(m='mag')}, 6) AS mag_db FROM aq"


def filter_attenuation(filtered: str) -> str:
    """filtered: tables up to flt (rec_id, n, x), after those of sig."""
    return f"""WITH {filtered}, {spectrum('sig', 'a', 128)}, {spectrum('flt', 'b', 128)}
SELECT rec_id, k, k * {FS} / 128 AS f_hz, round({DB.format(m='aq.mag')}, 6) AS before_db, round({DB.format(m='bq.mag')}, 6) AS after_db, round({DB.format(m='aq.mag')} - {DB.format(m='bq.mag')}, 6) + 0.0 AS attenuation_db FROM aq JOIN bq USING (rec_id, k)"""


COMPARE_NFFT = f"""WITH clip AS (SELECT vec_id AS rec_id, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS x FROM embeddings), {spectrum('clip', 'a', 64)}, {spectrum('clip', 'b', 256)},
u AS (SELECT rec_id, k, mag, 64 AS nfft FROM aq UNION ALL SELECT rec_id, k, mag, 256 FROM bq)
SELECT rec_id, k, k * {FS} / nfft AS f_hz, round(mag, 6) AS mag, round({DB.format(m='mag')}, 6) AS mag_db, round(greatest(10 * log10(mag * mag + 1e-15), -120), 6) AS power_db, {FS} / nfft AS delta_f, {FS / 64}::DOUBLE AS true_res, nfft FROM u"""


def dtw(pairs: str, path: bool = False) -> str:
    """pairs (pid, a, b: lists of 8 vectors) -> done (pid, cost, path_length). Cells are worked out row by row; each step appends one."""
    c = "list_distance(a[(c - 1) // 8 + 1], b[(c - 1) % 8 + 1])"
    up, left, diag = "CASE WHEN c > 8 THEN d[c - 8] ELSE big END", "CASE WHEN (c - 1) % 8 > 0 THEN d[c - 1] ELSE big END", "CASE WHEN c = 1 THEN 0 WHEN c > 8 AND (c - 1) % 8 > 0 THEN d[c - 9] ELSE big END"
    least = f"least({up}, {left}, {diag})"
    steps = f"CASE WHEN c = 1 THEN 0 WHEN {up} <= {left} AND {up} <= {diag} THEN s[c - 8] WHEN {left} <= {diag} THEN s[c - 1] ELSE s[c - 9] END"
    came = steps.replace("THEN 0 WHEN", "THEN '' WHEN").replace("s[", "p[")
    more = ("", "", "") if not path else (", []::VARCHAR[] AS p", f", list_append(p, {came} || ' ' || ((c - 1) // 8) || ',' || ((c - 1) % 8))", ", ltrim(p[64]) AS path")
    return f"""walk AS (SELECT pid, 1 AS c, []::DOUBLE[] AS d, []::INTEGER[] AS s, 1e300::DOUBLE AS big{more[0]} FROM {pairs}
  UNION ALL SELECT w.pid, c + 1, list_append(d, {c} + {least}), list_append(s, (1 + {steps})::INTEGER), big{more[1]} FROM walk w JOIN {pairs} x USING (pid) WHERE c <= 64),
done AS (SELECT pid, d[64] AS cost, s[64]::BIGINT AS path_length{more[2]} FROM walk WHERE c = 65)"""


_SEQ = f"""{SEQUENCES_SQL}, frame AS (SELECT rec_id, frame_idx, list(v ORDER BY dim) AS vec FROM seq GROUP BY rec_id, frame_idx), sq AS (SELECT rec_id, list(vec ORDER BY frame_idx) AS s FROM frame GROUP BY rec_id),
numbered AS (SELECT vec_id AS rec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 7 AS m FROM embeddings),
lab AS (SELECT rec_id, 'w' || label AS label, CASE WHEN m BETWEEN 1 AND 4 THEN 'enroll' WHEN m = 5 THEN 'dev' ELSE 'test' END AS role, s FROM numbered JOIN sq USING (rec_id))"""
DTW = f"""WITH RECURSIVE {_SEQ}, pairs AS (SELECT x.rec_id AS pid, x.s AS a, y.s AS b FROM sq x JOIN sq y ON y.rec_id = x.rec_id + 1), {dtw('pairs', True)}
SELECT pid AS rec_id, round(cost, 6) AS cost, path_length, round(cost / path_length, 6) AS score, path FROM done"""
DTW_RECOGNIZE = f"""WITH RECURSIVE {_SEQ}, pairs AS (SELECT row_number() OVER () AS pid, x.rec_id, x.label AS truth, y.label, x.s AS a, y.s AS b FROM lab x, lab y WHERE x.role = 'test' AND y.role = 'enroll'), {dtw('pairs')},
best AS (SELECT rec_id, truth, label, min(cost / path_length) AS score FROM done JOIN pairs USING (pid) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score, label) AS k FROM best)
SELECT rec_id, truth, max(label) FILTER (WHERE k = 1) AS top1_label, round(max(score) FILTER (WHERE k = 1), 6) AS top1_score, max(label) FILTER (WHERE k = 2) AS top2_label, round(max(score) FILTER (WHERE k = 2), 6) AS top2_score FROM r GROUP BY rec_id, truth"""


def first_models(floor: float = 1e-4) -> str:
    """Tables up to e3 (rec_id, frame_idx, label, b0, b1, b2): three states, means from evenly spaced frames of the enrolled sequences, one variance."""
    return f"""{_SEQ}, fr AS (SELECT label, l.rec_id, frame_idx, vec, row_number() OVER (PARTITION BY label ORDER BY l.rec_id, frame_idx) - 1 AS place, count(*) OVER (PARTITION BY label) AS total FROM lab l JOIN frame f ON f.rec_id = l.rec_id WHERE role = 'enroll'),
mean AS (SELECT label, state::INTEGER AS state, vec FROM fr, range(3) AS r(state) WHERE place = floor((total - 1) * state / 2)),
spread AS (SELECT label, avg(v) + {floor!r}::DOUBLE AS var FROM (SELECT label, dim, var_pop(v) AS v FROM seq JOIN lab USING (rec_id) WHERE role = 'enroll' GROUP BY label, dim) GROUP BY label),
em AS (SELECT f.rec_id, f.frame_idx, m.label, m.state, -0.5 * (8 * ln(2 * pi()) + list_sum(list_transform(list_zip(f.vec, m.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / var + ln(var)))) AS b FROM frame f, mean m JOIN spread USING (label)),
e3 AS (SELECT rec_id, frame_idx, label, max(b) FILTER (WHERE state = 0) AS b0, max(b) FILTER (WHERE state = 1) AS b1, max(b) FILTER (WHERE state = 2) AS b2 FROM em GROUP BY ALL)"""


_FIRST = first_models()
FIRST_MODELS = f"WITH {_FIRST} SELECT label, state, CASE WHEN state = 0 THEN 1.0::DOUBLE ELSE 0 END AS pi, i::INTEGER AS dim, round(vec[i + 1], 6) + 0.0 AS mean, round(var, 6) AS var FROM mean JOIN spread USING (label), range(8) AS r(i)"
_LN = lambda x: f"ln({x} + 1e-300)"
_ADD = "greatest({a}, {b}) + ln(1 + exp(least({a}, {b}) - greatest({a}, {b})))"
EMISSION = f"WITH {_FIRST} SELECT rec_id, frame_idx, label, state, round(b, 6) + 0.0 AS log_b FROM em"
_FORWARD = f"""{_FIRST}, f AS (SELECT rec_id, label, 0 AS t, {_LN('1.0')} + b0 AS f0, {_LN('0.0')} + b1 AS f1, {_LN('0.0')} + b2 AS f2 FROM e3 WHERE frame_idx = 0
  UNION ALL SELECT f.rec_id, f.label, t + 1, f0 + ln(0.7) + b0, {_ADD.format(a='(f1 + ln(0.7))', b='(f0 + ln(0.3))')} + b1, {_ADD.format(a='(f2 + ln(1.0))', b='(f1 + ln(0.3))')} + b2 FROM f JOIN e3 e ON e.rec_id = f.rec_id AND e.label = f.label AND e.frame_idx = t + 1),
g AS (SELECT rec_id, label, {_ADD.format(a='f1', b='f2')} AS h, f0 FROM f WHERE t = 7), sc AS (SELECT rec_id, label, {_ADD.format(a='h', b='f0')} AS score FROM g)"""
FORWARD = f"WITH RECURSIVE {_FORWARD} SELECT rec_id, label, round(score, 6) AS score FROM sc"
SCORE_TABLE = f"WITH RECURSIVE {_FORWARD} SELECT sc.rec_id, {', '.join(f"round(max(score) FILTER (WHERE sc.label = 'w{k}'), 6) AS w{k}" for k in range(10))} FROM sc JOIN lab USING (rec_id) WHERE role = 'test' GROUP BY sc.rec_id"
RECOGNIZE = f"""WITH RECURSIVE {_FORWARD}, r AS (SELECT sc.rec_id, lab.label AS truth, sc.label, score, row_number() OVER (PARTITION BY sc.rec_id ORDER BY score DESC, sc.label) AS k FROM sc JOIN lab USING (rec_id) WHERE role = 'test')
SELECT rec_id, truth, max(label) FILTER (WHERE k = 1) AS top1_label, round(max(score) FILTER (WHERE k = 1), 6) AS top1_score, max(label) FILTER (WHERE k = 2) AS top2_label, round(max(score) FILTER (WHERE k = 2), 6) AS top2_score FROM r GROUP BY rec_id, truth"""


def em_step(loop: float, floor: float) -> str:
    """One step of Baum-Welch from the first models: forward and backward along the eight frames, and what they add up to for each label."""
    stay, go = f"ln({loop}::DOUBLE)", f"ln({1 - loop!r}::DOUBLE)"
    g = [f"exp(f{s} + r{s} - ll)" for s in range(3)]
    return f"""WITH RECURSIVE {first_models(floor)}, o AS (SELECT e.rec_id, e.label, frame_idx AS t, b0, b1, b2 FROM e3 e JOIN lab ON lab.rec_id = e.rec_id AND lab.label = e.label WHERE role = 'enroll'),
f AS (SELECT rec_id, t, {_LN('1.0')} + b0 AS f0, {_LN('0.0')} + b1 AS f1, {_LN('0.0')} + b2 AS f2 FROM o WHERE t = 0 UNION ALL
  SELECT f.rec_id, o.t, f0 + {stay} + b0, {_ADD.format(a=f'(f1 + {stay})', b=f'(f0 + {go})')} + b1, {_ADD.format(a='f2', b=f'(f1 + {go})')} + b2 FROM f JOIN o ON o.rec_id = f.rec_id AND o.t = f.t + 1),
r AS (SELECT rec_id, t, 0::DOUBLE AS r0, 0::DOUBLE AS r1, 0::DOUBLE AS r2 FROM o WHERE t = 7 UNION ALL
  SELECT r.rec_id, r.t - 1, {_ADD.format(a=f'({stay} + b0 + r0)', b=f'({go} + b1 + r1)')}, {_ADD.format(a=f'({stay} + b1 + r1)', b=f'({go} + b2 + r2)')}, b2 + r2 FROM r JOIN o ON o.rec_id = r.rec_id AND o.t = r.t WHERE r.t > 0),
en AS (SELECT rec_id, {_ADD.format(a='f1', b='f2')} AS h, f0 FROM f WHERE t = 7), lls AS (SELECT rec_id, {_ADD.format(a='h', b='f0')} AS ll FROM en),
al AS (SELECT o.*, f0, f1, f2, r0, r1, r2, ll FROM o JOIN f ON f.rec_id = o.rec_id AND f.t = o.t JOIN r ON r.rec_id = o.rec_id AND r.t = o.t JOIN lls ON lls.rec_id = o.rec_id),
gm AS (SELECT rec_id, label, t, {g[0]} / ({' + '.join(g)}) AS g0, {g[1]} / ({' + '.join(g)}) AS g1, {g[2]} / ({' + '.join(g)}) AS g2 FROM al),
xi AS (SELECT a.label, sum(exp(a.f0 + {stay} + b.b0 + b.r0 - a.ll)) AS x00, sum(exp(a.f0 + {go} + b.b1 + b.r1 - a.ll)) AS x01, sum(exp(a.f1 + {stay} + b.b1 + b.r1 - a.ll)) AS x11, sum(exp(a.f1 + {go} + b.b2 + b.r2 - a.ll)) AS x12
  FROM al a JOIN al b ON b.rec_id = a.rec_id AND b.t = a.t + 1 GROUP BY a.label),
gs AS (SELECT rec_id, label, t, s, CASE s WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS g FROM gm, range(3) AS q(s)),
pi AS (SELECT label, s, sum(g) / sum(sum(g)) OVER (PARTITION BY label) AS pi FROM gs WHERE t = 0 GROUP BY label, s),
mv AS (SELECT gs.label, s, dim, sum(g * v) / sum(g) AS mean, greatest(sum(g * (v - vec[dim + 1]) * (v - vec[dim + 1])) / sum(g), {floor!r}) AS var FROM gs JOIN seq ON seq.rec_id = gs.rec_id AND seq.frame_idx = gs.t JOIN mean m ON m.label = gs.label AND m.state = s GROUP BY gs.label, s, dim),
l AS (SELECT label, sum(ll) AS ll FROM lls JOIN lab USING (rec_id) GROUP BY label)
SELECT label, s::INTEGER AS state, dim, round(pi, 6) + 0.0 AS pi, round(CASE s WHEN 0 THEN x00 / (x00 + x01) WHEN 1 THEN x11 / (x11 + x12) ELSE 1 END, 6) AS stay, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var, round(ll, 6) AS log_likelihood
  FROM mv JOIN pi USING (label, s) JOIN xi USING (label) JOIN l USING (label)"""
VITERBI = f"""WITH RECURSIVE {_FIRST}, v AS (SELECT rec_id, label, 0 AS t, {_LN('1.0')} + b0 AS v0, {_LN('0.0')} + b1 AS v1, {_LN('0.0')} + b2 AS v2, '0' AS p0, '1' AS p1, '2' AS p2 FROM e3 JOIN lab USING (rec_id, label) WHERE frame_idx = 0
  UNION ALL SELECT v.rec_id, v.label, t + 1, v0 + ln(0.7) + b0, greatest(v0 + ln(0.3), v1 + ln(0.7)) + b1, greatest(v1 + ln(0.3), v2) + b2, p0 || ' 0', CASE WHEN v0 + ln(0.3) >= v1 + ln(0.7) THEN p0 ELSE p1 END || ' 1',
  CASE WHEN v1 + ln(0.3) >= v2 THEN p1 ELSE p2 END || ' 2' FROM v JOIN e3 e ON e.rec_id = v.rec_id AND e.label = v.label AND e.frame_idx = t + 1)
SELECT rec_id, label, round(greatest(v0, v1, v2), 6) AS score, CASE WHEN v0 >= v1 AND v0 >= v2 THEN p0 WHEN v1 >= v2 THEN p1 ELSE p2 END AS path FROM v WHERE t = 7"""

_CHAIN = f"""{_FIRST}, num AS (SELECT vec_id AS rec_id, 'w' || label AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
ch AS (SELECT label, k * 8 + frame_idx AS t, b0, b1, b2 FROM e3 JOIN num USING (rec_id, label)), most AS (SELECT label, max(t) AS last FROM ch GROUP BY label)"""
FORWARD_LONG = f"""WITH RECURSIVE {_CHAIN}, f AS (SELECT label, t, {_LN('1.0')} + b0 AS f0, {_LN('0.0')} + b1 AS f1, {_LN('0.0')} + b2 AS f2 FROM ch WHERE t = 0
  UNION ALL SELECT f.label, e.t, f0 + ln(0.7) + b0, {_ADD.format(a='(f1 + ln(0.7))', b='(f0 + ln(0.3))')} + b1, {_ADD.format(a='(f2 + ln(1.0))', b='(f1 + ln(0.3))')} + b2 FROM f JOIN ch e ON e.label = f.label AND e.t = f.t + 1),
g AS (SELECT label, {_ADD.format(a='f1', b='f2')} AS h, f0 FROM f JOIN most USING (label) WHERE t = last) SELECT label, round({_ADD.format(a='h', b='f0')}, 6) AS score FROM g"""
VITERBI_LONG = f"""WITH RECURSIVE {_CHAIN}, v AS (SELECT label, t, {_LN('1.0')} + b0 AS v0, {_LN('0.0')} + b1 AS v1, {_LN('0.0')} + b2 AS v2, 0 AS c1, 0 AS c2 FROM ch WHERE t = 0
  UNION ALL SELECT v.label, e.t, v0 + ln(0.7) + b0, greatest(v0 + ln(0.3), v1 + ln(0.7)) + b1, greatest(v1 + ln(0.3), v2) + b2, CASE WHEN v0 + ln(0.3) >= v1 + ln(0.7) THEN 0 ELSE 1 END, CASE WHEN v1 + ln(0.3) >= v2 THEN 1 ELSE 2 END
  FROM v JOIN ch e ON e.label = v.label AND e.t = v.t + 1),
p AS (SELECT label, t, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state, round(greatest(v0, v1, v2), 6) AS score FROM v JOIN most USING (label) WHERE t = last
  UNION ALL SELECT p.label, p.t - 1, CASE p.state WHEN 0 THEN 0 WHEN 1 THEN c1 ELSE c2 END, score FROM p JOIN v ON v.label = p.label AND v.t = p.t WHERE p.t > 0)
SELECT label, t::BIGINT AS frame_idx, state::INTEGER AS state, score FROM p"""

_EDGES = """un AS (SELECT vec_id, label, embedding[1:CASE WHEN vec_id % 3 = 0 THEN 64 ELSE vec_id * 7 % 65 END] AS e FROM embeddings),
nb AS (SELECT vec_id AS l, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
pr AS (SELECT l, r, nb.label, a.e AS ea, b.e AS eb, least(40, len(a.e), len(b.e)) AS n FROM nb JOIN un a ON a.vec_id = l JOIN un b ON b.vec_id = r),
cut AS (SELECT l, n, 'tail' AS side, generate_subscripts(ea[len(ea) - n + 1:], 1) - 1 AS i, unnest(ea[len(ea) - n + 1:])::DOUBLE AS x FROM pr WHERE n > 0
  UNION ALL SELECT l, n, 'head', generate_subscripts(eb[1:n], 1) - 1, unnest(eb[1:n])::DOUBLE FROM pr WHERE n > 0),
win AS (SELECT l, side, i, x, CASE WHEN n = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) END AS w FROM cut),
sp AS (SELECT l, side, k, sum(x * w * cos(2 * pi() * k * i / 512)) AS re, sum(x * w * sin(2 * pi() * k * i / 512)) AS im FROM win, range(257) AS r(k) GROUP BY ALL),
db AS (SELECT l, side, k, 20 * log10(greatest(sqrt(re * re + im * im), 1e-8)) AS db FROM sp), rms AS (SELECT l, side, sqrt(avg(x * x) + 1e-12) AS rms FROM cut GROUP BY l, side),
ls AS (SELECT a.l, avg((a.db - b.db) * (a.db - b.db)) AS lsd FROM db a JOIN db b ON b.l = a.l AND b.k = a.k AND a.side = 'tail' AND b.side = 'head' GROUP BY a.l),
dr AS (SELECT a.l, 100 * abs(a.rms - b.rms) AS d FROM rms a JOIN rms b ON b.l = a.l AND a.side = 'tail' AND b.side = 'head'),
jc AS (SELECT l, r, label, CASE WHEN n = 40 THEN lsd ELSE 0 END AS lsd, CASE WHEN n > 0 THEN lsd + d ELSE 0 END AS cost FROM pr LEFT JOIN ls USING (l) LEFT JOIN dr USING (l))"""
JOIN_COST = f"""WITH {_EDGES} SELECT l::VARCHAR AS "left", r::VARCHAR AS "right", round(lsd, 6) AS boundary_lsd, round(cost, 6) AS join_cost FROM jc"""
BOUNDARY_LSD = f"WITH {_EDGES} SELECT label, round(avg(lsd), 6) AS mean_lsd, count(*) AS n FROM jc GROUP BY label"


def crossfade(fade: int) -> str:
    """Energies and boundaries of ten vectors in a row that overlap by fade samples (those that there are of the last ten)."""
    ramp = f"CASE WHEN pos > 0 AND i < {fade} THEN i / {max(fade - 1, 1)} ELSE 1 END * CASE WHEN pos < last AND i >= {64 - fade} THEN 1 - (i - {64 - fade}) / {max(fade - 1, 1)} ELSE 1 END" if fade else "1"
    return f"""SELECT sent_id, (64 + last * {64 - fade})::INTEGER AS n_samples, array_to_string(list_transform(range(0, last + 1), lambda p: CASE WHEN p = 0 THEN 0 ELSE 64 + (p - 1) * {64 - fade} - {fade // 2} END), ' ') AS boundaries, round(sum(y * y), 6) AS energy FROM (
  SELECT sent_id, last, pos * {64 - fade} + i AS n, sum(x * {ramp}) AS y FROM cells GROUP BY ALL) GROUP BY sent_id, last"""


CELLS = """units AS (SELECT vec_id // 10 AS sent_id, vec_id % 10 AS pos, max(vec_id % 10) OVER (PARTITION BY vec_id // 10) AS last, embedding FROM embeddings),
cells AS (SELECT sent_id, pos, last, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM units)"""
