"""Recordings in blocks against whole recordings, numbering by ranges against windows, and WAV files by byte ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.functions import dsp
from phonolake.operators import blocks as B
from phonolake.operators import cepstral as C
from phonolake.operators import levels as L
from phonolake.operators import spectral as P
from phonolake.sources import wav
from phonolake.sources.audio import parse_wav

PSD = [0.5] * 17
TAPS = dsp.design_fir("lowpass", 15.0, 100, 21)
#: Each operator on whole recordings and in blocks, and the columns that name a row.
PAIRS = {
    "apply_fir": (lambda a: L.to_long(P.apply_fir(a, TAPS)), lambda s, n: B.apply_fir(s, TAPS, n), ("rec_id", "n")),
    "even_taps": (lambda a: L.to_long(P.apply_fir(a, TAPS[:20])), lambda s, n: B.apply_fir(s, TAPS[:20], n), ("rec_id", "n")),
    "down": (lambda a: L.to_long(P.resample(a, 100, 40)), lambda s, n: B.resample(s, 100, 40, size=n), ("rec_id", "n")),
    "up": (lambda a: L.to_long(P.resample(a, 100, 130)), lambda s, n: B.resample(s, 100, 130, size=n), ("rec_id", "n")),
    "stft": (lambda a: P.stft_spectrogram(a, 100, 160.0, 30.0), lambda s, n: B.stft_spectrogram(s, 100, 160.0, 30.0, size=n), ("rec_id", "frame_idx")),
    "mfcc": (lambda a: C.mfcc(a, 100, 16, 8, 64, 8, 8), lambda s, n: B.mfcc(s, 100, 16, 8, 64, 8, 8, block_size=n), ("rec_id", "frame_idx")),
    "wiener": (lambda a: L.to_long(P.enhance(a, PSD, "wiener", nfft=32, size=24, hop=8)), lambda s, n: B.enhance(s, PSD, "wiener", nfft=32, size=24, hop=8, block_size=n), ("rec_id", "n")),
    "subtract": (lambda a: L.to_long(P.enhance(a, PSD, "subtract", nfft=32, size=24, hop=8)), lambda s, n: B.enhance(s, PSD, "subtract", nfft=32, size=24, hop=8, block_size=n), ("rec_id", "n")),
}


@pytest.fixture(scope="module")
def long(spark):
    """Recordings shorter than a frame, as long as a block, and of many blocks."""
    r = np.random.default_rng(1)
    rows = [(k, n, float(v)) for k, size in enumerate([1, 5, 15, 16, 17, 64, 127, 128, 129, 700]) for n, v in enumerate(r.uniform(-1, 1, size))]
    return spark.createDataFrame(rows, "rec_id long, n long, x double").repartition(5).cache()


def values(df, keys):
    out = {tuple(r[k] for k in keys): [np.atleast_1d(np.array(r[c], dtype=float)) for c in df.columns if c not in keys] for r in df.collect()}
    return out


@pytest.mark.parametrize("size", [16, 64])
@pytest.mark.parametrize("name", PAIRS)
def test_blocks_give_what_whole_recordings_give(long, name, size):
    whole, blocked, keys = PAIRS[name]
    a, b = values(whole(L.to_arrays(long)), keys), values(blocked(long, size), keys)
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert np.allclose(x, y, atol=1e-12, rtol=0)


def test_blocks_are_bounded(long):
    """No row has more samples than a block and its halo."""
    d = B.to_blocks(long, 64, before=5, after=7)
    assert d.agg(F.max(F.size("samples"))).first()[0] == 76
    assert d.groupBy("rec_id").count().filter("rec_id = 9").first()["count"] == 11


def test_numbering_without_windows(spark):
    """A key with a third of the rows, null keys, and stats of each key; the plan has no window over rows."""
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 > 0, F.col("id") % 50).alias("u"), F.xxhash64("id").alias("ts"), "id", (F.col("id") % 17).cast("double").alias("v"))
    got = B.numbered(d, "u", ["ts", "id"], {"total": (F.sum("v"), F.sum), "most": (F.max("v"), F.max)})
    own = W.partitionBy("u")
    want = d.select("u", "ts", "id", "v", (F.row_number().over(own.orderBy("ts", "id")) - 1).cast("long").alias("n"), F.sum("v").over(own).alias("total"), F.max("v").over(own).alias("most"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 3000
    assert B.numbered(d.filter("1 = 0"), "u", ["ts"]).count() == 0


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_files_by_byte_ranges(spark, long, tmp_path, bits):
    """What is written is read again, however the files are cut; long recordings are several files; a second write replaces the first."""
    path = f"{tmp_path}/out"
    for _ in range(2):
        wav.write_wav_files(B.to_blocks(long, 64).withColumn("fs", F.lit(100)), path, bits, file_frames=256)
    files = {f.name: parse_wav(f.read_bytes())[3][:, 0] for f in (tmp_path / "out").glob("*.wav")}
    assert len(files) == 12 and {"9.wav", "9-1.wav", "9-2.wav"} <= set(files) and (tmp_path / "out/_SUCCESS").exists() and not (tmp_path / "out/_temporary").exists()
    for split in (50, 333, 1 << 20):
        rows = wav.read_wav_blocks(spark, path, split, 32).collect()
        assert max(len(r["samples"]) for r in rows) <= 32
        for name, x in files.items():
            own = sorted((r for r in rows if r["path"].endswith(f"/{name}")), key=lambda r: r["at"])
            assert all((r["n_frames"], r["fs"], r["bit_depth"], r["channels"]) == (len(x), 100, bits, 1) for r in own)
            assert np.array_equal(np.concatenate([r["samples"] for r in own]), x)


def test_odd_wav_files(spark, tmp_path):
    """Two channels, chunks before and after the data, an empty file, and a data chunk that is said to be longer than the file."""
    from phonolake.sources.audio import wav_bytes

    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, (500, 2))
    plain = wav_bytes(x, 8000)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/two.wav").write_bytes(plain[:36] + b"LIST\x03\x00\x00\x00abc\x00" + plain[36:] + b"tail\x02\x00\x00\x00xy")
    (tmp_path / "empty.wav").write_bytes(wav_bytes(np.zeros(0), 8000))
    (tmp_path / "cut.wav").write_bytes(plain[:1000])
    got = {}
    for row in sorted(wav.read_wav_blocks(spark, str(tmp_path), 100, 64).collect(), key=lambda r: r["at"]):
        got.setdefault(row["path"].rsplit("/", 1)[1], []).append(row)
    assert np.array_equal(np.hstack([r["samples_ch"] for r in got["two.wav"]]).T, parse_wav(plain)[3])
    assert [(r["n_frames"], r["samples"]) for r in got["empty.wav"]] == [(0, [])]
    assert sum(len(r["samples"]) for r in got["cut.wav"]) == got["cut.wav"][0]["n_frames"] == 239
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    with pytest.raises(Exception, match="no WAV file"):
        wav.read_wav_blocks(spark, str(tmp_path)).collect()
