"""Streams with each feature of the format, made here by the inverse of each transform."""

from collections import Counter

import numpy as np
import pytest

from phonolake.llm import media_columns as M
from phonolake.llm import webp as V
from phonolake.llm import webp_writer as W


def prefix(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def put_plane(w, pixels, width, main, cache_bits=0, tokens=None, groups=1, meta_bits=2, lengths=V.spread):
    """tokens: ("lit", pixel), ("copy", length, distance code) or ("cache", index), else all literals."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(pixels) // width
    if main:
        w.put(1 if groups > 1 else 0, 1)
        if groups > 1:
            w.put(meta_bits - 2, 3)
            pw, ph = V.parts(width, meta_bits), V.parts(height, meta_bits)
            meta = np.arange(pw * ph) % groups
            put_plane(w, meta.astype(np.uint32) << 8, pw, False)
    sizes = (256 + V.LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, V.DISTANCES)
    tables = []
    for g in range(groups):
        own = [lengths(n)[::-1] if g % 2 else lengths(n) for n in sizes]
        for n in own:
            w.code(n)
        tables.append([V.canonical(n) for n in own])
    at = 0
    for token in tokens or [("lit", int(p)) for p in pixels]:
        y, x = divmod(at, width)
        t = tables[((y >> meta_bits) * V.parts(width, meta_bits) + (x >> meta_bits)) % groups] if groups > 1 else tables[0]
        if token[0] == "lit":
            p = token[1]
            for table, v in zip(t, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=False):
                w.symbol(table[v])
            at += 1
        elif token[0] == "cache":
            w.symbol(t[0][256 + V.LENGTHS + token[1]])
            at += 1
        else:
            s, extra, n = prefix(token[1])
            w.symbol(t[0][256 + s])
            w.put(extra, n)
            s, extra, n = prefix(token[2])
            w.symbol(t[4][s])
            w.put(extra, n)
            at += token[1]


def image(pixels, width, transforms=(), **options):
    w = V.Writer()
    for put in transforms:
        w.put(1, 1)
        put(w)
    w.put(0, 1)
    coded = options.pop("coded_width", width)
    put_plane(w, pixels, coded, True, **options)
    return w.riff(width, options.pop("height", len(pixels) // coded))


@pytest.fixture
def noise():
    return np.random.default_rng(5).integers(0, 1 << 32, 24 * 17, dtype=np.uint32)


def test_literals_groups_and_codes(noise):
    for options in ({}, {"groups": 3}, {"groups": 2, "cache_bits": 4}):
        assert (V.decode([image(noise, 24, **options)])[0].ravel() == noise).all()
    flat = np.full(50, 0x01020304, dtype=np.uint32)
    w = V.Writer()
    w.put(0, 3)
    for n, v in ((280, 3), (256, 2), (256, 4), (256, 1), (40, 0)):
        w.code([1 if k == v else 0 for k in range(n)])
    assert (V.decode([w.riff(10, 5)])[0].ravel() == flat).all()


def test_back_references_and_cache():
    r = np.random.default_rng(2)
    for width, bits in ((7, 0), (24, 3), (150, 5)):
        tokens, out, cache = [], [], {}
        while len(out) < width * 9:
            left = width * 9 - len(out)
            kind = r.integers(0, 4)
            if kind == 0 and len(out) > 2:
                n, code = int(min(left, r.integers(1, 70))), int(r.integers(1, 180))
                dist = code - 120 if code > 120 else max(1, int(V.NEAR[code - 1, 0] + V.NEAR[code - 1, 1] * width))
                if dist <= len(out):
                    tokens.append(("copy", n, code))
                    new = []
                    for _ in range(n):
                        out.append(out[-dist])
                        new.append(out[-1])
                else:
                    continue
            elif kind == 1 and bits and cache:
                k = int(r.choice(list(cache)))
                tokens.append(("cache", k))
                new = [cache[k]]
                out += new
            else:
                new = [int(r.integers(0, 1 << 32))]
                tokens.append(("lit", new[0]))
                out += new
            for p in new if bits else ():
                cache[(p * V.CACHE_HASH & 0xFFFFFFFF) >> 32 - bits] = p
        pixels = np.array(out, dtype=np.uint32)
        got = V.decode([image(pixels, width, tokens=tokens, cache_bits=bits)])[0]
        assert (got.ravel() == pixels).all()


def test_predictors_cross_colour_and_green(noise):
    width, height, bits = 24, 17, 2
    modes = (np.arange(V.parts(width, bits) * V.parts(height, bits)) % 14).astype(np.uint32) << 8
    full = noise.view(np.uint8).reshape(height, width, 4).astype(np.int32)
    rest = np.zeros_like(full)
    for y in range(height):
        for x in range(width):
            m = 0 if x == y == 0 else 1 if y == 0 else 2 if x == 0 else int(modes[(y >> bits) * V.parts(width, bits) + (x >> bits)] >> 8)
            zero = np.zeros(4, dtype=np.int32)
            left, up = (full[y, x - 1] if x else zero), (full[y - 1, x] if y else zero)
            tr = (full[y, 0] if x == width - 1 else full[y - 1, x + 1]) if y else zero
            tl = full[y - 1, x - 1] if x and y else zero
            rest[y, x] = (full[y, x] - slow_prediction(m, left, up, tr, tl)) & 255
    residual = np.ascontiguousarray(rest.astype(np.uint8)).view(np.uint32).ravel()

    def predictor(w):
        w.put(V.PREDICTOR, 2)
        w.put(bits - 2, 3)
        put_plane(w, modes, V.parts(width, bits), False)

    assert (V.decode([image(residual, width, [predictor])])[0].ravel() == noise).all()

    factors = np.random.default_rng(3).integers(0, 1 << 24, V.parts(width, bits) * V.parts(height, bits), dtype=np.uint32) | np.uint32(0xFF000000)
    crossed = noise.copy()
    s8 = lambda v: (int(v) & 255) - 256 * (int(v) & 128 > 0)
    for k, p in enumerate(noise.tolist()):
        f = int(factors[(k // width >> bits) * V.parts(width, bits) + (k % width >> bits)])
        red, green, blue = p >> 16 & 255, p >> 8 & 255, p & 255
        new_blue = blue - (s8(f >> 8) * s8(green) >> 5) - (s8(f >> 16) * s8(red) >> 5)
        crossed[k] = p & 0xFF00FF00 | (red - (s8(f) * s8(green) >> 5) & 255) << 16 | new_blue & 255

    def cross(w):
        w.put(V.CROSS_COLOUR, 2)
        w.put(bits - 2, 3)
        put_plane(w, factors, V.parts(width, bits), False)

    assert (V.decode([image(crossed, width, [cross])])[0].ravel() == noise).all()
    green = noise >> 8 & 255
    less = noise & np.uint32(0xFF00FF00) | ((noise >> 16) - green & 255) << 16 | (noise - green & 255)
    assert (V.decode([image(less, width, [lambda w: w.put(V.SUBTRACT_GREEN, 2)])])[0].ravel() == noise).all()


def slow_prediction(m, left, up, tr, tl):
    avg = lambda a, b: (a + b) // 2
    if m == 11:
        p = left + up - tl
        return left if np.abs(p - left).sum() < np.abs(p - up).sum() else up
    if m == 13:
        a = avg(left, up)
        return np.clip(a + np.array([int((u - v) / 2) for u, v in zip(a, tl, strict=True)]), 0, 255)
    return {
        0: np.array([0, 0, 0, 255]), 1: left, 2: up, 3: tr, 4: tl, 5: avg(avg(left, tr), up), 6: avg(left, tl), 7: avg(left, up), 8: avg(tl, up), 9: avg(up, tr),
        10: avg(avg(left, tl), avg(up, tr)), 12: np.clip(left + up - tl, 0, 255),
    }[m]


@pytest.mark.parametrize("colours", [2, 3, 13, 100])
def test_palettes(colours):
    r = np.random.default_rng(colours)
    table = r.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = r.integers(0, colours, (9, 21))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    size, per = 8 >> bits, 1 << bits
    packed = np.zeros((9, V.parts(21, bits)), dtype=np.uint32)
    for x in range(21):
        packed[:, x >> bits] |= index[:, x].astype(np.uint32) << np.uint32((x & per - 1) * size)
    deltas = np.diff(table.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)).astype(np.uint8)

    def palette(w):
        w.put(V.PALETTE, 2)
        w.put(colours - 1, 8)
        put_plane(w, np.ascontiguousarray(deltas).view(np.uint32).ravel(), colours, False)

    got = V.decode([image(packed.ravel() << 8, 21, [palette], coded_width=packed.shape[1])])[0]
    assert (got == table[index]).all()


def test_many_images_at_once(noise):
    images = [image(noise[: 24 * k], 24, groups=1 + k % 3) for k in range(1, 17)]
    for k, got in enumerate(V.decode(images), 1):
        assert (got.ravel() == noise[: 24 * k]).all()


TEXTS = [None, "", "a", "é" * 500, "x" * 576, "y" * 577, "日本 " * 20_000, "".join(map(chr, range(1, 500))), "the same line\n" * 400, "ab" * 10_000]


def test_payloads():
    payloads = [M.payload_of(t) for t in TEXTS]
    assert all(len(p) % M.ROW == 0 and p for p in payloads)
    media = M.encode(payloads)
    assert [a.tobytes() for a in M.pixel_arrays(media)] == payloads
    assert [M.encode([p])[0] for p in payloads] == media  # equal texts, equal bytes, whatever else is in the batch
    assert M.encode([]) == M.pixel_arrays([]) == []
    assert all(sum(2.0**-n for n in lengths if n) == 1 for b in W.books().values() for lengths in b.lengths if sum(map(bool, lengths)) > 1)
    with pytest.raises(ValueError, match="WebP"):
        V.read_headers([b"RIFF0000WEBPVP8 " + bytes(20)])


def used(data):
    """Counts of what an image is made of, read token by token."""
    h = V.read_headers([data])[0]
    out = Counter({f"transform {kind}": 1 for kind, *_ in h.transforms})
    for kind, *rest in h.transforms:
        out.update(f"{kind}: {int(v)}" for v in rest[2].tolist() if kind != V.PALETTE)
    p = h.plane
    b, at = V.Bits(p.data, p.at), 0
    while at < p.width * p.height:
        (green, *others) = p.groups[0]
        s = green.read(b)
        if s < 256:
            for code in others[:3]:
                code.read(b)
            at, kind = at + 1, "literal"
        elif s < 256 + V.LENGTHS:
            number = lambda s: s + 1 if s < 4 else (2 + (s & 1) << (s - 2 >> 1)) + b.read(s - 2 >> 1) + 1  # noqa: B023, E731
            at, kind = at + number(s - 256), "copy"
            number(others[3].read(b))
        else:
            at, kind = at + 1, "cache"
        out[kind] += 1
    return out


def test_stored_images_use_the_whole_format(spark):
    """Predictors, cross-colour, palettes, back-references and the colour cache all occur in what is stored of the documents."""
    found, images = Counter(), 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1, "aaaa" * 40)], "doc_id long, text string"), allowMissingColumns=True)
    for r in M.store_media(docs).collect():
        for data in M.images_of(bytes(r["media"])):
            own = used(data)
            found.update(own)
            images += 1
            assert own["copy"] or own["literal"]
    assert found[f"transform {V.PREDICTOR}"] == found[f"transform {V.CROSS_COLOUR}"] >= 0.9 * images
    assert found[f"transform {V.PALETTE}"] and found["copy"] >= 0.5 * images and found["cache"] and found["literal"]
    modes = {k for k in found if k.startswith(f"{V.PREDICTOR}: ")}
    factors = {k for k in found if k.startswith(f"{V.CROSS_COLOUR}: ")}
    assert len(modes) == len(W.MODES) and len(factors) > 8
