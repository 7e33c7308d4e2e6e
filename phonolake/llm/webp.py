"""Lossless WebP: many images are read in step, one pixel of each at a time, so that each step is a few array operations."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = np.array(
    [
        (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
        (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
        (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
        (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
        (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
        (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
    ]
)
CACHE_HASH = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        k, off = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.data[k : k + 5], "little") >> off) & ((1 << n) - 1)


@dataclass(frozen=True)
class Code:
    """A prefix code as a table: entry = length << 16 | symbol, for the next bits of the stream."""

    table: np.ndarray
    bits: int

    @classmethod
    def of(cls, lengths: list[int]) -> Code:
        n = np.array(lengths)
        used = np.flatnonzero(n)
        if len(used) == 1:  # takes no bits
            return cls(np.array([used[0]], dtype=np.uint32), 0)
        bits = int(n.max(initial=0))
        table = np.zeros(1 << bits, dtype=np.uint32)
        for symbol, (code, size) in canonical(lengths).items():
            table[int(f"{code:0{size}b}"[::-1], 2) :: 1 << size] = size << 16 | symbol
        return cls(table, bits)

    def read(self, b: Bits) -> int:
        k = b.at >> 3
        entry = int(self.table[(int.from_bytes(b.data[k : k + 5], "little") >> (b.at & 7)) & ((1 << self.bits) - 1)])
        b.at += entry >> 16
        return entry & 0xFFFF


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), shorter codes first and symbols of one length in order."""
    out, code, last = {}, 0, 0
    for size, symbol in sorted((s, k) for k, s in enumerate(lengths) if s):
        code <<= size - last
        out[symbol], last = (code, size), size
        code += 1
    return out


def read_code(b: Bits, symbols: int) -> Code:
    lengths = [0] * symbols
    if b.read(1):
        two = b.read(1)
        lengths[b.read(1 + 7 * b.read(1))] = 1
        if two:
            lengths[b.read(8)] = 1
        return Code.of(lengths)
    own = [0] * len(CODE_LENGTH_ORDER)
    for k in CODE_LENGTH_ORDER[: 4 + b.read(4)]:
        own[k] = b.read(3)
    code = Code.of(own)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else symbols
    at, last = 0, 8
    while at < symbols and left:
        left -= 1
        kind = code.read(b)
        if kind < 16:
            lengths[at], at, last = kind, at + 1, kind or last
        else:
            n, value = (3 + b.read(2), last) if kind == 16 else (3 + b.read(3), 0) if kind == 17 else (11 + b.read(7), 0)
            lengths[at : at + n], at = [value] * n, at + n
    return Code.of(lengths[:symbols])


@dataclass
class Plane:
    """Where an entropy-coded image begins and how it is coded; groups has the five codes of each prefix group."""

    data: bytes
    at: int
    width: int
    height: int
    groups: list[tuple[Code, ...]]
    cache_bits: int = 0
    meta: np.ndarray | None = None
    meta_bits: int = 0


@dataclass
class Image:
    width: int
    height: int
    plane: Plane
    transforms: list[tuple] = field(default_factory=list)


def parts(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


#: Groups of five codes by the bits that they were read from: writers use few of them.
_known: dict[tuple, dict[int, dict[int, tuple]]] = {}


def read_group(b: Bits, sizes: tuple[int, ...]) -> tuple[Code, ...]:
    known, k, off = _known.setdefault(sizes, {}), b.at >> 3, b.at & 7
    for n, seen in known.items():
        if group := seen.get(int.from_bytes(b.data[k : k + (off + n + 7 >> 3)], "little") >> off & (1 << n) - 1):
            b.at += n
            return group
    at = b.at
    group = tuple(read_code(b, n) for n in sizes)
    if sum(map(len, known.values())) < 64:
        n = b.at - at
        known.setdefault(n, {})[int.from_bytes(b.data[k : k + (off + n + 7 >> 3)], "little") >> off & (1 << n) - 1] = group
    return group


def read_plane(b: Bits, width: int, height: int, main: bool) -> Plane:
    cache = b.read(4) if b.read(1) else 0
    meta, bits, count = None, 0, 1
    if main and b.read(1):
        bits = b.read(3) + 2
        plane = read_plane(b, parts(width, bits), parts(height, bits), False)
        pixels, ends = read_pixels([plane])
        b.at, meta = int(ends[0]), pixels[0] >> 8 & 0xFFFF
        count = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    groups = [read_group(b, sizes) for _ in range(count)]
    return Plane(b.data, b.at, width, height, groups, cache, meta, bits)


def read_headers(images: list[bytes]) -> list[Image]:
    """What comes before the pixels of each image; the images within images are read together, a transform at a time."""
    out, todo = [], []
    for data in images:
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
            raise ValueError("no lossless WebP image")
        b = Bits(data, 21 * 8)
        width, height = b.read(14) + 1, b.read(14) + 1
        if b.read(1) not in (0, 1) or b.read(3):
            raise ValueError("unknown version")
        out.append(Image(width, height, None))
        todo.append((out[-1], b, width))
    while todo:
        inner, left = [], []
        for image, b, coded in todo:
            if not b.read(1):
                image.plane = read_plane(b, coded, image.height, True)
                continue
            kind = b.read(2)
            if kind == SUBTRACT_GREEN:
                image.transforms.append((kind,))
                left.append((image, b, coded))
                continue
            if kind == PALETTE:
                bits, plane = 0, read_plane(b, b.read(8) + 1, 1, False)
            else:
                bits = b.read(3) + 2
                plane = read_plane(b, parts(coded, bits), parts(image.height, bits), False)
            inner.append((image, b, coded, kind, bits, plane))
        pixels, ends = read_pixels([x[-1] for x in inner]) if inner else ([], [])
        for (image, b, coded, kind, bits, plane), own, end in zip(inner, pixels, ends, strict=True):
            b.at = int(end)
            if kind == PALETTE:
                n = plane.width
                own = np.cumsum(own.view(np.uint8).reshape(n, 4), axis=0, dtype=np.uint8)
                bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                image.transforms.append((kind, bits, coded, np.ascontiguousarray(own).view(np.uint32).ravel()))
                coded = parts(coded, bits)
            else:
                image.transforms.append((kind, bits, coded, own))
            left.append((image, b, coded))
        todo = left
    return out


def values(prefix: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols with their extra bits in w, and how many bits these are."""
    extra = np.maximum(prefix - 2, 0) >> 1
    big = ((2 + (prefix & 1)) << extra) + (w & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1
    return np.where(prefix < 4, prefix + 1, big), np.where(prefix < 4, 0, extra)


def read_pixels(planes: list[Plane]) -> tuple[list[np.ndarray], np.ndarray]:
    """The pixels (A, R, G and B from the high bits down) of all planes, and the bit after the last one of each."""
    sizes = np.array([p.width * p.height for p in planes])
    order = np.argsort(-sizes, kind="stable")
    lanes = [planes[k] for k in order]
    size = sizes[order]
    buffers = {id(p.data): p.data for p in lanes}
    starts, total = {}, 0
    for k, d in buffers.items():
        starts[k], total = total, total + len(d)
    raw = np.frombuffer(b"".join(buffers.values()) + bytes(16), dtype=np.uint8)
    words = np.ndarray((total + 8,), dtype="<u8", buffer=raw, strides=(1,))
    pos = np.array([8 * starts[id(p.data)] + p.at for p in lanes], dtype=np.int64)
    tables, at, n = {}, {}, 0
    for p in lanes:
        for g in p.groups:
            for c in g:
                if id(c) not in tables:
                    tables[id(c)], at[id(c)], n = c.table, n, n + len(c.table)
    table = np.concatenate(list(tables.values()))
    # bases and masks of the five codes of each group, groups of one lane in a row
    groups = [g for p in lanes for g in p.groups]
    base = np.array([[at[id(c)] for c in g] for g in groups], dtype=np.int64)
    mask = np.array([[(1 << c.bits) - 1 for c in g] for g in groups], dtype=np.uint64)
    first = np.cumsum([0, *(len(p.groups) for p in lanes)])[:-1]
    width = np.array([p.width for p in lanes], dtype=np.int64)
    out = np.zeros(int(size.sum()), dtype=np.uint32)
    to = np.cumsum(size) - size
    cache_bits = np.array([p.cache_bits for p in lanes], dtype=np.int64)
    caching = cache_bits.any()
    caches = np.zeros((len(lanes), 1 << int(cache_bits.max(initial=0))), dtype=np.uint32) if caching else None
    shift = np.uint32(32) - cache_bits.astype(np.uint32)
    metas = any(p.meta is not None for p in lanes)
    left, back = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    group = first.copy()
    copying = False
    eight, wide = np.uint64(7), bool((np.array([[c.bits for c in g] for g in groups])[:, :4].sum(axis=1) > 56).any())
    low = np.uint32(0xFFFF)
    ends = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # lanes with more pixels than i

    def symbol(k: int, rows, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = group[rows]
        e = table[base[g, k] + (w & mask[g, k]).astype(np.int64)]
        return e & low, (e >> 16).astype(np.int64)

    def bits(at: np.ndarray) -> np.ndarray:
        return words[at >> 3] >> (at.astype(np.uint64) & eight)

    for i, m in enumerate(ends.tolist()):
        live = slice(0, m)
        if metas:
            for k, p in enumerate(lanes[:m]):
                if p.meta is not None:
                    y, x = divmod(i, p.width)
                    group[k] = first[k] + int(p.meta[(y >> p.meta_bits) * parts(p.width, p.meta_bits) + (x >> p.meta_bits)])
        rows = live if not copying else np.flatnonzero(left[:m] == 0)
        p = pos[rows]
        w = bits(p)
        green, n = symbol(0, rows, w)
        p, w = p + n, w >> n.astype(np.uint64)
        plain = bool((green < 256).all())
        if not plain:
            every = np.arange(m) if not copying else rows
            pos[every] = p
            other = every[green >= 256 + LENGTHS]
            if len(other):
                out[to[other] + i] = caches[other, green[green >= 256 + LENGTHS].astype(np.int64) - 256 - LENGTHS]
            match = (green >= 256) & (green < 256 + LENGTHS)
            if match.any():
                r = every[match]
                length, used = values(green[match].astype(np.int64) - 256, w[match])
                pos[r] += used
                code, used = symbol(4, r, bits(pos[r]))
                pos[r] += used
                dist, used = values(code.astype(np.int64), bits(pos[r]))
                pos[r] += used
                near = NEAR[np.minimum(dist, len(NEAR)) - 1]
                back[r] = np.where(dist > len(NEAR), dist - len(NEAR), np.maximum(near[:, 0] + near[:, 1] * width[r], 1))
                left[r] = length
                copying = True
            rows = every[green < 256]
            p, w, green = pos[rows], bits(pos[rows]), green[green < 256]
        red, n = symbol(1, rows, w)
        p, w = p + n, w >> n.astype(np.uint64)
        if wide:
            w = bits(p)
        blue, n = symbol(2, rows, w)
        p, w = p + n, w >> n.astype(np.uint64)
        alpha, n = symbol(3, rows, w)
        pos[rows] = p + n
        out[to[rows] + i] = alpha << 24 | red << 16 | green << 8 | blue
        if copying:
            r = np.flatnonzero(left[:m] > 0)
            out[to[r] + i] = out[to[r] + i - back[r]]
            left[r] -= 1
            copying = bool((left[:m] > 0).any())
        if caching:
            r = np.flatnonzero(cache_bits[:m] > 0)
            px = out[to[r] + i]
            caches[r, ((px * np.uint32(CACHE_HASH)) >> shift[r]).astype(np.int64)] = px
    pixels, after = [None] * len(planes), np.zeros(len(planes), dtype=np.int64)
    for k, o in enumerate(order.tolist()):
        pixels[o] = out[to[k] : to[k] + size[k]]
        after[o] = pos[k] - 8 * starts[id(lanes[k].data)]
    return pixels, after


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, near, width: int) -> np.ndarray:
    """What a mode makes of the pixels that are so many places back: int arrays of four channels."""
    left, up, right, corner = (lambda d=d: near(d) for d in (1, width, width - 1, width + 1))
    if mode in (1, 2, 3, 4):
        return (left, up, right, corner)[mode - 1]()
    if mode == 5:
        return average(average(left(), right()), up())
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, up), (corner, up), (up, right))[mode - 6]
        return average(a(), b())
    if mode == 10:
        return average(average(left(), corner()), average(up(), right()))
    if mode in (11, 12):
        l, t, c = left(), up(), corner()  # noqa: E741
        p = l + t - c
        if mode == 12:
            return np.clip(p, 0, 255)
        nearer = np.abs(p - l).sum(axis=-1, keepdims=True) < np.abs(p - t).sum(axis=-1, keepdims=True)
        return np.where(nearer, l, t)
    if mode == 13:
        mid, c = average(left(), up()), corner()
        return np.clip(mid + np.trunc((mid - c) / 2).astype(mid.dtype), 0, 255)
    return np.array([[0, 0, 0, 255]], dtype=np.int16)  # of mode 0 and of those that are not defined


def in_blocks(width: int, heights: list[int], bits: int, inner: list[np.ndarray]) -> np.ndarray:
    """For each row of images below each other, and each block of a row, the pixel of the image within the image that is for it."""
    wide = parts(width, bits)
    return np.concatenate([np.repeat(v.reshape(-1, wide), 1 << bits, axis=0)[:h] for v, h in zip(inner, heights, strict=True)])


def unpredict(pixels: list[np.ndarray], width: int, bits: int, modes: list[np.ndarray]) -> list[np.ndarray]:
    """Images of one width: their pixels with x + 2 * y alike need none of each other, and are made at once."""
    heights = [len(p) // width for p in pixels]
    out = np.concatenate(pixels).view(np.uint8).reshape(-1, 4)
    mode = (in_blocks(width, heights, bits, modes) >> 8 & 0xF).astype(np.uint8)
    y = np.concatenate([np.arange(h) for h in heights])
    order = np.argsort(y, kind="stable")  # rows by their place in their images
    y, mode, at = y[order], mode[order], (width * np.arange(len(y)))[order]
    ends = np.searchsorted(y, np.arange(max(heights) + 1), "left")
    for step in range(width + 2 * (max(heights) - 1)):
        some = slice(ends[max(0, -(-(step - width + 1) // 2))], ends[min(max(heights) - 1, step // 2) + 1])
        x = step - 2 * y[some]
        to = at[some] + x
        m = mode[some, :][np.arange(len(x)), x >> bits]
        m = np.where(y[some] == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, m))
        for k in np.flatnonzero(np.bincount(m)).tolist():
            t = to[m == k]
            # a row's last pixel has the first of its own row above to the right
            near = lambda back: out[t - back].astype(np.int16)  # noqa: B023, E731
            out[t] += predicted(k, near, width).astype(np.uint8)
    rows = np.ascontiguousarray(out).view(np.uint32).ravel()
    return np.split(rows, np.cumsum([width * h for h in heights])[:-1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def uncross(pixels: list[np.ndarray], width: int, bits: int, factors: list[np.ndarray]) -> list[np.ndarray]:
    """Images of one width."""
    heights = [len(p) // width for p in pixels]
    p = np.concatenate(pixels)
    f = np.repeat(in_blocks(width, heights, bits, factors), 1 << bits, axis=1)[:, :width].ravel()
    green = signed(p >> 8)
    red = (p >> 16 & 255).astype(np.int32) + (signed(f) * green >> 5) & 255
    blue = (p & 255).astype(np.int32) + (signed(f >> 8) * green >> 5) + (signed(f >> 16) * signed(red) >> 5) & 255
    p = p & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)
    return np.split(p, np.cumsum([width * h for h in heights])[:-1])


def unindex(pixels: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    """Each green value has 1 << bits indexes, the first in its low bits; those beyond the table mean transparent black."""
    green = (pixels >> 8 & 255).reshape(-1, parts(width, bits))
    x = np.arange(width)
    size = 8 >> bits
    index = green[:, x >> bits] >> ((x & (1 << bits) - 1) * size).astype(np.uint32) & np.uint32((1 << size) - 1)
    return np.append(table, np.zeros(256 - len(table), dtype=np.uint32))[index].ravel()


def ungreen(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)


def decode(images: list[bytes]) -> list[np.ndarray]:
    """Arrays of 32-bit pixels (A, R, G and B from the high bits down), a row for each row of an image."""
    headers = read_headers(images)
    pixels = read_pixels([h.plane for h in headers])[0] if headers else []
    for depth in range(max((len(h.transforms) for h in headers), default=0) - 1, -1, -1):
        alike: dict[tuple, list[int]] = {}  # images with the same transform at that depth
        for k, h in enumerate(headers):
            if depth < len(h.transforms):
                kind, *rest = h.transforms[depth]
                if kind in (PREDICTOR, CROSS_COLOUR):
                    alike.setdefault((kind, rest[1], rest[0]), []).append(k)
                elif kind == PALETTE:
                    pixels[k] = unindex(pixels[k], rest[1], rest[0], rest[2])
                else:
                    pixels[k] = ungreen(pixels[k])
        for (kind, width, bits), group in alike.items():
            undo = unpredict if kind == PREDICTOR else uncross
            for k, p in zip(group, undo([pixels[k] for k in group], width, bits, [headers[k].transforms[depth][3] for k in group]), strict=True):
                pixels[k] = p
    return [p.reshape(h.height, h.width) for h, p in zip(headers, pixels, strict=True)]


class Writer:
    """Bits, the first one lowest."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.n = self.value | value << self.n, self.n + n

    def code(self, lengths: list[int]) -> None:
        """A prefix code by its lengths, with runs of zeros and repeats."""
        used = [k for k, n in enumerate(lengths) if n]
        if len(used) <= 1 and (used or [0])[0] < 256:
            self.put(0b1_0_1, 3)
            self.put((used or [0])[0], 8)
            return
        self.put(0, 1)
        self.put(15, 4)
        own = spread(len(CODE_LENGTH_ORDER))
        for k in CODE_LENGTH_ORDER:
            self.put(own[k], 3)
        self.put(0, 1)
        codes, k, last = canonical(own), 0, 8
        while k < len(lengths):
            n = lengths[k]
            run = next((j for j in range(k, len(lengths)) if lengths[j] != n), len(lengths)) - k
            if n and n == last and run >= 3:
                kind, run, least, bits = 16, min(run, 6), 3, 2
            elif not n and run >= 3:
                kind, run, least, bits = (18, min(run, 138), 11, 7) if run >= 11 else (17, run, 3, 3)
            else:
                kind, run, least, bits, last = n, 1, 1, 0, n or last
            self.symbol(codes[kind])
            self.put(run - least, bits)
            k += run

    def symbol(self, code: tuple[int, int]) -> None:
        self.put(int(f"{code[0]:0{code[1]}b}"[::-1] or "0", 2) if code[1] else 0, code[1])

    def riff(self, width: int, height: int) -> bytes:
        head = 0x2F | width - 1 << 8 | height - 1 << 22 | 1 << 36
        return wrapped((head | self.value << 40).to_bytes(5 + (self.n + 7 >> 3), "little"))


def spread(symbols: int) -> list[int]:
    """Lengths of a complete code that differ by one at most."""
    bits = (symbols - 1).bit_length()
    short = (1 << bits) - symbols
    return [bits - 1] * short + [bits] * (symbols - short)


def wrapped(chunk: bytes) -> bytes:
    chunk, n = chunk + bytes(len(chunk) & 1), len(chunk)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", n) + chunk
