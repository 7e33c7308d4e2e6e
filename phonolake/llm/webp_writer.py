"""A deterministic writer of lossless WebP images of one width, many at a time.

Each image is written by itself: equal pixels give equal bytes, whatever else is in the batch. An image of few colours gets a
palette. Any other gets a predictor for each block, that whose residuals take the least bits, then the cross-colour
factors with the least bits for each block. What is left is written as back-references to the pixels' last occurrence,
colour cache hits and literals, with fixed prefix codes.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

from phonolake.llm.webp import CACHE_HASH, CROSS_COLOUR, DISTANCES, LENGTHS, NEAR, PALETTE, PREDICTOR, Writer, canonical, parts, spread, wrapped

#: Colours of a palette at most; predictors and factors to choose from (the first wins ties); blocks of 32 x 32 pixels.
COLOURS = 16
MODES = (1, 2, 4, 11)
GREEN_TO_RED, GREEN_TO_BLUE, RED_TO_BLUE = (0, 8, -8, 16), (0, 8, -8, 16), (0, 8)
BLOCK_BITS, CACHE_BITS = 5, 6
#: Pixels that a back-reference copies at least, and at most by the format.
SHORTEST, LONGEST = 4, 4096


# Letters of prose, the most frequent first.
LETTERS = b"etaoinsrhldcumfpgwybvkxjqz"


@lru_cache(maxsize=1)
def residual_weights() -> np.ndarray:
    """How often differences of two bytes of prose come: letters by rank, spaces, marks, capitals, digits, other scripts and padding."""
    p = np.full(256, 1e-4)
    p[list(LETTERS)] = 0.72 * np.array([1 / (k + 4) for k in range(26)]) / sum(1 / (k + 4) for k in range(26))
    p[0x20], p[0x0A], p[[0x2E, 0x2C]] = 0.16, 0.008, 0.01
    p[0x41:0x5B] += 0.02 / 26
    p[0x30:0x3A] += 0.02 / 10
    p[0x80:0xC6] += 0.03 / 70
    p[0xFF] += 0.02
    p /= p.sum()
    return np.array([p @ np.roll(p, r) for r in range(256)])


def huffman(weights: list[float]) -> list[int]:
    """Code lengths; of equal weights the earlier ones are merged first."""
    heap = [(w, k, [k]) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    while len(heap) > 1:
        (a, _, x), (b, k, y) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in x + y:
            lengths[symbol] += 1
        heapq.heappush(heap, (a + b, len(weights) + k, x + y))
    return lengths


def residual_lengths(symbols: int) -> list[int]:
    """Code lengths of bytes that are differences of bytes of prose; symbols beyond 256 take 6 percent of the places."""
    w = residual_weights() + 3e-5
    rest = symbols - 256
    return huffman([*(w / w.sum() * (0.94 if rest else 1)).tolist(), *([0.06 / rest] * rest if rest else [])])


def reversed_bits(codes: dict[int, tuple[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each symbol in the order of the stream, and how many."""
    bits, size = np.zeros(symbols, dtype=np.uint64), np.zeros(symbols, dtype=np.int64)
    for k, (code, n) in codes.items():
        bits[k], size[k] = int(f"{code:0{n}b}"[::-1], 2), n
    return bits, size


def prefixes(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value up to most its prefix symbol, extra bits and their number; none for 0."""
    v = np.arange(most + 1) - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    small = v < 4
    return np.where(small, v, 2 * high + second), np.where(small, 0, v - ((2 + second) << np.maximum(high - 1, 0))), np.where(small, 0, high - 1)


class Book:
    """The five prefix codes of an image, as bits for each symbol; a code of one symbol takes none."""

    def __init__(self, lengths: list[list[int]], cache_bits: int) -> None:
        self.lengths, self.cache_bits = lengths, cache_bits
        single = [sum(map(bool, n)) == 1 for n in lengths]
        self.codes = [(np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.int64)) if one else reversed_bits(canonical(n), len(n)) for n, one in zip(lengths, single, strict=True)]

    def put(self, w: Writer) -> None:
        """What comes before the pixels of a main image."""
        w.put(1 if self.cache_bits else 0, 1)
        w.put(self.cache_bits, 4 if self.cache_bits else 0)
        w.put(0, 1)  # one prefix group
        for n in self.lengths:
            w.code(n)


def only(symbol: int, symbols: int = 256) -> list[int]:
    return [int(k == symbol) for k in range(symbols)]


def few(symbols: tuple[int, ...], of: int = 256) -> list[int]:
    """Lengths of a code of two or four symbols."""
    return [len(symbols) // 2 if k in {s & 255 for s in symbols} else 0 for k in range(of)]


@lru_cache(maxsize=1)
def books() -> dict[str, Book]:
    size = 256 + LENGTHS
    return {
        "rest": Book([residual_lengths(size + (1 << CACHE_BITS)), *[residual_lengths(256)] * 3, spread(DISTANCES)], CACHE_BITS),
        "index": Book([spread(size), only(0), only(0), only(255), spread(DISTANCES)], 0),
        "modes": Book([few(MODES, size), only(0), only(0), only(255), only(0, DISTANCES)], 0),
        "factors": Book([few(GREEN_TO_BLUE, size), few(RED_TO_BLUE), few(GREEN_TO_RED), only(255), only(0, DISTANCES)], 0),
        "table": Book([spread(size), spread(256), spread(256), spread(256), only(0, DISTANCES)], 0),
    }


@lru_cache(maxsize=1)
def heads() -> tuple[Writer, Writer, Writer]:
    """The fixed bits before the modes, between modes and factors, and between factors and pixels."""
    out, b = [], books()
    for kind, name in ((PREDICTOR, "modes"), (CROSS_COLOUR, "factors")):
        w = Writer()
        w.put(1, 1)
        w.put(kind, 2)
        w.put(BLOCK_BITS - 2, 3)
        w.put(0, 1)
        for n in b[name].lengths:
            w.code(n)
        out.append(w)
    w = Writer()
    w.put(0, 1)
    b["rest"].put(w)
    return (*out, w)


def predictions(x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """x: rows x width x 4 bytes; first: whether a row is its image's first. What each of MODES makes of the neighbours, edges by their own rules."""
    left = np.empty_like(x)
    left[:, 1:], left[:, 0] = x[:, :-1], (0, 0, 0, 255)
    up = np.empty_like(x)
    up[1:], up[0] = x[:-1], 0
    corner = np.empty_like(x)
    corner[:, 1:], corner[:, 0] = up[:, :-1], 0
    l, t, c = (v.astype(np.int16) for v in (left, up, corner))  # noqa: E741
    nearer = np.abs(t - c).sum(axis=-1, keepdims=True) < np.abs(l - c).sum(axis=-1, keepdims=True)  # of l + t - c to l than to t
    out = []
    for p in (left, up, corner, np.where(nearer, left, up)):
        p = p.copy()
        p[:, 0] = up[:, 0]
        p[first] = left[first]
        out.append(p)
    return out


def block_sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """rows x width -> images x blocks."""
    return np.add.reduceat(np.add.reduceat(x, np.arange(0, x.shape[1], 1 << BLOCK_BITS), axis=1, dtype=np.int64), begins, axis=0)


@lru_cache(maxsize=1)
def costs() -> np.ndarray:
    """Bits that each byte of what is left takes."""
    return np.array(residual_lengths(256), dtype=np.uint8)


def least(candidates: list[np.ndarray], begins: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays of bytes (rows x width, or x 4) that with the least bits for each block: its number, images x blocks, and the bytes."""
    flat = lambda v: costs()[v].sum(axis=2, dtype=np.uint8) if v.ndim == 3 else costs()[v]
    best = np.stack([block_sums(flat(v), begins) for v in candidates]).argmin(axis=0)
    at = np.repeat(np.repeat(best, heights, axis=0), 1 << BLOCK_BITS, axis=1)[:, : candidates[0].shape[1]]
    out = candidates[0].copy()
    for k, v in enumerate(candidates[1:], 1):
        out[at == k] = v[at == k]
    return best, out


def transformed(x: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows x width x 4 bytes (blue, green, red, alpha) -> the residual pixels, and bits of the modes and of the factors of each image."""
    begins = np.cumsum(heights) - heights
    first = np.zeros(len(x), dtype=bool)
    first[begins] = True
    modes, rest = least([x - p for p in predictions(x, first)], begins, heights)
    signed = lambda v: v.view(np.int8).astype(np.int16)
    green, red = signed(np.ascontiguousarray(rest[..., 1])), signed(np.ascontiguousarray(rest[..., 2]))
    by = lambda v, m: (v * np.int16(m) >> 5).astype(np.uint8)
    to_red, rest[..., 2] = least([rest[..., 2] - by(green, m) for m in GREEN_TO_RED], begins, heights)
    to_blue, rest[..., 0] = least([rest[..., 0] - by(green, m) for m in GREEN_TO_BLUE], begins, heights)
    red_blue, rest[..., 0] = least([rest[..., 0] - by(red, m) for m in RED_TO_BLUE], begins, heights)
    b = books()

    def code(number: np.ndarray, values: tuple[int, ...], book: str, channel: int) -> tuple[np.ndarray, int]:
        bits, n = b[book].codes[channel]
        v = np.array([s & 255 for s in values])[number]
        return bits[v], int(n[values[0] & 255])

    m, n = code(modes, MODES, "modes", 0)
    mode_bits = (m << (np.arange(m.shape[1], dtype=np.uint64) * np.uint64(n))).sum(axis=1)
    (g, ng), (r, nr), (u, nu) = code(to_blue, GREEN_TO_BLUE, "factors", 0), code(red_blue, RED_TO_BLUE, "factors", 1), code(to_red, GREEN_TO_RED, "factors", 2)
    f = g | r << np.uint64(ng) | u << np.uint64(ng + nr)
    factor_bits = (f << (np.arange(f.shape[1], dtype=np.uint64) * np.uint64(ng + nr + nu))).sum(axis=1)
    return np.ascontiguousarray(rest).view(np.uint32).ravel(), mode_bits, factor_bits


def last_equal(key: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, or -1."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1, dtype=np.int64)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def matches(px: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of the back-references of all images, the first that fits taken each time."""
    n = len(px) - SHORTEST + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    key = image[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHORTEST):
            key = (key ^ px[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    back = last_equal(key)
    some = np.flatnonzero((back >= 0) & (image[:n] == image[SHORTEST - 1 :]))
    for k in range(SHORTEST):  # equal keys prove nothing
        some = some[(image[some] == image[back[some]]) & (px[some + k] == px[back[some] + k])]
    if not len(some):
        return (np.zeros(0, dtype=np.int64),) * 3
    dist = some - back[some]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(some) != 1) | (np.diff(dist) != 0) | (np.diff(image[some]) != 0)]))
    length = np.diff(np.append(new, len(some))) + SHORTEST - 1
    out, end = [], 0
    for s, m, d in zip(some[new].tolist(), length.tolist(), dist[new].tolist(), strict=True):
        at, stop = max(s, end), s + m
        while stop - at >= SHORTEST:
            out.append((at, min(stop - at, LONGEST), d))
            end = at = at + out[-1][1]
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 3).T)


@lru_cache(maxsize=4)
def distance_codes(width: int, most: int) -> np.ndarray:
    """The code of each distance: that of a near pixel, if there is one for it."""
    codes = np.arange(most + 1) + len(NEAR)
    for code in range(len(NEAR), 0, -1):
        d = int(NEAR[code - 1, 0] + NEAR[code - 1, 1] * width)
        if 1 <= d <= most:
            codes[d] = code
    return codes


def packed(px: np.ndarray, sizes: np.ndarray, width: int, book: Book, most: int) -> list[tuple[int, int]]:
    """For each image its pixels as bits of a whole number, and how many bits. most: pixels of the largest image that may come."""
    image = np.repeat(np.arange(len(sizes)), sizes)
    start, length, dist = matches(px, image)
    covered = np.zeros(len(px) + 1, dtype=np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + length, -1)
    covered = np.cumsum(covered)[:-1] > 0
    covered[start] = False
    token = np.flatnonzero(~covered)
    p = px[token]
    (green, n_green), (red, n_red), (blue, n_blue), (alpha, n_alpha), (far, n_far) = book.codes
    g, r, b, a = (p >> 8 & 255), (p >> 16 & 255), (p & 255), p >> 24
    one, n1 = green[g] | red[r] << n_green[g].astype(np.uint64), n_green[g] + n_red[r]
    two, n2 = blue[b] | alpha[a] << n_blue[b].astype(np.uint64), n_blue[b] + n_alpha[a]
    if book.cache_bits:
        slot = (px * np.uint32(CACHE_HASH)) >> np.uint32(32 - book.cache_bits)
        last = last_equal(image << book.cache_bits | slot)
        hit = np.flatnonzero((last[token] >= 0) & (px[last[token]] == p))
        symbol = 256 + LENGTHS + slot[token[hit]].astype(np.int64)
        one[hit], n1[hit], n2[hit] = green[symbol], n_green[symbol], 0
    if len(start):
        at = np.searchsorted(token, start)
        s, extra, n = (v[length] for v in prefixes(LONGEST))
        one[at], n1[at] = green[256 + s] | extra.astype(np.uint64) << n_green[256 + s].astype(np.uint64), n_green[256 + s] + n
        s, extra, n = (v[distance_codes(width, most)[dist]] for v in prefixes(most + len(NEAR)))
        two[at], n2[at] = far[s] | extra.astype(np.uint64) << n_far[s].astype(np.uint64), n_far[s] + n
    # each token has two entries of up to 32 bits; each image's bits begin with a 32-bit word of its own
    bits, lens = np.stack([one, two], axis=1).ravel(), np.stack([n1, n2], axis=1).ravel()
    bits &= (np.uint64(1) << lens.astype(np.uint64)) - np.uint64(1)
    total = np.cumsum(lens)
    of = np.searchsorted(image[token], np.arange(len(sizes)), "right")
    ends = total[2 * of - 1]
    begins = np.concatenate([[0], ends[:-1]])
    words = (ends - begins + 31 >> 5) + 1
    word_at = np.cumsum(words) - words
    at = total - lens + np.repeat(32 * word_at - begins, 2 * np.diff(of, prepend=0))
    bits <<= (at & 31).astype(np.uint64)
    out = np.bincount(at >> 5, weights=(bits & np.uint64(0xFFFFFFFF)).astype(float), minlength=int(words.sum()))
    out += np.bincount((at >> 5) + 1, weights=(bits >> np.uint64(32)).astype(float), minlength=int(words.sum()))[: len(out)]
    raw = out.astype("<u4").tobytes()
    return [(int.from_bytes(raw[4 * w : 4 * (w + k)], "little"), n) for w, k, n in zip(word_at.tolist(), words.tolist(), (ends - begins).tolist(), strict=True)]


def indexed(pixels: np.ndarray) -> tuple[Writer, np.ndarray, int]:
    """height x width pixels of few colours -> what comes before the packed indexes, these as pixels, and how many are in a row."""
    table, index = np.unique(pixels, return_inverse=True)
    n, width = len(table), pixels.shape[1]
    bits = 3 if n <= 2 else 2 if n <= 4 else 1
    coded = parts(width, bits)
    index = np.pad(index.reshape(pixels.shape), ((0, 0), (0, (coded << bits) - width))).reshape(len(pixels), coded, 1 << bits)
    green = (index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2).astype(np.uint32)
    w, b = Writer(), books()
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(n - 1, 8)
    w.put(0, 1)
    for k in b["table"].lengths:
        w.code(k)
    deltas = np.diff(table.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
    for d in deltas.tolist():
        for channel, v in zip(range(4), (d[1], d[2], d[0], d[3]), strict=True):
            bits_of, size = b["table"].codes[channel]
            w.put(int(bits_of[v]), int(size[v]))
    w.put(0, 1)
    b["index"].put(w)
    return w, (green << 8 | np.uint32(0xFF000000)).ravel(), coded


def encode_images(images: list[np.ndarray], most: int) -> list[bytes]:
    """Images (height x width arrays of 32-bit pixels, one width) as files. most: pixels that an image has at most."""
    if not images:
        return []
    width = images[0].shape[1]
    heights = np.array([len(i) for i in images])
    px = np.concatenate(images).ravel()
    key = np.sort(np.repeat(np.arange(len(images), dtype=np.uint64), heights * width) << np.uint64(32) | px)
    colours = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(32)).astype(np.int64), minlength=len(images))
    out: list[bytes] = [b""] * len(images)
    many = np.flatnonzero(colours > COLOURS)
    if len(many):
        h = heights[many]
        rest, modes, factors = transformed(np.concatenate([images[k] for k in many]).view(np.uint8).reshape(-1, width, 4), h)
        (a, b, c), blocks = heads(), parts(width, BLOCK_BITS)
        n_mode, n_factor = blocks * 2, blocks * 5
        for k, m, f, (value, n) in zip(many.tolist(), modes.tolist(), factors.tolist(), packed(rest, h * width, width, books()["rest"], most), strict=True):
            head = a.value | (m | (b.value | (f | (c.value | value << c.n) << n_factor) << b.n) << n_mode) << a.n
            out[k] = _file(width, int(heights[k]), head, a.n + n_mode + b.n + n_factor + c.n + n)
    for k in np.flatnonzero(colours <= COLOURS).tolist():
        w, green, coded = indexed(images[k])
        ((value, n),) = packed(green, np.array([len(green)]), coded, books()["index"], most)
        out[k] = _file(width, int(heights[k]), w.value | value << w.n, w.n + n)
    return out


def _file(width: int, height: int, bits: int, n: int) -> bytes:
    head = 0x2F | width - 1 << 8 | height - 1 << 22 | 1 << 36
    return wrapped((head | bits << 40).to_bytes(5 + (n + 7 >> 3), "little"))
