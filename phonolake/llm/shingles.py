"""Sets of hashed word shingles."""

from __future__ import annotations

import hashlib

import numpy as np

#: Fixed values of the hash: a multiplier for words in a shingle, and mixing constants.
TURN = np.uint64(0xD6E8FEB86659FD93)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: White space of the contracts, as bytes.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed by blake2b.
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


#: Bytes that are hashed at a time; a piece ends with the last white space in it.
PIECE = 1 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and where each text's words begin, with a last end."""
    parts = [t.encode().lower() if t else b"" for t in texts]
    b = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    found, start = [], 0
    while start < len(b):
        end = min(len(b), start + PIECE)
        while not IS_SPACE[b[end - 1]]:  # a word as long as a piece
            more = np.flatnonzero(IS_SPACE[b[end : end + PIECE]])
            end = end + int(more[0]) + 1 if len(more) else min(len(b), end + PIECE)
        found.append(_hashes(b[start:end], start))
        start = end
    at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return np.concatenate([h for h, _ in found]), np.searchsorted(np.concatenate([x for _, x in found]), at)


def _hashes(b: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes that end with white space, and where they begin, counted from start.

    Eight bytes at a time are mixed in, each step one-to-one, so that words of one length and up to eight bytes never
    share a hash; nothing of it is linear in the bytes.
    """
    space = IS_SPACE[b]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = ends - begins
    raw = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(b) + 1,), dtype="<u8", buffer=raw, strides=(1,))
    h = mixed(size.astype(np.uint64) * MIX2 + TURN)
    left = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        h[left] = mixed(h[left] ^ (eight[begins[left] + k] & MASKS[np.minimum(size[left] - k, 8)]))
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(b[begins[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h, begins + start


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of width words in a row; of all its words, if it has fewer; or none."""
    h, at = word_hashes(texts)
    rows = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rows = rows * TURN + h[k : k + len(rows)]
    rows = mixed(rows)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(rows[a : z - width + 1]))
        elif z > a:
            x = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for y in h[a:z]:
                    x = x * TURN + y
            out.append(mixed(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
