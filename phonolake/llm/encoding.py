"""Token ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import ctypes
import os
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import public_tokenizers

#: The byte-level vocabulary, in the form of each library.
BYTE_BPE = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
#: Characters of a word, or of white space beyond one between words, from which on a text is left to the tokenizers library.
RUN = 4096
#: Pieces whose ids a worker keeps, and the length beyond which a piece is not kept.
KEEP, KEEP_CHARS = 200_000, 64


def vocabulary() -> tuple[str, str]:
    return tuple(map(public_tokenizers.path, BYTE_BPE))


class ByteEncoder:
    """The ids that the tokenizers library gives for its file, added tokens in the text included, unless their strings are plain_specials.

    The same vocabulary as ranks gives the same ids in a part of the time. The tokenizers library itself gets texts with an added
    token's string, which is found before all else, and those with long runs: splitting these by the pattern with the other
    library needs a stack that grows with the run, and ends in an error.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(tokenizer_file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = plain_specials
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if not (plain_specials and t.special)]

    def plain(self, text: str) -> bool:
        words = text.split()
        sizes = list(map(len, words))
        return max(sizes, default=0) < RUN and len(text) - sum(sizes) < len(words) + RUN and not any(t in text for t in self.added)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers; none for no text."""
        quick = self.quick.encode_to_numpy
        return [b"" if not t else quick(t, disallowed_special=()).tobytes() if self.plain(t) else encoded(self.whole, [t])[0] for t in texts]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.packed(texts)]


class Known:
    """Ids of pieces, kept from batch to batch: those of the first keep that come and are short, which frequent ones are among.

    Once there are so many, and more than half of a batch's words are others, for instance in another language, it begins anew.
    """

    def __init__(self, tokenizer, text_of: Callable, keep: int = KEEP) -> None:
        self.tokenizer, self.text_of, self.keep, self.known = tokenizer, text_of, keep, {}

    def ids(self, texts: list[list]) -> list[bytes]:
        """For texts as lists of pieces, of which text_of gives the text, their ids as little-endian 32-bit integers."""
        known, pieces = self.known, set().union(*texts)
        new = [p for p in pieces if p not in known]
        if len(known) >= self.keep and 2 * len(new) > len(pieces):
            known.clear()
            new = list(pieces)
        new.sort(key=len)  # long ones last
        short = bisect_right(new, KEEP_CHARS, key=len)
        room = max(min(self.keep - len(known), short), 0)
        known.update(zip(new, encoded(self.tokenizer, list(map(self.text_of, new))), strict=True))
        out = [b"".join(map(known.__getitem__, t)) for t in texts]
        for p in new[room:]:
            del known[p]
        return out


def encoded(tokenizer, pieces: list[str], most_chars: int = 1 << 20) -> list[bytes]:
    """For each piece the ids that the tokenizer gives for it alone, as little-endian 32-bit integers.

    An added token is found before all else, and what stands on its sides is encoded apart: many pieces go to the tokenizer
    as one text with an added token between them, and its id tells where each one's ids end.
    """
    between = next(((k, t.content) for k, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
    ids_of = lambda texts: [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if between is None:
        return [x.tobytes() for x in ids_of(pieces)] if pieces else []
    number, sign = between
    out, start = [b""] * len(pieces), 0
    alone = [k for k, p in enumerate(pieces) if sign in p]
    for k, x in zip(alone, ids_of([pieces[k] for k in alone]) if alone else [], strict=True):
        out[k] = x.tobytes()
    rest = [k for k, p in enumerate(pieces) if sign not in p] if alone else range(len(pieces))
    sizes = np.cumsum([len(pieces[k]) for k in rest])
    while start < len(rest):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most_chars, "right")))
        (ids,) = ids_of([sign.join(pieces[k] for k in rest[start:end])])
        raw, cut = ids.tobytes(), np.flatnonzero(ids == number) * 4
        for k, a, z in zip(rest[start:end], [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True):
            out[k] = raw[a:z]
        start = end
    return out


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, ranks_file: str) -> ByteEncoder:
    """One in each worker."""
    return ByteEncoder(tokenizer_file, ranks_file)


def slices(batches: Iterator, rows: int = 1000, most_bytes: int = 8 << 20) -> Iterator:
    """Arrow batches of at most so many rows and, unless one row alone has more, bytes, so that what is made of them stays small;
    what they took is given back at the end."""
    import pyarrow as pa

    for batch in batches:
        todo = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # elsewhere than with glibc
        ctypes.CDLL(None).malloc_trim(0)
