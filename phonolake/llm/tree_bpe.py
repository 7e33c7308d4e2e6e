"""BPE encoding and decoding with tree concatenation of long texts.

Ids never reach across ASCII white space in the vocabularies meant here (their pre-tokenizer drops white space), so a
text is the sum of its words. A text longer than a segment is cut at fixed places, words or no words; segments are
encoded as rows of their own, in parallel, and joined two by two. A join has a broken word on either side. Windows
around it are encoded, each twice as wide as the last, until one agrees with what is known on both sides.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import checkpointed, read, small_batches
from phonolake.llm.encoding import Known, slices

WORD_BPE = "word_bpe_49k.json"
#: Characters in a segment, and on each side of a join in the first window.
SEGMENT, WINDOW = 1 << 15, 64


@lru_cache(maxsize=2)
def tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def words_of(file: str) -> Known:
    """The ids of words, one table in each worker."""
    return Known(tokenizer(file), bytes.decode)


@dataclass
class Piece:
    """A stretch of text without white space, its ids and where each begins and ends."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, t, text: str) -> Piece:
        e = t.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return cls(text, np.array(e.ids, dtype="<i4"), at[:, 0], at[:, 1])

    def part(self, a: int, b: int, move: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[a:b], self.starts[a:b] + move, self.ends[a:b] + move


def restarts(text: str, at: int) -> bool:
    """Whether scanning the text from there finds the pre-tokens that scanning it from its start does.

    Runs of letters or of symbols go on to the same end wherever they are entered, but contractions (an apostrophe and up
    to two letters) must not be cut, nor characters from marks that compose with them.
    """
    c = text[at]
    return "'" not in text[max(0, at - 3) : at + 1] and unicodedata.category(c)[0] != "M" and not 0x1160 <= ord(c) <= 0x11FF


def whole_at(p: Piece, k: int) -> bool:
    """Whether id k begins where the one before it has ended, not inside of one character."""
    return k == 0 or p.ends[k - 1] <= p.starts[k]


def joined(t, x: Piece, y: Piece, window: int = WINDOW) -> Piece:
    """The piece of x.text + y.text. Merges look no further than their neighbours: ids of which each two neighbours are
    what their text gives are what the whole text gives, so a window that begins with an id of x and has one in common
    with y continues both. No window is narrower than the strings of added tokens, which are found before all else."""
    window = max(window, *(len(a.content) for a in t.get_added_tokens_decoder().values()))
    text, m = x.text + y.text, len(x.text)
    if not x.text or not y.text:
        return y if not x.text else x
    while True:
        i = int(np.searchsorted(x.starts, m - window, "right")) - 1
        while i > 0 and not (whole_at(x, i) and restarts(text, int(x.starts[i]))):
            i -= 1
        i = max(i, 0)
        begin = int(x.starts[i]) if i else 0
        end = min(len(text), m + window)
        w = Piece.of(t, text[begin:end])
        left = i == 0 or len(w.ids) > 0 and w.ids[0] == x.ids[i] and w.ends[0] + begin == x.ends[i] and w.starts[0] == 0
        if left and end == len(text):
            return Piece(text, *(np.concatenate(c) for c in zip(x.part(0, i, 0), w.part(0, len(w.ids), begin), strict=True)))
        if left:
            at = {int(s): k for k, s in enumerate(w.starts) if whole_at(w, k)}
            for r in range(int(np.searchsorted(y.starts, end - m, "left"))):
                j = at.get(int(y.starts[r]) + m - begin)
                if j is not None and whole_at(y, r) and w.ids[j] == y.ids[r] and w.ends[j] + begin == y.ends[r] + m and restarts(text, int(y.starts[r]) + m):
                    return Piece(text, *(np.concatenate(c) for c in zip(x.part(0, i, 0), w.part(0, j, begin), y.part(r, len(y.ids), m), strict=True)))
        if i == 0 and end == len(text):  # not reached: with the whole text as its window, left holds
            raise AssertionError
        window *= 2


@dataclass
class Segment:
    """Encoded text: the piece before its first white space, ids of the words after that, and the piece after the last
    white space, None if there is no white space."""

    head: Piece
    mid: list[bytes]
    tail: Piece | None


SPACE = re.compile("[\x20\x09-\x0d]")


def segment(words: Known, text: str) -> Segment:
    t, first = words.tokenizer, SPACE.search(text)
    if not first:
        return Segment(Piece.of(t, text), [], None)
    last = max(text.rfind(c) for c in " \t\n\x0b\x0c\r")
    mid = text[first.start() : last].encode().split()
    return Segment(Piece.of(t, text[: first.start()]), words.ids([mid]), Piece.of(t, text[last + 1 :]))


def concatenated(t, p: Segment, q: Segment) -> Segment:
    if p.tail is None:
        return Segment(joined(t, p.head, q.head), q.mid, q.tail)
    middle = joined(t, p.tail, q.head)
    if q.tail is None:
        return Segment(p.head, p.mid, middle)
    return Segment(p.head, [*p.mid, middle.ids.astype("<i4").tobytes(), *q.mid], q.tail)


def tree(t, parts: list[Segment]) -> np.ndarray:
    while len(parts) > 1:
        parts = [concatenated(t, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    (s,) = parts
    return np.frombuffer(b"".join([s.head.ids.astype("<i4").tobytes(), *s.mid, s.tail.ids.astype("<i4").tobytes() if s.tail else b""]), dtype="<i4")


_ROW = "doc_id long, ids array<int>"


def encode_bpe(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", file: str | None = None, segment_chars: int = SEGMENT) -> DataFrame:
    """(doc_id, ids) of each row, in no order: what the tokenizers library gives for the whole text.

    Null texts are empty and give no ids; null ids are ids like any other; rows that come twice come out twice. No rows:
    none come back. The tokenizer must drop white space. Texts beyond segment_chars characters are exploded into
    segments, which are dealt out evenly, encoded, and gathered by document for the tree of joins; a task gathers no more
    than one document's segments at a time.
    """
    file = file or public_tokenizers.path(WORD_BPE)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short, long = d.filter(F.char_length("text") <= segment_chars), d.filter(F.char_length("text") > segment_chars)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of(file)
        for batch in slices(batches, 500):
            each = known.ids([x.encode().split() for x in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *(len(x) >> 2 for x in each)])
            ids = pa.array(np.frombuffer(b"".join(each), dtype="<i4"))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        known = words_of(file)
        for batch in batches:
            yield batch.assign(part=[pickle.dumps(segment(known, x)) for x in batch["text"]]).drop(columns="text")

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import pickle

        copies = int((rows["place"] == 0).sum())  # of a row that comes more than once
        rows = rows.drop_duplicates("place").sort_values("place")
        ids = tree(tokenizer(file), [pickle.loads(x) for x in rows["part"]])
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].repeat(copies), "ids": [ids] * copies})

    cuts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / segment_chars).cast("int"))
    rid = F.sha2(F.col("text").cast("binary"), 256).alias("rid")
    # ids as strings, for pandas has no long that may be null
    segments = long.select(F.col("doc_id").cast("string").alias("doc_id"), rid, F.posexplode(F.transform(cuts, lambda k: F.substr("text", k * segment_chars + 1, F.lit(segment_chars)))).alias("place", "text"))
    segments = segments.repartition("doc_id", "rid", "place").mapInPandas(leaves, "doc_id string, rid string, place int, part binary")
    joined_rows = segments.groupBy("doc_id", "rid").applyInPandas(join, "doc_id string, ids array<int>")
    return short.mapInArrow(encode, _ROW).unionAll(joined_rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"))


def decode_bpe(encoded: DataFrame, *, file: str | None = None) -> DataFrame:
    """Adds decoded to (doc_id, ids): the library's decode(ids, skip_special_tokens=False), '' for no ids."""
    file = file or public_tokenizers.path(WORD_BPE)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(file)
        names = None if t.decoder else np.array([t.id_to_token(k) for k in range(t.get_vocab_size())], dtype=object)
        for batch in slices(batches, 500):
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            if names is None:
                texts = [t.decode(values[a:b].tolist(), skip_special_tokens=False) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            else:  # without a decoder, tokens are joined by spaces
                texts = [" ".join(names[values[a:b]].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"{_ROW}, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, worked out at once with small batches, for two workers hold each."""
    with small_batches(docs.sparkSession):
        return checkpointed(_digests(docs))


def _digests(docs: DataFrame) -> DataFrame:
    out = decode_bpe(encode_bpe(docs))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
