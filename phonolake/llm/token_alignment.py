"""Alignment of two tokenizers: token groups between the places where tokens of both end, and how often ids are linked.

Each byte of a text has a label that says whether a token of A, of B, or of both ends there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.llm.common import read, shared_folder
from phonolake.llm.encoding import KEEP_CHARS, ByteEncoder, slices, vocabulary

PIECES = "piece_bpe_32k.model"
#: Labels of a byte: no token ends there, one of A, one of B, one of each.
NONE, A_END, B_END, BOTH = b"-", b"a", b"b", b"x"
LABELS = np.frombuffer(NONE + A_END + B_END + BOTH, dtype=np.uint8)
GROUP = re.compile(rb"[^x]*x")
#: Where no token of either tokenizer goes across: before a space or line end after anything but white space.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Distinct segments that are encoded as one text; a longer one takes more time for each of them.
TOGETHER = 2000
#: Segments that a worker keeps.
KEEP = 400_000
#: An id pair is a long: A's id in the upper bits, B's id in the lower ones.
B_BITS = 32


@lru_cache(maxsize=1 << 16)
def ends_in(group: bytes) -> tuple[int, int]:
    """How many tokens of A and of B end in a group of labels."""
    return group.count(A_END) + group.count(BOTH), group.count(B_END) + group.count(BOTH)


def byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def grown(values: np.ndarray, n: int) -> np.ndarray:
    """values with room for n rows, at least twice as many as before if there was none."""
    if n <= len(values):
        return values
    out = np.zeros((max(n, 2 * len(values)), *values.shape[1:]), dtype=values.dtype)
    out[: len(values)] = values
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of so many values from each start on, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Aligned:
    """What distinct segments have, by their numbers: sums to the end of each one (from 0 on), groups as text, id pairs of links, and whether they have tokens."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.sums, self.groups, self.links, self.good = np.zeros((1, 4), dtype=np.int64), [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def add(self, segments: list[str], sums: np.ndarray, groups: list[str], links: np.ndarray, good: bool) -> None:
        n, m = len(self.groups), len(self.groups) + len(segments)
        self.number |= {s: k for k, s in enumerate(segments, n)}
        self.groups += groups
        self.sums, self.good = grown(self.sums, m + 1), grown(self.good, m)
        self.sums[n + 1 : m + 1], self.good[n:m] = self.sums[n] + sums, good
        self.links = grown(self.links, self.sums[m, 3])
        self.links[self.sums[n, 3] : self.sums[m, 3]] = links

    def keep(self, n: int, new: list[str]) -> None:
        """Forgets those of the new segments that are beyond the first n of all."""
        for s in new:
            if self.number[s] >= n:
                del self.number[s]
        del self.groups[n:]


class Aligner:
    """Both tokenizers with the bytes of their tokens; one in each worker."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pieces_file: str) -> None:
        import sentencepiece

        self.a = ByteEncoder(tokenizer_file, ranks_file, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        of = byte_level()
        vocab = self.a.whole.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.table = Aligned()
        # texts may be cut if B has no piece with a space or line end after something else, as A's pattern has none
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def segments(self, text: str) -> list[str]:
        """A space and text, cut where no token goes across; nothing for no text."""
        return [] if not text else CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A and of B for segments one after the other; None if the bytes of either's tokens are not theirs."""
        text = "".join([" a" * self.cuts, *segments])
        a, b = self.a.ids([text])[0].tolist(), self.b.encode(text[1:])
        if not b"".join(map(self.a_bytes.__getitem__, a)) == text.encode() == b"".join(map(self.b_bytes.__getitem__, b)):
            return None
        return np.array(a[self.cuts :], dtype=np.int64), np.array(b[self.cuts :], dtype=np.int64)

    def label(self, segments: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The sums (tokens of A, of B, groups, links) to each segment's end, each one's groups as text, and the id pair of each link, in order.

        The bytes between two neighbouring ends, of whichever tokenizer, are what one token of A and one of B share.
        """
        ends_a, ends_b = np.cumsum(self.a_sizes[a]) - 1, np.cumsum(self.b_sizes[b]) - 1
        label = np.zeros(ends_a[-1] + 1, dtype=np.uint8)
        label[ends_a] = 1
        label[ends_b] += 2
        names_a, names_b = [self.a_names[k] for k in a.tolist()], [self.b_names[k] for k in b.tolist()]
        written, i, j = [], 0, 0
        for n, m in map(ends_in, GROUP.findall(LABELS[label].tobytes())):
            written.append(names_a[i] + "|" + names_b[j] if n == m == 1 else ",".join(names_a[i : i + n]) + "|" + ",".join(names_b[j : j + m]))
            i, j = i + n, j + m
        at = np.cumsum([len(s.encode()) for s in segments]) - 1
        places = (ends_a, ends_b, np.flatnonzero(label == 3), np.flatnonzero(label))
        sums = np.stack([np.searchsorted(p, at, "right") for p in places], axis=1)
        cut = [0, *sums[:, 2].tolist()]
        ends = label[label > 0]
        of_a, of_b = (np.cumsum(ends & bit > 0) - (ends & bit > 0) for bit in (1, 2))
        return sums, [";".join(written[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], a[of_a] << B_BITS | b[of_b]

    def align(self, segments: list[str], out: Aligned) -> None:
        """Adds distinct segments to out: all at once, or in halves where one of them has other bytes than its tokens; this one has no tokens.

        What ends in white space must come alone, for it can't be cut from what follows.
        """
        if found := self.encode(segments) if len(segments) == 1 or self.cuts else None:
            out.add(segments, *self.label(segments, *found), True)
        elif len(segments) == 1:
            out.add(segments, np.zeros((1, 4), dtype=np.int64), [""], np.zeros(0, dtype=np.int64), False)
        else:
            half = len(segments) // 2
            self.align(segments[:half], out)
            self.align(segments[half:], out)

    def texts(self, texts: list[str]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """For each text (n_a, n_b, n_groups, n_links, groups, pairs, counts), and the pairs and counts of all texts.

        Each distinct segment of all texts is encoded once, and so are the first KEEP that are short over all calls. If these are there, and
        more than half of a call's segments are others, all are forgotten.
        """
        parts, table = [self.segments(t) for t in texts], self.table
        distinct = set().union(*parts)
        new = [s for s in distinct if s not in table.number]
        if len(table.number) >= KEEP and 2 * len(new) > len(distinct):
            table, new = Aligned(), list(distinct)
            self.table = table
        new.sort(key=len)  # long ones last
        apart = [s for s in new if s[-1].isspace()]
        plain = [s for s in new if not s[-1].isspace()]
        before = len(table.number)
        for k in range(0, len(plain), TOGETHER):
            self.align(plain[k : k + TOGETHER], table)
        for s in apart:
            self.align([s], table)
        lengths = np.array(list(map(len, parts)))
        codes = np.array(list(map(table.number.__getitem__, chain.from_iterable(parts))), dtype=np.int64)
        whole = np.ones(len(texts), dtype=bool)
        whole[np.repeat(np.arange(len(texts)), lengths)[~table.good[codes]]] = False
        codes, ends = codes[np.repeat(whole, lengths)], np.concatenate([[0], np.cumsum(lengths * whole)])
        sizes = table.sums[codes + 1] - table.sums[codes]
        totals = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(sizes, axis=0)])[ends]
        each = table.links[spans(table.sums[codes, 3], sizes[:, 3])]
        numbers, cuts, out = codes.tolist(), ends.tolist(), []
        for k, n in enumerate((totals[1:] - totals[:-1]).tolist()):
            groups = ";".join(map(table.groups.__getitem__, numbers[cuts[k] : cuts[k + 1]]))
            out.append((*n, groups, *np.unique(each[totals[k, 3] : totals[k + 1, 3]], return_counts=True)))
        used, times = np.unique(codes, return_counts=True)
        sizes = table.sums[used + 1, 3] - table.sums[used, 3]
        pairs, which = np.unique(table.links[spans(table.sums[used, 3], sizes)], return_inverse=True)
        counts = np.bincount(which, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        table.keep(before + min(max(KEEP - before, 0), bisect_right(plain, KEEP_CHARS, key=len)), new)
        return out, (pairs, counts)


@lru_cache(maxsize=2)
def aligner(*files: str) -> Aligner:
    """One in each worker."""
    return Aligner(*files)


def aligned_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", files: tuple[str, str, str] | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups ('a1,a2|b1;a3|b2,b3', ids in order), and pairs with
    their counts: the distinct linked (A id, B id) as longs, ascending. With digests, groups are SHA-256 digests, but for empty ones.

    There are also rows with is_total, whose pairs and counts are the sums of some of the others.
    Each text is encoded whole, by A with a space before it and by B, which puts one there itself; special tokens' strings are
    plain text. Null and empty texts, and those that the joined bytes of A's or B's tokens differ from (B writes U+2581 and spaces alike),
    have no tokens: zeros, an empty string and empty arrays. Null ids and repeated rows are rows like any other; no rows: none
    come back; other columns are not looked at.
    """
    files = files or (*vocabulary(), public_tokenizers.path(PIECES))
    kinds = [pa.bool_()] + [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["is_total", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files)
        for batch in slices(batches, 1000, 2 << 20):
            each, total = own.texts([t or "" for t in batch.column("text").to_pylist()])
            rows = []
            for i, (*n, groups, pairs, counts) in zip(batch.column("doc_id").to_pylist(), each, strict=True):
                rows.append((False, i, *n, hashlib.sha256(groups.encode()).hexdigest() if digests and groups else groups, pairs, counts))
            rows.append((True, *[None] * 6, *total))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(encode, "is_total boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<long>")


def link_counts(pairs: DataFrame) -> DataFrame:
    """(pair, links, is_best) of (pair, n): all links of an id pair, and whether none of its B id's pairs has more.

    A B id meets as many A ids at most as A's vocabulary has, so its window is bounded. No rows: none come back.
    """
    sums = pairs.groupBy("pair").agg(F.sum("n").alias("links"))
    most = F.max("links").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))))
    return sums.select("pair", "links", (F.col("links") == most).alias("is_best"))


def link_sums(rows: DataFrame, counts: DataFrame, share: float = 1e-5) -> DataFrame:
    """rows (rid, pairs, counts; rid unique) with n_best and count_sum from counts, as link_counts gives them.

    Pairs with that share of all links are fewer than 1 / share; they go to all tasks as sorted arrays. What a row's other
    pairs add is found by a join on the pair, none of which is frequent. Rows without pairs get zeros.
    """
    total = counts.agg(F.sum("links").alias("n")).first()["n"] or 0
    least = total * share
    hot = sorted((r["pair"], r["links"], r["is_best"]) for r in counts.filter(F.col("links") > least).collect())
    pair, links, best = (np.array([x[k] for x in hot], dtype=np.int64) for k in range(3))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2500):
            offsets = batch.column("pairs").offsets.to_numpy()
            values, n = (batch.column(c).flatten().to_numpy() for c in ("pairs", "counts"))
            ends = offsets - offsets[0]
            at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
            is_hot = pair[at] == values if len(pair) else np.zeros(len(values), dtype=bool)
            until = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
            sums = [np.diff(until(np.where(is_hot, x[at] * n, 0) if len(pair) else 0 * n)) for x in (best, links)]
            left = pa.array(until(~is_hot).astype(np.int32))
            yield pa.record_batch([batch.column("rid"), *map(pa.array, sums), *(pa.ListArray.from_arrays(left, pa.array(x[~is_hot])) for x in (values, n))], names=["rid", "n_best", "count_sum", "pairs", "counts"])

    first = rows.select("rid", "pairs", "counts").mapInArrow(known, "rid long, n_best long, count_sum long, pairs array<long>, counts array<long>")
    # one pass for both: a row's sums over frequent pairs stand beside its other pairs, as a pair of their own
    own = F.struct(F.lit(None).cast("long").alias("pairs"), F.lit(None).cast("long").alias("counts"))
    each = first.select("rid", "n_best", "count_sum", F.explode(F.array_append(F.arrays_zip("pairs", "counts"), own)).alias("x"))
    each = each.select("rid", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"), F.when(F.col("x.pairs").isNull(), F.col("n_best")).alias("n_best"), F.when(F.col("x.pairs").isNull(), F.col("count_sum")).alias("count_sum"))
    other = each.filter("pair is not null").join(counts.filter(F.col("links") <= least), "pair").select("rid", F.when(F.col("is_best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    return each.filter("pair is null").select("rid", "n_best", "count_sum").unionByName(other).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    aligned_groups is written to the shared folder, with digests in place of the groups; id pairs are counted over all rows. n_best: links
    whose pair has the most links of its B id; count_sum: the sum of the counts of a row's links. Odd rows are as aligned_groups has them, with zeros here too.
    """
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "aligned")
    made = aligned_groups(docs, text=text, doc_id=doc_id, files=files, digests=True).withColumnRenamed("groups", "groups_sha256")
    made.withColumn("rid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored, counted = spark.read.parquet(path), shared_folder(spark, "link-counts")
    totals = stored.filter("is_total").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    link_counts(totals.select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))).write.parquet(counted)
    rows = stored.filter("not is_total")
    sums = link_sums(rows, spark.read.parquet(counted))
    return rows.drop("is_total", "pairs", "counts").join(sums, "rid").drop("rid")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))
