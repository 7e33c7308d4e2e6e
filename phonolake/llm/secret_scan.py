"""Secret scans: fixed patterns, and guess costs of values that stand where credentials stand.

A guesser's dictionary comes from the texts themselves: words are counted over all rows, and rank by their counts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import checkpointed, read
from phonolake.llm.encoding import slices

# The base patterns and the order of the kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "credential")
#: Runs of [0-9a-f]+ with their least length: a run never begins inside another.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")

#: Where credentials stand: a name, a sign or a verb, and a value in quotes or up to white space.
CONTEXT = re.compile(
    r"(?<![a-z0-9])(?:[a-z0-9]*[_-])?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|(?:api|access|auth|private|secret)[_-]?key)[\"']?"
    r"(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|ist|est|es)\x20+|(?<=bearer)\x20+)(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;<>]+))",
    re.IGNORECASE | re.ASCII,
)
#: A context or an assignment has one of these, in either case.
HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "key")

# Frequent words of passwords, the most frequent first, which prose may not have.
COMMON = (
    "password passwort contraseña motdepasse qwerty admin welcome letmein login master dragon monkey football baseball sunshine princess shadow superman "
    "michael jordan iloveyou trustno starwars hello freedom whatever ninja mustang access flower hottie loveme test guest root user changeme default "
    "secret token example sample summer winter spring autumn january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday love money computer internet server system service database company office home "
    "house family mother father sister brother baby angel soccer hockey tiger cookie orange banana apple chocolate pepper ginger silver golden "
    "purple yellow green blue red black white happy lucky magic power music guitar killer hunter ranger batman spider pokemon matrix the and you for your my"
).split()
RANK = {w: k for k, w in enumerate(dict.fromkeys(COMMON), 1)}
#: Letters of a dictionary word.
SHORTEST, LONGEST = 3, 24
MARKS = ".,;:!?\"'()[]{}<>*_-"
PLAIN = str.maketrans("40381!|$579@+€", "aoeBiilssTgate".lower())

ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
PLACES = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row) if c != " "}
DATE = re.compile(r"(?:\d{4}[-/._ ]?\d{2}[-/._ ]?\d{2}|\d{1,2}[-/._ ]\d{1,2}[-/._ ]\d{4}|\d{2}\d{2}(?:19|20)\d\d|(?:19|20)\d\d)")
REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)

#: log10 of the guesses for a character that nothing explains, and for going on to a further segment.
BRUTE, NEXT = 1.0, 0.5


def near(a: str, b: str) -> bool:
    """Whether b is the key beside a or a diagonal neighbour of it."""
    p, q = PLACES.get(a.lower()), PLACES.get(b.lower())
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def spans_of(value: str, ranks: dict[str, int] = RANK) -> Iterator[tuple[int, int, float]]:
    """Stretches that a guesser has in a list or a rule, with the log10 of the guesses."""
    low, n = value.lower(), len(value)
    plain = low.translate(PLAIN)
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            if rank := ranks.get(low[i:j]) or ranks.get(plain[i:j]):
                own = value[i:j]
                forms = 0 if own == own.lower() else math.log10(2) if own[1:] == own[1:].lower() or own == own.upper() else math.log10(2) * len(own) / 2
                yield i, j, math.log10(rank + 1) + forms + math.log10(4) * (low[i:j] != plain[i:j] and low[i:j] not in ranks)
    for m in DATE.finditer(value):
        years = [abs(int(y) - 2000) for y in re.findall(r"(?:19|20)\d\d", m[0])]
        yield m.start(), m.end(), math.log10(max(20, min(years, default=50)) * (1 if len(m[0]) == 4 else 365))
    for m in REPEAT.finditer(value):
        yield m.start(), m.end(), BRUTE * len(m[1]) + math.log10(len(m[0]) // len(m[1]))
    k = 0
    while k < n - 1:
        j, turns, way = k + 1, 0, None
        while j < n and near(value[j - 1], value[j]):
            p, q = PLACES[value[j - 1].lower()], PLACES[value[j].lower()]
            step = (q[0] - p[0], q[1] - p[1])
            turns, way, j = turns + (step != way), step, j + 1
        if j - k >= 3:
            yield k, j, math.log10(len(PLACES)) + turns * math.log10(8) + math.log10(j - k)
        k = max(j - 1, k + 1)
    k = 0
    while k < n - 2:  # abcdef, 98765
        step, j = ord(value[k + 1]) - ord(value[k]), k + 1
        while j < n and abs(step) == 1 and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if j - k >= 3:
            yield k, j, math.log10(26 * 2) + math.log10(j - k)
        k = max(j - 1, k + 1)


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for value: the least sum over its segmentations into words, dates, repeats, walks over the
    keyboard, sequences and stretches of brute force. best[i] is the least sum for the first i characters."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in spans_of(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    best, brute = [0.0], [math.inf]  # brute[i]: the same, if a stretch of brute force ends at i
    for j in range(1, len(value) + 1):
        forced = BRUTE + min(brute[j - 1], best[j - 1] + (NEXT if j > 1 else 0.0))
        best.append(min([forced, *(best[i] + cost + (NEXT if i else 0.0) for i, cost in ends.get(j, ()))]))
        brute.append(forced)
    return best[-1]


def scan(text: str, least_cost: float, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], float]:
    """(start, number of kind, end) in order, and the highest guess cost of a credential's value, 0 if there is none."""
    found, most = [], 0.0
    low = text.lower()
    if hinted := any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    if hinted:
        base = sorted((a, b) for a, _, b in found)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            cost = guess_cost(text[a:b], ranks)
            if cost >= least_cost:
                most = max(most, cost)
                k = bisect_right(starts, a)
                if not k or reach[k - 1] < b:  # no base span has it whole
                    found.append((a, 3, b))
    return sorted(found), most


def without_credentials(text: str) -> str:
    """A text in lower case, with a space in place of the values that stand where credentials stand."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return low
    values = sorted([m.span(m.lastindex) for m in CONTEXT.finditer(text)] + [m.span(2) for m in ASSIGN.finditer(text)])
    parts, at = [], 0
    for a, b in values:
        parts.append(text[at : max(a, at)])
        at = max(at, b)
    return " ".join([*parts, text[at:]]).lower()


def word_ranks(docs: DataFrame, *, text: str = "text", dict_words: int = 50_000, least_count: int = 3) -> dict[str, int]:
    """The dict_words words that the most different texts have, with their ranks, a guesser's list, and those of COMMON.

    A word is what stands between white space, in lower case and without MARKS around it, that is SHORTEST to LONGEST letters and
    in least_count texts. Rows with equal texts (by a hash, and the same words) are one text, so copies add nothing; values where credentials stand are left out, so that a
    leaked one does not become a cheap word, however many texts leak it. Words that as many texts have come in the
    order of a hash, and of their code points. Null and empty texts have no words; no rows: the words of COMMON alone. Other columns are not looked at.
    The driver gets the list, and sizes of parts of the counts, both of bounded size.
    """

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, known, codec = [], {}, pa.Codec("zstd")
            for t in batch.column("t").to_pylist():
                tokens = set(without_credentials(t).split())
                for token in tokens.difference(known):
                    word = token.strip(MARKS)
                    known[token] = word if SHORTEST <= len(word) <= LONGEST and word.isalpha() else ""
                own = " ".join(sorted(set(map(known.__getitem__, tokens)))).encode()
                out.append(len(own).to_bytes(4, "little") + codec.compress(own, asbytes=True))
            yield pa.record_batch([batch.column("h"), pa.array(out, pa.binary())], names=["h", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, codec = Counter(), pa.Codec("zstd")
            for packed in batch.column("words").to_pylist():
                words.update(codec.decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True).decode().split(" "))
            words.pop("", None)
            yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    # a text's words, packed, go to where its copies' do, not the text
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).filter("t <> ''").mapInArrow(words_of, "h long, words binary").distinct()
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    counts = checkpointed(counts.select("word", "n", F.floor(16 * F.log2("n")).cast("int").alias("band"), F.xxhash64("word").alias("h")))
    chosen, left, part = F.lit(False), dict_words, F.lit(True)
    # the band of counts, then the count, then the part of the hash space that the last word is in
    for level in (-F.col("band"), -F.col("n"), F.shiftrightunsigned("h", 52)):
        for r in sorted(counts.filter(part).groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()):
            if r["words"] > left:
                chosen, part = chosen | (part & (level < r["level"])), part & (level == r["level"])
                break
            left -= r["words"]
        else:
            chosen, part = chosen | part, F.lit(False)
            break
    found = counts.filter(chosen).select("word", "n").collect()
    found += counts.filter(part).orderBy("h", "word").limit(left).select("word", "n").collect()
    ranks = {w: k for k, (_, w) in enumerate(sorted((-r["n"], r["word"]) for r in found), 1)}
    return {w: min(ranks.get(w, k), k) for w, k in RANK.items()} | {w: k for w, k in ranks.items() if w not in RANK}


def secret_scan(docs: DataFrame, ranks: dict[str, int] | None = None, *, text: str = "text", doc_id: str = "doc_id", least_cost: float = 10.0) -> DataFrame:
    """One row per row of docs: doc_id, spans (array of kind, start, end in code points, end exclusive), guess_cost.

    assign, access and hex spans are those of the base patterns. A credential span is a value in a credential's context
    that takes 10^least_cost guesses or more with the words of ranks (word_ranks; those of COMMON, if none are given), unless one
    base span holds all of it; it may reach beyond base spans that it overlaps. guess_cost: the highest such cost, base
    spans' values included. Spans of one start come in the order of kinds. Texts are scanned whole, in time that grows with their
    length. Null and empty texts have no spans; null ids and repeated rows are rows like any other; no rows: none
    come back; other columns are not looked at.
    """
    ranks = ranks or RANK

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            each = [scan(t or "", least_cost, ranks) for t in batch.column("text").to_pylist()]
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x, _ in each], kind)
            yield pa.record_batch([batch.column("doc_id"), spans, pa.array([c for _, c in each], pa.float64())], names=["doc_id", "spans", "guess_cost"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>, guess_cost double")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = secret_scan(docs, word_ranks(docs))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "credential")
    return out.select("doc_id", *counts[:3], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), counts[3], F.round("guess_cost", 3).alias("guess_cost"))
