"""Importance resampling, cross-tokenizer alignment and the quality classifier, against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import CLASHES, rows
from tokenizers import Tokenizer

from phonolake.llm import importance, quality_classifier, queries, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = (*CLASHES, "score", "predicted", "own_text", "told", "rank", "weight", "pairs", "groups", "is_total")


def documents():
    r = random.Random(4)
    prose = " ".join(r.choice("the of and river stone garden night walks sees every".split()) for _ in range(60_000))
    odd = [prose, "x" * 9000, " \n \n a", "a ▁ b", "tab\t b\x00c", "<s>hi</s> <|endoftext|> <0x0A>", "é😀 ﬁ  x　y\r\n﻿A", "\x1c x\x1c!\x1c y \xa0 z", "don't  stop\n\n  it's"]
    return rows() + [(30_000 + k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("new")
    spark.createDataFrame(documents(), SCHEMA).withColumns({c: F.lit(k) for k, c in enumerate(CLASH) if c not in ("n_chars",)}).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the river of stone"), (2, None), (3, "garden night")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0), (30_000, 7, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def collected(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


# 11


def brute_importance(docs, target, n_max=1, buckets=10_000, percent=10, least=20):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    hashed = lambda t: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for w in [words(t)] for n in range(1, n_max + 1) for k in range(len(w) - n + 1)]
    own, s, t = [hashed(x) for _, x in docs], Counter(), Counter()
    for b in own:
        s.update(b)
    for x in target:
        t.update(hashed(x))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * float(n_s)) / ((s[b] + 1) * float(n_t)))) for b in s}
    out = []
    for (i, x), b in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        out.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], (ranks.get(r[:4]) or None) and ranks[r[:4]].pop(0)) for r in out), key=repr)


@pytest.mark.parametrize(("n_max", "percent"), [(1, 10), (3, 40), (2, 100)])
def test_importance(spark, folder, n_max, percent):
    docs, target = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = importance.importance_resampling(docs, target, max_n=n_max, percent=percent)
    assert collected(got, "doc_id", "n_features", "weight", "score", "rank") == brute_importance([d[:2] for d in documents()], ["the river of stone", None, "garden night"], n_max, percent=percent)


def test_importance_query_and_sql(spark, folder):
    got = queries.QUERIES["op11_importance"](spark, folder)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.sql(importance.OP11_SQL)
    assert collected(got, *want.columns) == sorted(want.fetchall(), key=repr)


def test_importance_of_equal_rows_and_few(spark):
    """Rows that are equal get ranks one after the other; nothing is drawn of too few rows or without target; empty tables give none."""
    text = "word " * 25
    d = spark.createDataFrame([(7, text)] * 30 + [(8, text + "more")] * 3 + [(None, text)], "doc_id long, text string")
    t = spark.createDataFrame([("word",)], "text string")
    got = importance.importance_resampling(d, t, percent=50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 18))
    assert collected(got, "doc_id", "n_features", "weight", "score", "rank") == brute_importance([(r[0], r[1]) for r in d.collect()], ["word"], percent=50)
    assert importance.importance_resampling(d.limit(3), t.filter("1 = 0")).filter("rank is not null").count() == 0
    assert importance.importance_resampling(d.filter("1 = 0"), t).count() == 0


# 12


@lru_cache(maxsize=1)
def libraries():
    a_lib, b_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    return a_lib, b_lib


def brute_alignment(docs):
    a_lib, b_lib = libraries()
    of, out, count = token_alignment.byte_level(), [], Counter()
    for i, t in docs:
        row = (i, 0, 0, 0, [], "")
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        parts = [[bytes(of[c] for c in a_lib.id_to_token(k)) for k in a]]
        parts.append([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b)])
        if t and b"".join(parts[0]) == b"".join(parts[1]) == (" " + t).encode():
            ends = [np.cumsum(list(map(len, p))).tolist() for p in parts]
            links, groups, x, y, j = [], [], 0, 0, 0
            for k, end in enumerate(ends[0]):
                start = end - len(parts[0][k])
                while ends[1][j] <= start:
                    j += 1
                m = j
                while m < len(b) and ends[1][m] - len(parts[1][m]) < end:
                    links.append((a[k], b[m]))
                    m += 1
            for cut in sorted(set(ends[0]) & set(ends[1])):
                u, v = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
                x, y = u, v
            count.update(links)
            row = (i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        out.append(row)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, na, nb, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), h) for i, na, nb, g, ls, h in out), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, folder):
    # long texts by the plain way take too long
    docs = [d[:2] for d in documents() if len(d[1] or "") < 30_000]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_alignment(docs)
    assert collected(token_alignment.token_alignment(d), *COLUMNS) == want
    groups = token_alignment.aligned_groups(d).filter("not is_total")
    assert all(r["groups"].count(";") + 1 == r["n_groups"] and sum(r["counts"]) == r["n_links"] for r in groups.filter("n_a > 0").collect())
    assert token_alignment.token_alignment(d.filter("1 = 0")).count() == 0
    got = queries.QUERIES["op12_alignment"](spark, folder)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in COLUMNS} and got.count() == len(documents())


def test_alignment_by_segments(monkeypatch):
    """Texts of odd white space and marks by segments, few of which are kept, as whole texts give it."""
    monkeypatch.setattr(token_alignment, "KEEP", 20)
    monkeypatch.setattr(token_alignment, "TOGETHER", 7)
    own = token_alignment.Aligner(*token_alignment.vocabulary(), public_tokenizers.path(token_alignment.PIECES))
    r = random.Random(8)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "'s", "n't", "!", "...", "12", "▁", "\x1c", "\xa0", "　", "ﬁ", "😀", "<s>", "<|endoftext|>", "\r\n", "\x00", " ", "ß"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(40)]
        got, (pairs, counts) = own.texts(texts)
        total = Counter()
        for t, (n_a, n_b, n_groups, n_links, _, p, c) in zip(texts, got, strict=True):
            ((_, *want),) = brute_alignment([(0, t)])
            assert [n_a, n_b, n_groups, n_links] == want[:4], t
            total.update(dict(zip(p.tolist(), c.tolist(), strict=True)))
        assert total == Counter(dict(zip(pairs.tolist(), counts.tolist(), strict=True))) and len(own.table.number) <= 20


def test_rare_pairs_are_joined(spark, folder):
    """Sums are the same whether pairs are frequent, and go to all tasks, or not."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) < 5000")
    made = token_alignment.aligned_groups(docs)
    counts = token_alignment.link_counts(made.filter("is_total").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")))
    rows_ = made.filter("not is_total").select(F.xxhash64("doc_id", "groups").alias("rid"), "pairs", "counts").dropDuplicates(["rid"]).cache()
    each = [collected(token_alignment.link_sums(rows_, counts, share), "rid", "n_best", "count_sum") for share in (0.0, 1e-3, 2.0)]
    assert each[0] == each[1] == each[2] and len(each[0]) == rows_.count()


# 13


def test_machine_is_the_sum_over_pairs():
    """The linear-time identity against the sum over all pairs of features."""
    r = np.random.default_rng(3)
    m = quality_classifier.Machine(0.3, r.normal(size=quality_classifier.SIZE), r.normal(size=(quality_classifier.SIZE, 4)))
    texts = ["", None, "One two two three!", "a\nb\nb", "ÉÈ *** | x"]
    index, value, at = quality_classifier.features(texts, [0, None, 18, 5, 99], quality_classifier.Buckets())
    for k in range(len(texts)):
        i, x = index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]
        pairs = sum(m.vectors[i[p]] @ m.vectors[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert m.logits(index, value, at)[k] == pytest.approx(0.3 + m.weights[i] @ x + pairs)


def test_held_out_accuracy(spark):
    """Labels that were kept from training, on the small table: nearly all right; scores do not depend on ids, sources, languages or labels."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality"](spark, sf)
    assert [c for c, _ in got.dtypes] == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    d = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (d["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in d["doc_id"]]).all() and got.count() == 1000
    h = d[d["held_out"]]
    assert len(h) > 50 and (h["predicted"] == h["quality"]).mean() > 0.97 and (d["predicted"] == (d["score"] >= 0.7)).all()
    assert h[h["quality"] == 1]["predicted"].mean() > 0.98


def test_scores_of_odd_rows(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    m = quality_classifier.train(docs, labels)
    got = quality_classifier.quality_scores(docs, m)
    assert got.columns == [*docs.columns, "_score", "_predicted"] and got.count() == docs.count()
    assert got.filter("_score between 0 and 1 and _predicted in (0, 1)").count() == docs.count()
    same = got.groupBy("text", "n_chars").agg(F.countDistinct("_score").alias("n"))
    assert same.filter("n > 1").count() == 0
    assert quality_classifier.quality_scores(docs.filter("1 = 0"), m).count() == 0
    # one label alone, or none: the share of label 1
    one = quality_classifier.train(docs, labels.filter("quality = 1"))
    none = quality_classifier.train(docs, labels.filter("1 = 0"))
    assert {r["s"] for r in quality_classifier.quality_scores(docs, none).select(F.col("_score").alias("s")).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs, one).agg(F.min("_score")).first()[0] > 0.9
    # labels of rows that are held out train nothing
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert np.array_equal(quality_classifier.train(docs, held).weights, none.weights)
