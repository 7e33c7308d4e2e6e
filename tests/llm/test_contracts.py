"""The registered queries, with all columns that they promise, against brute force over odd documents; and over empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_base, brute_join, brute_links, brute_quality, low, rows, words
from tokenizers import Tokenizer

from phonolake.llm import media_columns, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(21)
    prose = " ".join(r.choice("the of and river stone garden night walks sees every".split()) for _ in range(170_000))
    long = [prose, prose, " " * 1_100_000, "x" * 300_000, "é\n" * 200_000, "pwd: " + "".join(r.choices("xkqz9#7", k=100_000))]
    return rows() + [(20_000 + k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(long)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://a.example.de/x", "<html lang=de><p>der die das"), (2, "http://a.example.de/x", "<html lang=de><p>der die das")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def got(spark, folder, name, *columns):
    df = queries.QUERIES[name](spark, folder)
    assert set(columns) <= set(df.columns)
    kinds = dict(df.dtypes)
    assert all(kinds[c] in ("bigint", "string", "boolean", "double") for c in columns)
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, folder):
    docs = [d[:2] for d in documents()]
    assert got(spark, folder, "op1_ngram_join", "doc_id", "n_shingles", "component_id") == brute_join(docs)
    assert got(spark, folder, "op1_ngram_join", "doc_id", "class_id", "n_links") == brute_links(docs)


def test_op2(spark, folder):
    want = sorted(((i, *(q := brute_quality(t)), q[0] < 50 or 100 * q[4] > 50 * q[0]) for i, t, *_ in documents()), key=repr)
    out = got(spark, folder, "op2_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [x[:-1] for x in out] == want
    # lines that ten rows of a host share go; under half of the words left, a document goes too
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    count, verdicts = {}, []
    for _, t, _, host, _ in documents():
        for k in {strip(x) for x in (t or "").split("\n") if words(x)}:
            count[host, k] = count.get((host, k), 0) + 1
    for i, t, _, host, _ in documents():
        n, *_, repeats = brute_quality(t)
        left = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and count[host, strip(x)] < 10)
        verdicts.append((i, n, n >= 50 and 100 * repeats <= 50 * n and 2 * left >= n))
    assert got(spark, folder, "op2_quality_rules", "doc_id", "n_words", "kept") == sorted(verdicts, key=repr)


def test_op2_hosts_of_any_size(spark, tmp_path):
    """A line of ten documents goes from hosts of 199, 201 and 3,000 rows alike, and so do the documents that it leaves with too little."""
    docs = [(10_000 * n + k, (" ".join(f"s{n}y{j}" for j in range(90)) if k < 10 else "") + f"\n{k} " + " ".join(f"w{k}x{j}" for j in range(60)), "en", f"h{n}", 0) for n in (199, 201, 3000) for k in range(n)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = got(spark, tmp_path, "op2_quality_rules", "doc_id", "n_hot_lines", "n_left_words", "kept")
    assert out == sorted(((i, int(i % 10_000 < 10), 61, i % 10_000 >= 10) for i, *_ in docs), key=repr)


def test_op3(spark, folder):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = np.array([len(t.encode(d[1] or "", add_special_tokens=False).ids) for d in documents()])
    want = [(int(k), int((n == k).sum()), int((n >= k).sum()), int(n[n >= k].sum()), int(np.minimum(n, k).sum()), int((n <= k).sum())) for k in np.unique(n)]
    assert got(spark, folder, "op3_token_counts", "n_tokens", "n_docs", "docs_from", "tokens_from", "truncated_total", "docs_to") == sorted(want, key=repr)


def test_op4(spark, folder):
    out = got(spark, folder, "op4_language_id", "doc_id", "page_id", "language", "probability", "kept")
    assert len(out) == len(documents()) + 3
    blank = {d[0] for d in documents() if not any(c.isalnum() for c in d[1] or "")}
    assert all(x[2] == "und" and not x[4] and x[3] == 0 for x in out if x[0] in blank and x[0] is not None) and sum(x[1] == 2 for x in out) == 2


def test_op5(spark, folder):
    each = [(d[0], brute_base(d[1] or "")) for d in documents()]
    count = lambda b, kind: sum(x.startswith(kind) for x in b)
    want = sorted(((i, count(b, "assign"), count(b, "access"), count(b, "hex"), sha(",".join(b))) for i, b in each), key=repr)
    assert got(spark, folder, "op5_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    spans = got(spark, folder, "op5_secret_scan", "doc_id", "base_sha256", "spans", "n_credential")
    for _, digest, written, n in spans:
        all_spans = [(int(a), ("assign", "access", "hex", "credential").index(k), int(z)) for k, a, z in (x.split(":") for x in written.split(",") if x)]
        assert all_spans == sorted(all_spans) and sum(k == 3 for _, k, _ in all_spans) == n
        assert sha(",".join(x for x in written.split(",") if x and not x.startswith("credential"))) == digest
    assert ("credential:5:100005", 1) in {(x[2], x[3]) for x in spans}


def test_op6(spark, folder):
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for _, t in {d[:2] for d in documents()}:
        for k in {strip(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = []
    for i, t, *_ in documents():
        lines = (t or "").split("\n")
        left = [x for x in lines if not strip(x) or count[strip(x)] < 10]
        want.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    assert got(spark, folder, "op6_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_op7(spark, folder):
    want = []
    for i, t, *_ in documents():
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        (media,) = media_columns.encode([p])
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert got(spark, folder, "op7_media_columns", *names) == sorted(want, key=repr)
    features = got(spark, folder, "op7_media_columns", "payload_sha256", "feature")
    assert len(set(features)) == len({p for p, _ in features}) and all(f.startswith("144x") for _, f in features)


def test_op8(spark, folder):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    each = sorted(((d[0], [*t.encode(d[1] or "", add_special_tokens=False).ids, 2]) for d in documents()), key=lambda x: -1 if x[0] is None else x[0])
    want = sorted(((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in each), key=repr)
    out = got(spark, folder, "op8_token_files", "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(((i, n, c) for i, _, n, c in out), key=repr) == want
    at = 0
    for i, start, n, _ in sorted(out, key=lambda x: x[1]):
        assert start == at
        at += n
    before = {i: sum(len(x) for j, x in each if (-1 if j is None else j) < (-1 if i is None else i)) for i, _ in each}
    assert all(start == before[i] for i, start, *_ in out if sum(i == j for j, _ in each) == 1)


def test_op9(spark, folder):
    size = lambda d: len(words(d[1]))
    docs, total = documents(), {}
    for d in docs:
        total[d[3]] = total.get(d[3], 0) + size(d)
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    open_, left, target = set(order), sum(total.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not full:
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3.0 * total[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    out = got(spark, folder, "op9_mixing", "doc_id", "size", "source", "source_size", "taken")
    assert sorted((x[:4] for x in out), key=repr) == sorted(((d[0], size(d), d[3], total[d[3]]) for d in docs), key=repr)
    assert all(0 <= x[4] <= 3 * x[1] and (not x[1] or x[4] % x[1] == 0) for x in out)
    for _, s, t in got(spark, folder, "op9_mixing", "doc_id", "source", "target"):
        assert t == pytest.approx(target[s])
    for s in order:
        assert abs(sum(x[4] for x in out if x[2] == s) - target[s]) <= 2 * max(x[1] for x in out if x[2] == s)
    assert got(spark, folder, "op9_mixing", "doc_id", "size", "source", "source_size", "taken") == out


def test_op10(spark, folder):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in documents():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got(spark, folder, "op10_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
