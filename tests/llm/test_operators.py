"""Each operator against a brute-force version, on documents with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phonolake.llm import encoding, language_id, line_dedup, media_columns, ngram_join, pareto_mix, quality_rules, queries, secret_scan, token_counts, token_files, tree_bpe
from phonolake.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("key", "rid", "copies", "lines", "at", "n_lines", "n_dropped", "size", "share", "target", "class", "id", "_id", "h", "g", "tl", "kept", "feature", "ids", "spans", "place", "host", "_source", "n_words")


def rows():
    r = random.Random(7)
    words = "the of and to in house garden river stone green Blue walks SEES every night morning".split()
    base = [" ".join(r.choice(words) for _ in range(r.randint(60, 150))) for _ in range(12)]
    texts = [None, "", " ", "\n", "\n\n a\n", "one", "One  TWO three four", "one two three four", "A b c d e", "a b c d e", "x" * 50_000, "é" * 3000 + " 'tis don't 123 <|endoftext|>"]
    texts += [f"shared line {k % 2}\n  Shared LINE {k % 2} \t\nown {k} {b}\n{b}" for k, b in enumerate(base)]
    for b in base[:6]:
        w = b.split()
        for k in range(6):
            v = w.copy()
            v[(7 * k) % len(v)] = f"new{k}"
            texts.append(" ".join(v[: len(v) - k]))
    texts += ["password = hunter2hunter\ntoken: 'abcDEF123456789'", "AKIA" + "A1" * 8 + " " + "0f" * 20, "pwd is xK9#mQ2$vL5!aa", "token=token=abcdefghij secret: abc"]
    texts += [" ".join(base) * 40]
    out = [(k, t, None if k % 9 == 0 else ("en" if k % 3 else "en-GB"), None if k % 11 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    out += [out[13], out[13], out[20], (None, texts[14], None, None, None), (None, None, None, None, None), (9000, texts[25], "fr", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    return d.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)}).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("1 = 0")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def records(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 1


def brute_join(docs):
    sets = []
    for _, t in docs:
        w = words(low(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    key = lambda i: -1 if docs[i][0] is None else docs[i][0]
    for i in range(len(docs)):
        least[root(i)] = min(least.get(root(i), 10**9), key(i))
    return sorted(((d[0], len(sets[i]), None if (c := least[root(i)]) < 0 else c) for i, d in enumerate(docs)), key=repr)


@pytest.mark.parametrize("tile", [ngram_join.TILE, 4])
def test_ngram_join(spark, odd, empty, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "WHOLE", 64 if tile > 4 else 16)
    got = ngram_join.ngram_join(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id", "n_links"]
    assert records(got, "doc_id", "n_shingles", "component_id") == brute_join([r[:2] for r in rows()])
    if tile > 4:
        assert ngram_join.ngram_join(empty).count() == 0
        kept = ngram_join.keep_one(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]))
        assert kept.columns == odd.columns


def test_large_group(spark, monkeypatch):
    """Chains of texts that differ more and more, in tiles far smaller than their group."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    r = random.Random(3)
    docs, w = [], [f"w{k}" for k in range(200)]
    for k in range(120):
        if k % 3 == 0:
            w[r.randrange(len(w))] = f"n{k}"
        docs.append((k, " ".join(w[: r.randint(150, 200)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.ngram_join(d)
    assert records(got, "doc_id", "n_shingles", "component_id") == brute_join(docs)


def brute_links(docs):
    """(doc_id, component, class, number of links) of each row, all pairs compared."""
    sets = []
    for _, t in docs:
        w = words(low(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    key = lambda i: -1 if docs[i][0] is None else docs[i][0]
    out = []
    for i, s in enumerate(sets):
        n = sum(1 for j, o in enumerate(sets) if j != i and s and o and 100 * len(s & o) >= 80 * len(s | o))
        least = min((key(j) for j, o in enumerate(sets) if s and o == s), default=key(i))
        out.append((docs[i][0], None if least < 0 else least, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [ngram_join.TILE, 4])
def test_all_links(spark, odd, empty, monkeypatch, tile):
    """Every link of every row is counted, those within what hangs together already too."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    got = ngram_join.ngram_join(odd)
    assert records(got, "doc_id", "class_id", "n_links") == brute_links([r[:2] for r in rows()])
    assert records(got, "doc_id", "n_shingles", "component_id") == brute_join([r[:2] for r in rows()])
    r, docs, w = random.Random(4), [], [f"w{k}" for k in range(200)]
    for k in range(90):
        if k % 3 == 0:
            w[r.randrange(len(w))] = f"n{k}"
        docs.append((k, " ".join(w[: r.randint(150, 200)])))
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute_links(docs)
    assert records(got, "doc_id", "class_id", "n_links") == want
    assert sum(n for *_, n in want) > 2 * len(docs)
    if tile > 4:
        assert ngram_join.ngram_join(empty).count() == 0


def test_shingles_are_sets():
    texts = [t for _, t, *_ in rows()]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        w = words(low(t or ""))
        assert len(s) == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1))


def test_words_that_differ_have_different_hashes():
    """Thue-Morse words and their complements defeat hashes that are linear in the letters."""
    texts = []
    for bits in range(1, 15):
        w = [bin(k).count("1") & 1 for k in range(1 << bits)]
        texts += ["".join("ab"[x] for x in w), "".join("ba"[x] for x in w)]
    texts += [a + b for a in ("", "\0", "\0\0") for b in ("x", "x\0", "x\0\0")]
    assert len({s.tobytes() for s in shingle_sets(texts)}) == len(texts)
    same = shingle_sets(["a " * 3 + "W" * 70_000, "A a\na\t" + "w" * 70_000])
    assert same[0].tolist() == same[1].tolist()


def test_bitmaps_of_bounded_size(monkeypatch):
    """Bits are fewer where a tile's bitmaps would take too much, and links are the same."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 3000 - 40 * k], r.integers(0, 1 << 63, 30 * k, dtype=np.uint64)])) for k in range(20)]
    args = (np.arange(20), sets, np.ones(20, dtype=np.int64), np.zeros(20, dtype=np.int64), 80)
    want = ngram_join.tile_links(*args)
    monkeypatch.setattr(ngram_join, "MAPS", 2000)
    got = ngram_join.tile_links(*args)
    assert [a.tolist() for a in got] == [a.tolist() for a in want] and len(want[0]) > 2


# 2, 6


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert records(got, *want.columns) == sorted(want.fetchall(), key=repr)


def brute_quality(t):
    w = words(t)
    seen, covered = {}, set()
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k + j for k in at for j in range(3))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, empty):
    got = quality_rules.quality_rules(odd, line_docs=3)
    want = sorted(((r[0], *(q := brute_quality(r[1])), q[0] < 50 or 100 * q[4] > 50 * q[0]) for r in rows()), key=repr)
    assert records(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not r["kept"] for r in got.filter("base_failed").collect())
    assert got.filter("n_hot_lines > 0").count() > 0
    assert quality_rules.quality_rules(empty).count() == 0
    shared = [(k, f"good {k} " * 20 + "\n" + "common " * 70, "h") for k in range(40)] + [(99, " ".join(f"w{k}" for k in range(99)), "h"), (100, "common " * 70, "other")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(shared, "doc_id long, text string, source string"), max_repeat_pct=1000).collect()}
    assert {k for k, v in kept.items() if v} == {99, 100}


def test_hot_lines_of_hosts_of_any_size(spark, odd, empty):
    """The same line in ten documents goes from a small host and from a large one, and what is left is given back."""
    docs = [(10_000 * n + k, f"{'Shared  line ' * 30 if k < 10 else f'own {n} {k}'}\nw{n}x{k} " + " ".join(f"a{n}b{k}c{j}" for j in range(30)), f"h{n}") for n in (20, 199, 201, 3000) for k in range(n)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    hot = {r["doc_id"]: r for r in quality_rules.quality_rules(d, max_repeat_pct=1000).collect()}
    left = {r["doc_id"]: r for r in quality_rules.clean_documents(d, max_repeat_pct=1000).collect()}
    for k, t, _ in docs:
        want = t.split("\n")[1] if k % 10_000 < 10 else t
        assert left[k]["text"] == want
        assert left[k]["n_left_words"] == hot[k]["n_left_words"] == len(words(want))
        assert left[k]["kept"] == hot[k]["kept"]
    got = quality_rules.drop_hot_lines(odd, line_docs=3)
    assert got.columns == odd.columns and got.count() == len(rows())
    a = records(quality_rules.quality_rules(odd, line_docs=3), "doc_id", "n_words", "n_left_words", "kept")
    assert a == records(quality_rules.clean_documents(odd, line_docs=3), "doc_id", "n_words", "n_left_words", "kept")
    assert any(x[1] != x[2] for x in a)
    assert quality_rules.drop_hot_lines(empty).count() == 0


def test_mixed_hashes_take_the_slow_way(spark, odd, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 5)
    got = quality_rules.text_counts(odd, F.col("text"), "doc_id")
    assert records(got, "doc_id", "n_repeat_words") == sorted(((r[0], brute_quality(r[1])[4]) for r in rows()), key=repr)


def test_line_dedup(spark, odd, empty):
    docs = {(r[0], r[1]) for r in rows()}
    count = {}
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for _, t in docs:
        for k in {strip(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = []
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        left = [x for x in lines if not strip(x) or count[strip(x)] < 5]
        want.append((i, t if len(left) == len(lines) else "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup.line_dedup(odd, min_docs=5)
    assert records(got, "doc_id", "text", "_n_lines", "_n_dropped") == sorted(want, key=repr)
    assert set(odd.columns) < set(got.columns)
    assert any(w[3] for w in want)
    assert line_dedup.line_dedup(empty).count() == 0


# 3, 8, 10


def test_token_counts(spark, odd, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = np.array([len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()])
    for r in token_counts.limits(token_counts.length_histogram(odd)).collect():
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"], r["truncated_total"], r["docs_to"]) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum(), np.minimum(n, k).sum(), (n <= k).sum())
    a = token_counts.answers(token_counts.limits(token_counts.length_histogram(odd)), [7, 100, 10**8], [0.5]).collect()
    assert [r["value"] for r in a] == [np.minimum(n, 7).sum(), np.minimum(n, 100).sum(), n.sum(), sorted(n)[(len(n) + 1) // 2 - 1]]
    assert token_counts.limits(token_counts.length_histogram(empty)).count() == 0


def test_token_files(spark, odd, empty, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    each = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows()]
    token_files.write_token_files(odd, str(tmp_path / "ids"))
    got = token_files.read_token_files(spark, str(tmp_path / "ids")).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in each), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    one = spark.read.orc(str(tmp_path / "ids")).filter("doc_id = 12").first()
    assert list(one["ids"]) == dict(each)[12]
    token_files.write_token_files(empty, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_ids_of_any_text():
    """Ids are those of the library: random white space, marks, contractions, added tokens, and runs of a million characters."""
    own, r = encoding.encoder(*encoding.vocabulary()), random.Random(11)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [" ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "'s", "'LL", "'", "don't", "a", "Word", "é", "e\u0301", "\u0301", "12", "٣", "日本", "🇩🇪", "!?", "_", "\0", "<|endoftext|>", "<|endof"]
    texts = ["".join(r.choice(signs[:-2] if k % 4 else signs) for _ in range(r.randint(0, 60))) for k in range(4000)]
    texts += [c * 1_000_000 for c in (" ", "\n", "a", "\u0301", "\u3000", "'", " \n")] + ["x" + " " * 2_000_000 + "y", None, ""]
    for text, got in zip(texts, own.ids(texts), strict=True):
        assert got.tolist() == (t.encode(text, add_special_tokens=False).ids if text else []), repr(text)[:200]


def test_known_pieces():
    """The table stays within its bound, begins anew among other pieces, and gives what each piece has by itself."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known, r = encoding.Known(t, str, 50), random.Random(3)
    for k in range(30):
        texts = [[" " + "".join(r.choices("abcé" if k < 20 else "xyzß", k=r.randint(1, 3))) for _ in range(40)] + ["<|endoftext|>", "a<|endoftext|>b"] * (k % 2) + ["long" * 40] for _ in range(3)]
        for text, got in zip(texts, known.ids(texts), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == [i for p in text for i in t.encode(p, add_special_tokens=False).ids]
        assert len(known.known) <= 50 and "long" * 40 not in known.known
    assert all(x.startswith(" ") and x[1] in "xyzß" for x in known.known)
    assert known.ids([]) == [] and known.ids([[]]) == [b""]
    assert encoding.encoded(t, ["a", "", "b c"], most_chars=1) == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in ("a", "", "b c")]


def test_long_runs_through_spark(spark, tmp_path):
    d = spark.createDataFrame([(1, " " * 1_200_000), (2, "a\n" * 600_000), (3, "short")], "doc_id long, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in d.collect()}
    assert sorted(r["n_tokens"] for r in token_counts.lengths(d).collect()) == sorted(want.values())
    token_files.write_token_files(d, str(tmp_path / "long"))
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.read_token_files(spark, str(tmp_path / "long")).collect()} == want


def test_bpe(spark, odd, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((r[0], ids := t.encode(r[1] or "", add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for r in rows()), key=repr)
    for size in (tree_bpe.SEGMENT, 97):
        got = tree_bpe.decode_bpe(tree_bpe.encode_bpe(odd, segment_chars=size))
        assert records(got, "doc_id", "ids", "decoded") == want
    assert tree_bpe.decode_bpe(tree_bpe.encode_bpe(empty)).count() == 0


def test_joins_of_unsplit_text():
    known = tree_bpe.words_of(public_tokenizers.path(tree_bpe.WORD_BPE))
    t, r = known.tokenizer, random.Random(5)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aeinst", "ab", "'srtdmlve", "éàü'sß", "!?.,'s-_", "0123456789a", "日本語漢字", "é̀a", "AbCİß", "각", "👍🏽🇩🇪x", "<|endoftext|>a \n　"]
    for n in range(1500):
        alphabet = r.choice(letters) + r.choice(letters)
        x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 400)))
        x = x[:50] + "<|endoftext|>" * (n % 5 == 0) + x[50:]
        size = r.choice([16, 33, 90])
        parts = [tree_bpe.segment(known, x[k : k + size]) for k in range(0, max(1, len(x)), size)]
        assert tree_bpe.tree(t, parts).tolist() == t.encode(x, add_special_tokens=False).ids, (x, size)


# 4


def test_rare_languages_are_in_the_model(spark):
    """A language of a few documents is learnt however many rows of others there are."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("the river of the town").alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(50_000 + k, "zvolna plyne reka mestom", "SK") for k in range(8)] + [(60_000, "x y", "zz")], "doc_id long, text string, lang string")
    model = language_id.train(rows.unionByName(few))
    assert model.index.tolist() == ["en", "sk"]
    d = spark.createDataFrame([(1, "zvolna plyne reka mestom")], "doc_id long, text string")
    assert language_id.identify(d, model, host=None, declared=None, least_prob=0.0).first()["text_language"] == "sk"


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    held = language_id.identify(docs.filter("doc_id % 2 = 1"), model)
    j = held.join(docs.select("doc_id", "lang"), "doc_id")
    assert j.filter("language = lang").count() >= 0.95 * j.count()
    got = language_id.identify(odd, model, declared="lang")
    assert got.count() == len(rows())
    assert not any(r["kept"] for r in got.join(odd.select("doc_id", "text"), "doc_id").filter("text is null or trim(text) in ('', '\n')").collect())
    assert language_id.identify(empty, model).count() == 0
    assert language_id.identify(odd, language_id.train(empty)).filter("kept").count() == 0
    kept = language_id.keep_identified(docs.withColumn("key", F.lit(1)), docs)
    assert kept.count() >= 0.95 * docs.count() and kept.columns == [*docs.columns, "key"]


def brute_posteriors(rows_, model):
    """(id, text, host, suffix, declared) -> id -> (language, probability), by Bayes' rule over plain lists."""
    names, w = [*model.index, "und"], 20.0
    table = [model.loc[n].tolist() for n in model.index] + [[-float(np.log(language_id.BINS))] * language_id.BINS]

    def soft(logs):
        e = [np.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    likely = {}
    for i, text, *_ in rows_:
        if text and any(c.isalnum() for c in text):
            b = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.encode().lower() + b" ") + b"  "
            n = len(b) - 2
            bins = [(b[k] ^ b[k + 1] << 5 ^ b[k + 2] << 10) % language_id.BINS for k in range(n)]
            likely[i] = [sum(t[x] for x in bins) / n * min(n, 100) for t in table]
    alone = {i: soft(x) for i, x in likely.items()}
    sums = lambda test: [sum(alone[r[0]][k] for r in rows_ if r[0] in alone and test(r)) for k in range(len(names))]
    total, out = sums(lambda r: True), {}
    for i, _, host, suffix, declared in rows_:
        if i not in likely:
            out[i] = ("und", 0.0)
            continue
        logs = []
        host_n, suffix_n, said = sums(lambda r: r[2:4] == (host, suffix)), sums(lambda r: r[3] == suffix), sums(lambda r: r[4] == declared)  # noqa: B023
        host_n, suffix_n, said = ([max(x - p, 0) for x, p in zip(v, alone[i], strict=True)] for v in (host_n, suffix_n, said))
        for k in range(len(names)):
            top = max((total[k] + 1 / len(names)) / (sum(total) + 1), 1e-3)
            by_suffix = (suffix_n[k] + w * top) / (sum(suffix_n) + w)
            by_host = (host_n[k] + w * by_suffix) / (sum(host_n) + w)
            evidence = np.log((said[k] + w * sum(said) / sum(total) + 1e-9) / (total[k] + w)) if declared else 0.0
            logs.append(likely[i][k] + np.log(by_host) + evidence)
        post = soft(logs)
        best = max(range(len(names)), key=lambda k: post[k])  # noqa: B023
        out[i] = (names[best] if best < len(names) - 1 and post[best] >= 0.5 else "und", post[best])
    return out


def test_every_posterior(spark):
    """The registered query, documents and pages together, against Bayes' rule worked out row by row."""
    docs = [(r["doc_id"], r["text"], (r["source"] or "").strip().lower() or None, None, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pages = language_id.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    part = lambda x: x.strip().lower() or None
    rows_ = docs + [(-1 - r["page_id"], r["text"], part(r["host"]), part(r["suffix"]), part(r["declared"])) for r in pages]
    want = brute_posteriors(rows_, language_id.train(spark.read.parquet(f"{SF}/documents.parquet")))
    got = queries.QUERIES["op4_language_id"](spark, SF).collect()
    assert len(got) == len(want) == len(rows_) and sum(r["page_id"] is not None for r in got) == len(pages) > 0
    for r in got:
        language, p = want[r["doc_id"]]
        assert r["probability"] == pytest.approx(p, abs=2e-6) and (r["language"] == language or abs(p - 0.5) < 1e-6), r
        assert r["kept"] == (r["language"] != "und") and (r["page_id"] is None) == (r["doc_id"] >= 0)


def test_evidence_settles_doubt(spark):
    """A text that says nothing goes with its host, its suffix and its markup."""
    docs = [(k, "das ist und der die nicht" if h == "de" else "the and of this is not", f"h{h}", h, h) for k in range(40) for h in ("de", "en")]
    d = spark.createDataFrame([*docs, (100, "12345 67", "hde", "de", "de"), (101, "12345 67", "hen", "en", None), (102, "12345 67", "other", "de", None)], "doc_id long, text string, source string, tld string, lang string")
    model = language_id.train(d.filter("doc_id < 100"))
    got = {r["doc_id"]: r["language"] for r in language_id.identify(d, model, suffix="tld", declared="lang", least_prob=0.0).filter("doc_id >= 100").collect()}
    assert got == {100: "de", 101: "en", 102: "de"}


def test_page_evidence(spark):
    p = spark.createDataFrame([(1, "https://user@www.Example.de:80/x", "<!doctype html><html lang='de-AT'><script>var a='<p>';</script><p>Hallo <b>Welt</b>"), (2, "x", "")], "page_id long, url string, html string")
    r = language_id.page_evidence(p).orderBy("page_id").collect()
    assert (r[0]["host"], r[0]["suffix"], r[0]["declared"], r[0]["text"].split()) == ("www.example.de", "de", "de", ["Hallo", "Welt"])


# 5


ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def brute_base(text):
    """The base's spans, each kind by its pattern as stated, matches that are too short dropped."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secret_scan(spark, odd, empty):
    got = secret_scan.secret_scan(odd)
    base = lambda spans: [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] != "credential"]
    assert sorted(((r["doc_id"], base(r["spans"])) for r in got.collect()), key=repr) == sorted(((r[0], brute_base(r[1] or "")) for r in rows()), key=repr)
    assert any(s["kind"] == "credential" for r in got.collect() for s in r["spans"])
    assert secret_scan.secret_scan(empty).count() == 0
    assert secret_scan.word_ranks(empty) == secret_scan.RANK


def test_words_of_the_corpus_are_cheap(spark, odd):
    d = spark.createDataFrame([(k, f"Wanderung, (lichtung) lichtung. 12ab zzz9 {k} " + "w" * 30) for k in range(5)] + [(9, "lichtung seltenes")], "doc_id long, text string")
    ranks = secret_scan.word_ranks(d)
    assert (ranks["lichtung"], ranks["wanderung"]) == (1, 2) and not {"seltenes", "12ab", "zzz9", "w" * 30} & set(ranks)
    assert len(secret_scan.word_ranks(d, dict_words=1)) == len(secret_scan.RANK) + 1
    text = "passphrase is Wanderung-lichtung9\npassphrase: xqzvkwjpmtrbn\npassword=\"abzxwkqv&longer!rest\" password = abcdefgh"
    spans, _ = secret_scan.scan(text, 10, ranks)
    values = {text[a:b] for a, k, b in spans if k == 3}
    assert values == {"xqzvkwjpmtrbn", "abzxwkqv&longer!rest"}  # letters alone too, and beyond the base span
    assert secret_scan.guess_cost("wanderunglichtung", ranks) < 4 < secret_scan.guess_cost("wanderunglichtung")
    brute = sorted((s, k, e) for s, k, e in spans if k < 3)
    assert [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in brute] == brute_base(text)


@pytest.mark.parametrize("copies", [1, 3, 1000])
def test_leaked_secrets_stay_dear(spark, copies):
    """A value that many texts leak, or many copies of one, is a span in all of them; a word is cheap by different texts, not by copies."""
    leaked = [(k, f"{'same' if k % 2 else f'text {k}'}\nOur deploy passphrase: xqzvkwjpmtrbn\ntoken=abcdefghij") for k in range(copies)]
    others = [(5000 + k, f"haus {k} wald") for k in range(5)] + [(6000 + k, "zaunkoenig") for k in range(50)]
    d = spark.createDataFrame(leaked + others, "doc_id long, text string")
    ranks = secret_scan.word_ranks(d)
    assert "xqzvkwjpmtrbn" not in ranks and "abcdefghij" not in ranks and "zaunkoenig" not in ranks and {"haus", "wald"} <= set(ranks)
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.secret_scan(d, ranks).collect()}
    assert all("credential" in spans[k] for k, _ in leaked)


def test_exactly_the_first_words(spark):
    """By how many texts have a word, then by a hash: as many as asked for, those of sorting all of them."""
    docs = [(k, " ".join(f"{'abcdefghij'[j % 10] * 2}{'klmnopqrst'[j // 10]}" for j in range(100) if k < 3 + j % 7)) for k in range(10)]
    d = spark.createDataFrame([(k, f"{t} {k}") for k, t in docs], "doc_id long, text string")
    every = secret_scan.word_ranks(d)
    for n in (0, 1, 13, 50, 99, 100, 1000):
        some = secret_scan.word_ranks(d, dict_words=n)
        assert len(some) == len(secret_scan.RANK) + min(n, 100) and set(some) <= set(every)
        count = {w: sum(w in t.split() for _, t in docs) for w in every if w not in secret_scan.RANK}
        assert min((count[w] for w in some if w in count), default=99) >= max((count[w] for w in count if w not in some), default=0)


def test_scan_time_is_linear():
    """Ten times the credentials take about ten times as long, and a value of a million characters comes back."""
    import time

    took = []
    for n in (2000, 20_000):
        text = " ".join(f"password={k:08x}zq pwd: 'x{k}&Kq!vz{k}w'" for k in range(n))
        t = time.perf_counter()
        spans, _ = secret_scan.scan(text, 10)
        took.append(time.perf_counter() - t)
        assert len(spans) == 2 * n
    assert took[1] < 25 * took[0]
    long = "".join(random.Random(1).choices("xkqz9#7", k=1_000_000))
    assert secret_scan.scan("pwd: " + long, 10)[0] == [(5, 3, 1_000_005)]


def slow_cost(value):
    spans = {}
    for i, j, c in secret_scan.spans_of(value):
        spans[i, j] = min(c, spans.get((i, j), 99.0))

    def best(i):
        if i == len(value):
            return 0.0
        options = [(c, j) for (a, j), c in spans.items() if a == i] + [(secret_scan.BRUTE * (j - i), j) for j in range(i + 1, len(value) + 1)]
        return min(c + (secret_scan.NEXT if j < len(value) else 0.0) + best(j) for c, j in options)

    return best(0)


def test_guess_costs():
    r = random.Random(1)
    for _ in range(60):
        v = "".join(r.choice(["a", "b", "1", "password", "qwer", "2019", "aaa", "!"]) for _ in range(r.randint(1, 4)))[:14]
        assert secret_scan.guess_cost(v) == pytest.approx(slow_cost(v)), v
    assert secret_scan.guess_cost("password123") < secret_scan.guess_cost("pzsqwxrd817") and secret_scan.guess_cost("qwertyuiop") < 6 < secret_scan.guess_cost("c1f6c02f845bf3028d")
    assert secret_scan.scan("the password is required", 10)[0] == []


# 7


def test_media_columns(spark, odd, empty):
    got = media_columns.load_media(media_columns.store_media(odd), rows=7, most_bytes=9000)
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["pixels"])) for r in got.collect()), key=repr) == sorted(((r[0], len((r[1] or "").encode()), media_columns.payload_of(r[1])) for r in rows()), key=repr)
    assert all(r["width"] * r["height"] * 4 == len(r["pixels"]) for r in got.collect())
    assert media_columns.load_media(media_columns.store_media(empty)).count() == 0


# 9


def test_mixture(spark, odd, empty):
    got = pareto_mix.mixture(odd).collect()
    assert len(got) == len(rows())
    total = sum(len(words(r[1])) for r in rows())
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in sources.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in sources.values()) and all(0 <= r["copies"] <= 3 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, pareto_mix.mixture(odd).collect()))
    assert pareto_mix.mixture(empty).count() == 0
    mixed = pareto_mix.mix(odd)
    assert mixed.columns == odd.columns


def test_targets_against_filling_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40}
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in pareto_mix.targets(pareto_mix.ranked_weights(d, (1, 2, 3)), 3).collect()}
    assert {k: w for k, (w, _) in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    left, open_, want = float(sum(sizes.values())), dict(got), {}
    while True:
        level = left / sum(w for w, _ in open_.values())
        full = [k for k, (w, _) in open_.items() if w * level > 3 * sizes[k]]
        if not full:
            break
        for k in full:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            del open_[k]
    want |= {k: w * level for k, (w, _) in open_.items()}
    assert {k: t for k, (_, t) in got.items()} == pytest.approx(want)


def filled(levels, target, most):
    """Shares by level, the highest capped first, until the scale keeps the rest within most."""
    capped = set()
    while open_ := {k: n for k, n in levels.items() if k not in capped and n}:
        c = (target - most * sum(levels[k] for k in capped)) / sum(k * n for k, n in open_.items())
        over = {k for k in open_ if c * k > most * (1 + 1e-12)}
        if not over:
            return {k: min(most, c * k) for k in levels}
        capped |= over
    return dict.fromkeys(levels, most)


def test_unequal_inclusion(spark):
    """Shares are those of filling by hand; how often each level is included follows them, and words come near the target."""
    r = random.Random(9)
    docs = [(k, " ".join(["w"] * int(2 ** r.uniform(0, 9))), r.choice("aaab") + str(k % 3)) for k in range(9000)]
    got = pareto_mix.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
    unequal = 0
    for rows_ in by.values():
        levels, target = {}, rows_[0]["target"]
        for x in rows_:
            levels.setdefault(int(np.log2(x["size"] + 2)), []).append(x)
        want = filled({k: sum(x["size"] for x in v) for k, v in levels.items()}, target, 3)
        for k, v in levels.items():
            assert all(x["share"] == pytest.approx(want[k]) and x["copies"] in (int(x["share"]), int(x["share"]) + 1) for x in v)
            p = want[k] % 1
            assert abs(sum(x["copies"] - int(x["share"]) for x in v) - p * len(v)) <= 4.5 * (len(v) * p * (1 - p)) ** 0.5 + 1
        unequal += len({round(w % 1, 6) for w in want.values()}) > 3
        assert sum(x["share"] * x["size"] for x in rows_) == pytest.approx(target)
        assert abs(sum(x["copies"] * x["size"] for x in rows_) - target) <= max(x["size"] for x in rows_)
    assert unequal >= 4


def test_cut_against_sorting(spark, monkeypatch):
    """The rows taken are those a sort by rank takes, and inclusion follows the fractions."""
    monkeypatch.setattr(pareto_mix, "BINS", 8)
    r = random.Random(2)
    data = [(k, f"s{k % 3}", r.randint(0, 50), r.choice([0.0, 0.2, 0.7, 1.0, 1.3])) for k in range(400)]
    got = {x["doc_id"]: x["copies"] for x in pareto_mix.pareto_copies(spark.createDataFrame(data, "doc_id long, source string, size long, share double"), seed="q").collect()}
    for s in ("s0", "s1", "s2"):
        need, ranked, taken = 0.0, [], set()
        for k, src, size, share in data:
            if src == s and share % 1:
                part = share - int(share)
                u = (int(hashlib.md5(f"q:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (part / (1 - part)), k, size))
                need += part * size
        at = 0
        for _, k, size in sorted(ranked):
            if at + size <= need or abs(at + size - need) < abs(at - need):
                taken.add(k)
            at += size
            if at > need:
                break
        extra = {k for k, src, _, share in data if src == s and got[k] > int(share)}
        words_of = {k: size for k, _, size, _ in data}
        assert {k for k in extra if words_of[k]} == {k for k in taken if words_of[k]}
