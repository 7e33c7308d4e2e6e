"""The pipeline, stage by stage, against what each stage may do to its own input."""

import re

import corpus_pipeline
from phonolake.llm import tree_bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((docs, out))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    a, b = kept[0]
    assert b.count() >= 0.95 * a.count() and b.exceptAll(a).count() == 0
    a, b = kept[1]
    strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    count = {}
    for t in texts.values():
        for x in {strip(x) for x in t.split("\n")} - {""}:
            count[x] = count.get(x, 0) + 1
    want = {i: "\n".join(x for x in t.split("\n") if not strip(x) or count[strip(x)] < 10) for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in b.collect()} == want
    a, b = kept[2]
    sets = {}
    for r in a.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    root = lambda i: i if up[i] == i else root(up[i])
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert {r["doc_id"] for r in b.collect()} == {i for i in sets if root(i) == i}
    a, b = kept[3]
    size = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in d.collect())
    assert abs(size(b) - size(a)) < 0.1 * size(a)
    assert max(r["count"] for r in b.groupBy("doc_id").count().collect()) <= 3 and b.select("doc_id").exceptAll(b.select("doc_id")).count() == 0
    a, b = kept[4]
    t = tree_bpe.tokenizer(tree_bpe.public_tokenizers.path(tree_bpe.WORD_BPE))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in b.collect()) == sorted((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in a.collect())
    again = corpus_pipeline.run(spark, SF)
    assert again.exceptAll(b).count() == 0 and b.exceptAll(again).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
