"""Language ID by fusing evidence: the text, the language that the markup declares, the address suffix and the host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.llm.common import checkpointed, fresh, read, small_batches, spread_join
from phonolake.llm.encoding import slices

#: Bins of hashed byte trigrams.
BINS = 1 << 15
#: The hypothesis that a text is in no language of the model.
NONE = "und"


#: What stands for each byte: letters in lower case and bytes of other than ASCII characters for themselves, all else for a space.
LETTER = np.array([k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 128 else 32 for k in range(256)], dtype=np.uint8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte trigrams of all texts, and where each text's begin, with a last end.

    A-Z count as lower case, and what lies between letters (digits, addresses' dots, numbers of any length) as one space.
    """
    parts = [b" " + t.encode() + b" " if t else b"" for t in texts]
    b = LETTER[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    keep = (b != 32) | np.concatenate([[True], b[:-1] != 32])[: len(b)]
    at = np.concatenate([[0], np.cumsum(keep)])[np.cumsum([0, *map(len, parts)])]
    b = np.concatenate([b[keep], [32, 32]]).astype(np.uint16)
    return (b[:-2] ^ (b[1:-1] << 5) ^ (b[2:] << 10)) & (BINS - 1), at


def train(labelled: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", label_docs: int = 1000, least_docs: int = 5) -> pd.DataFrame:
    """A table of log probabilities, a row for each language with least_docs labelled rows in the whole table, a column for each bin.

    Each language has about label_docs of its rows in the sample, or all if it has no more, chosen by a hash of the id; no more
    rows train the model, however many there are. Rows without text, label or id train nothing. The driver gets one number
    for each language and bin.
    """
    rows = labelled.select(F.col(text).alias("text"), F.lower(F.col(label)).alias("label"), F.col(doc_id).alias("id")).dropna()
    sizes = rows.groupBy("label").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_docs)
    below = F.least(F.lit(1.0), F.lit(float(label_docs)) / F.col("rows")) * F.lit(float(1 << 30))
    rates = sizes.select("label", below.alias("below"))
    # a row for each language, far fewer bytes than the model itself
    rows = rows.join(F.broadcast(rates), "label").filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < F.col("below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            texts = batch.to_pandas()
            for name, group in texts.groupby("label"):
                c = np.bincount(trigrams(group["text"].tolist())[0], minlength=BINS)
                used = np.flatnonzero(c)
                yield pa.record_batch([pa.array([name] * (len(used) + 1)), pa.array([*used, -1], pa.int32()), pa.array([*c[used], len(group)], pa.int64())], names=["label", "bin", "n"])

    with small_batches(labelled.sparkSession):
        counts = rows.select("label", "text").mapInArrow(count, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = counts.pivot(index="label", columns="bin", values="n").fillna(0.0).reindex(columns=range(-1, BINS), fill_value=0.0)
    table = table.drop(columns=-1).sort_index()
    return np.log(table.add(0.5)).sub(np.log(table.sum(axis=1) + 0.5 * BINS), axis=0)


def text_likelihoods(docs: DataFrame, model: pd.DataFrame, *, text: str = "text", most_trigrams: int = 100) -> DataFrame:
    """Adds tl, log likelihoods of the text, one for each language of the model and one for none of them, and p, what these
    alone make of the languages' probabilities. Other columns stay.

    All trigrams count in the mean; it weighs as most_trigrams of them at most, for neighbours are not independent. A
    text without letters or digits has null in both, as null and empty ones. Texts count whole, however long.
    """
    table = np.vstack([model.to_numpy(), np.full(BINS, -np.log(BINS))]) if len(model) else np.full((1, BINS), -np.log(BINS))
    schema = T.StructType([*docs.schema.fields, T.StructField("tl", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            bins, at = trigrams(texts)
            n = np.diff(at)
            sums = np.zeros((len(texts), len(table)))
            if full := np.flatnonzero(n).tolist():
                sums[full] = np.stack([np.add.reduceat(t[bins], at[full]) for t in table], axis=1)
            tl = sums / np.maximum(n, 1)[:, None] * np.minimum(n, most_trigrams)[:, None]
            some = [bool(x) and any(c.isalnum() for c in x) for x in texts]
            both = [pa.array([x.tolist() if s else None for x, s in zip(v, some, strict=True)], pa.list_(pa.float64())) for v in (tl, probabilities(tl))]
            yield pa.record_batch([*batch.columns, *both], names=[*batch.schema.names, "tl", "p"])

    return docs.mapInArrow(score, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, text, host, suffix, declared): the text without tags, scripts and styles, what the
    address says, and the language that the html tag declares; empty strings for what is not there. A null page has a null text."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.coalesce(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit(""))
    return pages.select("page_id", text.alias("text"), host.alias("host"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), declared.alias("declared"))


def probabilities(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def smoothed(n: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    """Shares of counts, the prior counting as so many rows."""
    return (n + weight * prior) / (n.sum(axis=1, keepdims=True) + weight)


def fuse(evidence: DataFrame, languages: list[str], *, prior_weight: float = 20.0, least_none: float = 1e-3, least_prob: float = 0.5) -> DataFrame:
    """(host, suffix, declared, tl, p and others) -> the others, language, probability, text_language, kept.

    Priors are smoothed from the whole table down: a suffix's by the table's, a host's by its suffix's, each with the
    weight of prior_weight rows, and without the row that they are for. What is declared counts by how often texts of each
    language come with it. All these are sums over rows, grouped by host, suffix and declared code, and joined to the rows
    so that no host, suffix or code fills a task.
    """
    others = [c for c in evidence.columns if c not in ("host", "suffix", "declared", "tl", "p")]
    schema = T.StructType([*[evidence.schema[c] for c in others], T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("text_language", T.StringType()), T.StructField("kept", T.BooleanType())])
    k = len(languages) + 1
    e = evidence
    sums = lambda name: F.array(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(k)]).alias(name)
    total = np.array(e.agg(sums("n")).first()["n"])
    top = np.maximum((total + 1.0 / k) / (total.sum() + 1.0), least_none)
    hosts = e.groupBy("host", "suffix").agg(sums("hn"))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.get("hn", F.lit(i))) for i in range(k)]).alias("sn")).withColumnRenamed("suffix", "_suffix")
    hosts = spread_join(hosts, suffixes, {"suffix": "_suffix"}, ["host"]).withColumnsRenamed({"host": "_host", "suffix": "_suffix"})
    codes = e.filter(F.col("declared").isNotNull()).groupBy("declared").agg(sums("dn")).withColumnRenamed("declared", "_declared")
    e = spread_join(e, hosts, {"host": "_host", "suffix": "_suffix"}, others, "left")
    e = spread_join(e, codes, {"declared": "_declared"}, others, "left").select(*others, "tl", "p", "hn", "sn", "dn")
    names = np.array([*languages, NONE], dtype=object)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.select(["tl", "p", "hn", "sn", "dn"]).to_pandas()
            some = d["tl"].notna().to_numpy()
            out = pd.DataFrame({"language": [NONE] * len(d), "probability": 0.0, "text_language": NONE, "kept": False})
            if some.any():
                tl, p, hn, sn = (np.stack(d.loc[some, c].to_numpy()) for c in ("tl", "p", "hn", "sn"))
                # none of the counts has the row itself
                prior = smoothed(np.maximum(hn - p, 0), smoothed(np.maximum(sn - p, 0), top[None], prior_weight), prior_weight)
                logs = tl + np.log(prior)
                said = d.loc[some, "dn"].notna().to_numpy()
                if said.any():
                    dn = np.maximum(np.stack(d.loc[some, "dn"][said].to_numpy()) - p[said], 0)
                    chance = dn.sum(axis=1, keepdims=True) / max(total.sum(), 1.0)
                    logs[said] += np.log((dn + prior_weight * chance + 1e-9) / (total + prior_weight))
                post = probabilities(logs)
                best, most = post.argmax(axis=1), post.max(axis=1)
                kept = (best < k - 1) & (most >= least_prob)
                out.loc[some, "language"] = np.where(kept, names[best], NONE)
                out.loc[some, "probability"] = np.round(most, 6)
                out.loc[some, "text_language"] = names[tl.argmax(axis=1)]
                out.loc[some, "kept"] = kept
            made = pa.RecordBatch.from_pandas(out, preserve_index=False)
            yield pa.record_batch([*[batch.column(c) for c in others], *made.columns], names=[*others, *made.schema.names])

    return e.mapInArrow(decide, schema)


def identify(
    docs: DataFrame, model: pd.DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str | None = "source", suffix: str | None = None, declared: str | None = None, carry: tuple[str, ...] = (), least_prob: float = 0.5
) -> DataFrame:
    """One row per row of docs: doc_id, rid (hash of the text), the columns carry, language, probability, text_language, kept.

    A row is rejected if its text has no letter or digit, as null and empty ones, if no language is likelier than none, or
    if the likeliest has a probability under least_prob; language is then 'und'. Of languages that are as likely the first
    by name is taken. Declared codes count by their part before '-' or '_', and only those of two or three letters; what
    the model was trained on is no evidence, so declared must not be the label. Null hosts, suffixes and codes are "not
    known", null ids are ids like any other, and repeated rows come out as often. Texts count whole, however long. No
    rows: none come back. carry may name any columns but those that are added.
    """
    languages = model.index.tolist()
    part = lambda name: F.lit(None).cast("string") if name is None else F.nullif(F.lower(F.trim(F.col(name))), F.lit(""))
    code = F.regexp_extract(part(declared), "^([a-z]{2,3})(?:$|[-_])", 1)
    own = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(7), F.col(text)).alias("rid"), *carry]
    d = docs.select(*own, F.col(text).alias("text"), part(host).alias("host"), part(suffix).alias("suffix"), F.nullif(code, F.lit("")).alias("declared"))
    with small_batches(docs.sparkSession):
        e = checkpointed(text_likelihoods(d, model).drop("text"))
    return fuse(e, languages, least_prob=least_prob)


def keep_identified(docs: DataFrame, labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that identify keeps, columns as they were."""
    key, rid = fresh(docs, "key", "rid")
    # written first: a filter right on it would be moved below, and work out the probabilities over and over
    kept = checkpointed(identify(docs, train(labelled), doc_id=doc_id, text=text, **options).select("doc_id", "rid", "kept")).filter("kept").select(F.col("doc_id").alias(key), F.col("rid").alias(rid))
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.lit(7), F.col(text)) == F.col(rid)), "left_semi")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their hosts, and pages with what address and markup say, are evidence of one table; the labels of
    documents train the model, and are nothing else. A page's doc_id is -1 - page_id."""
    docs = read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    pages = page_evidence(read(spark, sf_dir, "pages")).select((-1 - F.col("page_id").cast("long")).alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "text", "host", "suffix", "declared")
    return identify(own.unionAll(pages), train(docs), host="host", suffix="suffix", declared="declared", carry=("page_id",)).drop("rid")
