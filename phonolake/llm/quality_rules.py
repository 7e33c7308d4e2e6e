"""Quality rules: counts of words, symbols and repeats of a text, and lines that too many documents of its host share.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import SPACES, WORD, checkpointed, fresh, read
from phonolake.llm.line_dedup import line_key, lines_of

#: Bits of a window's hash and of its place in a text, packed in one long for sorting.
PLACE_BITS = 24


def windows(words: Column) -> Column:
    """A hash of each three words in a row."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )


def text_counts(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row.

    Windows of three words are hashed, packed with their places (40 bits of hash, 24 of place) and sorted as longs.
    Where two neighbours agree in the 40 bits but not in all 64, or a text is too long for 24 bits, whole (hash, place)
    pairs are sorted instead.
    """
    t = F.coalesce(text, F.lit(""))
    d = docs.select(*keep, t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = d.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
        windows(F.col("w")).alias("h"),
    )
    d = d.withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long")).drop("l")
    low = (1 << PLACE_BITS) - 1
    d = d.withColumn("p", F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    d = d.withColumn("s", F.sort_array("p")).drop("p")
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    top = lambda x: F.shiftright(x, PLACE_BITS)
    near = lambda x, y: F.coalesce(top(x) == top(y), F.lit(False))
    # places of windows found twice or more, and whether neighbours differ in the other bits
    twice = F.filter("s", lambda x, i: near(x, F.get("s", i - 1)) | near(x, F.get("s", i + 1)))
    d = d.withColumn("two", twice).drop("s")
    mixed = F.exists(F.sequence(F.lit(1), F.greatest(F.size("two") - 1, F.lit(1))), lambda i: near(F.get("two", i), F.get("two", i - 1)) & (F.get("h", place(F.get("two", i))) != F.get("h", place(F.get("two", i - 1)))))
    d = d.withColumn("mixed", mixed | (F.size("h") > low))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("q", F.when(F.col("mixed"), pairs))
    same = lambda x, y: F.coalesce(x["x"] == y["x"], F.lit(False))
    slow = F.transform(F.filter("q", lambda x, i: same(x, F.get("q", i - 1)) | same(x, F.get("q", i + 1))), lambda x: x["i"])
    d = d.withColumn("at", F.sort_array(F.when(F.col("mixed"), slow).otherwise(F.transform("two", place)))).drop("h", "two", "q", "mixed")
    # each window adds the words that the one before it has not
    new = F.transform("at", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get("at", i - 1), F.lit(-3))))
    return d.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("at")


def worded(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(lines_of(text), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def hot_lines(d: DataFrame, line_docs: int) -> DataFrame:
    """(host, text) -> (_host, _h, _g): hashes of the lines that at least line_docs rows of a host have, however many rows the host has."""
    keys = d.select("host", F.explode(F.array_distinct(F.transform(worded(F.col("text")), line_key))).alias("key")).select("host", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    found = keys.groupBy("host", "h", "g").agg(F.count("*").alias("docs")).filter(F.col("docs") >= line_docs)
    return found.select(F.col("host").alias("_host"), F.col("h").alias("_h"), F.col("g").alias("_g"))


def drop_hot_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", line_docs: int = 10) -> DataFrame:
    """docs with text without its hot lines, which quality_rules counts; other columns and all rows stay.

    Lines without a word stay. A null text stays null, and one that loses all lines becomes empty.
    """
    rid, own_id, own_rid, own_host, at, all_lines = fresh(docs, "rid", "own_id", "own_rid", "own_host", "at", "lines")
    docs = docs.withColumn(rid, F.xxhash64(F.lit(7), F.col(text)))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid"), F.col(host).alias("host"), F.col(text).alias("text"))
    rows = d.select("doc_id", "rid", "host", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).filter(F.btrim("line", F.lit(SPACES)) != "")
    rows = rows.select("doc_id", "rid", "host", "pos", line_key(F.col("line")).alias("key")).select("doc_id", "rid", "host", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    drop = rows.join(hot_lines(d, line_docs), F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left_semi")
    # rows of one id, host and text have the same places
    drop = drop.groupBy(F.col("doc_id").alias(own_id), F.col("rid").alias(own_rid), F.col("host").alias(own_host)).agg(F.array_sort(F.collect_set("pos")).alias(at))
    out = docs.join(drop, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(rid) == F.col(own_rid)) & F.col(host).eqNullSafe(F.col(own_host)), "left").withColumn(all_lines, lines_of(F.col(text)))
    ends = F.concat(F.array(F.lit(-1)), F.col(at), F.array(F.size(all_lines)))
    between = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(F.col(all_lines), F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1))
    left = F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(F.flatten(between), "\n"))
    return out.withColumn(text, left).select(*[c for c in docs.columns if c != rid])


def quality_rules(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, line_docs: int = 10, min_left_pct: int = 50
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, n_hot_lines, n_left_words and kept.

    A line with a word is removed if at least line_docs documents of its host have it; drop_hot_lines gives the texts that are
    left. A document is depleted, and not kept, if under min_left_pct percent of its words are left; base_failed documents are not
    kept either. Each row is a document, repeated rows too. Null, empty and blank texts have no words and fail; null hosts are
    one host, and null ids are ids like any other; very long texts count whole. No rows: none come back. Other columns of docs are not looked at.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(F.lit(7), F.col(text)).alias("rid"), F.col(text).alias("text"))
    # written: a filter on what comes out would else be moved below the counts, and work them out for each word anew
    counts = checkpointed(text_counts(d, F.col("text"), "doc_id", "rid", "host"))
    own = d.select("doc_id", "rid", "host", worded(F.col("text")).alias("lines"))
    hot = hot_lines(d, line_docs)
    rows = own.select("doc_id", "rid", "host", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc_id", "rid", "host", "pos", F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"), line_key(F.col("line")).alias("key"))
    rows = rows.select("doc_id", "rid", "host", "pos", "words", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    drop = rows.join(hot, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left_semi")
    # rows of one id, host and text have the same lines at the same places
    drop = drop.groupBy(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), F.col("host").alias("_host")).agg(F.collect_set(F.struct("pos", "words")).alias("hot"))
    out = counts.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid")) & F.col("host").eqNullSafe(F.col("_host")), "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    left = F.col("n_words") - F.coalesce(F.aggregate("hot", F.lit(0), lambda a, x: a + x["words"]), F.lit(0))
    out = out.withColumn("base_failed", failed).withColumn("n_hot_lines", F.when(F.col("hot").isNotNull(), F.size("hot")).otherwise(0).cast("long")).withColumn("n_left_words", left.cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_left_words") * 100 >= F.col("n_words") * min_left_pct)
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_hot_lines", "n_left_words")


def clean_documents(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, line_docs: int = 10, min_left_pct: int = 50
) -> DataFrame:
    """quality_rules with the texts: doc_id, host, text without its hot lines, the whole text's counts, base_failed, and n_left_words and
    kept, which follow from the text that is left.

    One row for each row of docs, repeated ones too. A null text stays null, fails and is not kept; one that loses all lines becomes empty. Null ids
    and hosts, very long texts and empty tables are as quality_rules has them; columns that docs has besides do not come back, whatever their names.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    out = drop_hot_lines(text_counts(d, F.col("text"), "doc_id", "host", "text"), host="host", line_docs=line_docs)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    out = out.withColumn("base_failed", failed).withColumn("n_left_words", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") * 100 >= F.col("n_words") * min_left_pct))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) >= 2),
covered AS (
  SELECT DISTINCT doc_id, i + k AS at FROM grams JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS o(k)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
hot AS (SELECT source, k FROM full_lines GROUP BY source, k HAVING count(DISTINCT doc_id) >= 10),
gone AS (
  SELECT doc_id, sum(words) AS words, count(*) AS n FROM full_lines f
  JOIN hot ON f.source IS NOT DISTINCT FROM hot.source AND f.k = hot.k GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    coalesce(gone.n, 0) AS n_hot_lines, len(w) - coalesce(gone.words, 0) AS n_left_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_left_words >= 50 * n_words AS kept,
  n_hot_lines::BIGINT AS n_hot_lines, n_left_words::BIGINT AS n_left_words
FROM counts
"""
