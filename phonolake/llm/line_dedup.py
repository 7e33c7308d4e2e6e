"""Line dedup: lines that many documents share lose all their copies.

Lines are exploded with their positions and hashed, documents are counted for each hash, and what is left of a
document is put together by position. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import SPACES, ascii_lower, fresh, read


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with text without the lines whose key at least min_docs documents have, n_lines and n_dropped added.

    A key is the stripped line, A-Z in lower case; keys shorter than min_chars stay. Rows of one id and text are one
    document, however often they come, and all of them stay. A null or empty text is one empty line, and its text stays as it is; a text that loses all lines becomes empty. Null ids are ids like any other.
    If docs has columns n_lines or n_dropped, the added ones get a leading underscore. No rows: none come back.

    Keys are told apart by 96 bits of hash. Counting works on (hash, row) pairs with map-side sums, the hot keys are
    joined back by sort-merge join, whose skewed keys Spark splits, and the text itself moves once at most.
    """
    n_lines, n_dropped, rid, all_lines, at, own_id, own_rid = fresh(docs, "n_lines", "n_dropped", "rid", "lines", "at", "own_id", "own_rid")
    docs = docs.withColumn(rid, F.xxhash64(F.lit(7), F.col(text)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(rid).alias("rid"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keys = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    keys = keys.select("id", "rid", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    # one row for a key and a row; both uses below read the same exchange
    held = keys.groupBy("h", "g", "id", "rid").agg(F.collect_list("pos").alias("pos"))
    hot = held.groupBy("h", "g").agg(F.sum(F.when(F.size("pos") > 0, 1)).alias("docs")).filter(F.col("docs") >= min_docs)
    drop = held.join(hot.select("h", "g"), ["h", "g"], "left_semi").groupBy("id", "rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias(at))
    out = docs.join(drop.withColumnsRenamed({"id": own_id, "rid": own_rid}), F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(rid) == F.col(own_rid)), "left").drop(own_id, own_rid)
    out = out.withColumn(all_lines, lines_of(F.col(text)))
    ends = F.concat(F.array(F.lit(-1)), F.col(at), F.array(F.size(all_lines)))
    between = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(F.col(all_lines), F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1))
    cleaned = F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(F.flatten(between), "\n"))
    out = out.withColumn(n_lines, F.size(all_lines).cast("long")).withColumn(n_dropped, F.coalesce(F.size(at), F.lit(0)).cast("long")).withColumn(text, cleaned)
    return out.drop(rid, all_lines, at)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keys AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k FROM keys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keys.*, hot.k IS NOT NULL AS drop_it FROM keys LEFT JOIN hot ON keys.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
