"""Registered queries on words, units, speakers and mixtures, and what they are in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from phonolake.jobs import spectra_sql as Q
from phonolake.jobs.frame_queries import SEQUENCES_SQL, sequences
from phonolake.jobs.inputs import SAMPLES_SQL, SENTENCES_SQL, VECTORS_SQL, samples, sentences, table, vectors
from phonolake.jobs.signal_queries import as_decimals, decimals_sql, rounded
from phonolake.operators import lexicon as X
from phonolake.operators import separation as I
from phonolake.operators import speakers as S
from phonolake.operators import units as U
from phonolake.sources.folders import checkpointed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LEXICON = [("the", ["dh", "ax"]), ("of", ["o", "v_final"]), ("and", ["a", "n", "d_final"]), ("to", ["t", "oo"]), ("in", ["i", "n_final"]), ("la", ["l", "a"]), ("de", ["d", "e"]), ("der", ["d", "e", "r_final"]), ("que", ["k", "e"]), ("en", ["e", "n_final"])]
LEXICON_SQL = "lex(word, phones) AS (VALUES " + ", ".join(f"('{w}', {p})" for w, p in LEXICON) + ")"


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, phones array<string>")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select(F.explode("tokens").alias("word")).filter(~F.col("word").isin("<s>", "</s>")).distinct()


_MAP = "map_from_entries([" + ", ".join(f"('{a}', '{b}')" for a, b in X.RULES) + "])"
_G2P = f"list_transform(regexp_extract_all(word, '(?i){'|'.join(a for a, _ in X.RULES)}|.'), lambda g: coalesce({_MAP}[lower(g)], g))"
WORDS_SQL = f"{SENTENCES_SQL}, words AS (SELECT DISTINCT word FROM (SELECT unnest(tokens) AS word FROM train) WHERE word NOT IN ('<s>', '</s>')), {LEXICON_SQL}"
LOOKUP_SQL = f"{WORDS_SQL}, look AS (SELECT w.word, coalesce(lex.phones, {_G2P.replace('word', 'w.word', 1)}) AS phones, CASE WHEN lex.word IS NULL THEN 'rules' ELSE 'lexicon' END AS source FROM words w LEFT JOIN lex ON lex.word = w.word)"


@query(f"WITH {WORDS_SQL} SELECT word, array_to_string({_G2P}, ' ') AS phones FROM words")
def g2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", F.array_join(X.g2p(F.col("word")), " ").alias("phones"))


@query(f"WITH {LOOKUP_SQL} SELECT word, array_to_string(phones, ' ') AS phones, source FROM look")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lexicon_lookup(words(spark, sf_dir), lexicon(spark)).withColumn("phones", F.array_join("phones", " "))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lexicon_lookup(words(spark, sf_dir), lexicon(spark))


@query(f"WITH {LOOKUP_SQL} SELECT phone, count(*) AS n FROM (SELECT unnest(phones) AS phone FROM look) GROUP BY phone")
def phoneme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.phoneme_counts(spoken(spark, sf_dir))


@query(f"""WITH {LOOKUP_SQL}, p AS (SELECT DISTINCT unnest(phones) AS phone FROM look)
SELECT CASE WHEN phone LIKE '%\\_final' ESCAPE '\\' THEN 'coda' WHEN phone IN ('a', 'aa', 'e', 'ee', 'i', 'o', 'oo', 'u', 'uu') THEN 'vowel' ELSE 'onset' END AS class, count(*) AS n FROM p GROUP BY 1""")
def phoneme_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.phoneme_classes(spoken(spark, sf_dir))


@query(f"""WITH {LOOKUP_SQL}, r AS (SELECT word AS rec_id, phones, len(phones) AS k, 20 + length(word) * 7 AS n_frames FROM look),
e AS (SELECT rec_id, k, n_frames, generate_subscripts(phones, 1) - 1 AS pos, unnest(phones) AS phone FROM r),
s AS (SELECT *, floor(pos * (n_frames / k))::INTEGER AS a, least(floor((pos + 1) * (n_frames / k))::INTEGER, n_frames) AS b FROM e)
SELECT rec_id, pos::INTEGER AS pos, phone, a AS start_frame, b::INTEGER AS end_frame, a * 10.0::DOUBLE AS start_ms, b * 10.0::DOUBLE AS end_ms FROM s""")
def phoneme_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spoken(spark, sf_dir).select(F.col("word").alias("rec_id"), "phones", (20 + F.char_length("word") * 7).alias("n_frames"))
    return X.phoneme_alignment(d)


@query(f"WITH {LOOKUP_SQL} SELECT word, array_to_string(list_transform(phones, lambda p: 'hmm_' || p), '-') AS chain FROM look")
def word_phone_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.word_phone_chain(spoken(spark, sf_dir))


_NORM = """list_filter(regexp_split_to_array(translate(lower({t}), '.,!?:;()"''-', '           '), '[ \\t\\n\\f\\r\\x0B]+'), lambda w: w <> '')"""
_SPOKEN = "flatten(list_transform({w}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN list_transform(string_split(w, ''), lambda d: ['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín'][d::INTEGER + 1]) ELSE [w] END))"
_TEXT = "event_type || ': ' || coalesce(props, '') || ' (' || event_id || ').'"


@query(f"SELECT event_id, array_to_string({_SPOKEN.format(w=_NORM.format(t=_TEXT))}, ' ') AS words FROM events")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.col("event_type"), F.lit(": "), F.coalesce("props", F.lit("")), F.lit(" ("), F.col("event_id").cast("string"), F.lit(")."))
    return e.select("event_id", F.array_join(U.normalize_text(text), " ").alias("words"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("sent_id", F.posexplode("tokens").alias("pos", "token"))


def spoken_units(spark: SparkSession) -> DataFrame:
    return lexicon(spark).select(F.col("word").alias("token"), F.concat(F.lit("u_"), "word").alias("unit"))


TOKENS_SQL = f"{SENTENCES_SQL}, tok AS (SELECT sent_id, (generate_subscripts(tokens, 1) - 1)::INTEGER AS pos, unnest(tokens) AS token FROM train), {LEXICON_SQL}"


@query(f"WITH {TOKENS_SQL} SELECT sent_id, pos, token, 'u_' || token AS unit FROM tok JOIN lex ON word = token")
def tokens_to_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tokens_to_units(tokens(spark, sf_dir), spoken_units(spark))


@query(f"WITH {TOKENS_SQL} SELECT token, count(*) AS n FROM tok WHERE token NOT IN (SELECT word FROM lex) GROUP BY token")
def oov_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.oov_report(tokens(spark, sf_dir), spoken_units(spark))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are brands, candidates all their parts."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit"), F.col("p_partkey").alias("candidate"), (0.2 + F.col("p_size") / 100).alias("duration_s"), (F.col("p_retailprice") / 20000).cast("double").alias("rms"))


def useful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a least path can need, with their prices."""
    return checkpointed(U.useful_units(inventory(spark, sf_dir)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, pos, unit): sentences are orders, positions their lines."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    # brands first, so that lines numbered within their orders lie as sentences need them; lines without a part are numbered too
    brands = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_brand")).alias("brands"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).join(brands, F.col("l_partkey") == F.col("p_partkey"), "left")
    li = li.withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1)
    return li.select(F.col("l_orderkey").alias("sent_id"), "pos", F.explode("brands.p_brand").alias("unit"))


def edges(units: DataFrame) -> DataFrame:
    """Joining two units costs how far their levels lie apart, and a little for units of other brands: all pairs of useful parts, of which each brand has few."""
    i = units.select(F.concat_ws("#", "unit", "candidate").alias("key"), "unit", "rms")
    d = i.toDF("left", "ul", "rl").crossJoin(i.toDF("right", "ur", "rr"))
    return d.select("left", "right", (100 * F.abs(F.col("rl") - F.col("rr")) + F.when(F.col("ul") != F.col("ur"), 0.5).otherwise(0.0)).alias("join_cost"))


UNITS_SQL = """
inv AS (SELECT p_brand AS unit, p_partkey AS candidate, 0.2 + p_size / 100 AS duration_s, (p_retailprice / 20000)::DOUBLE AS rms FROM part),
price AS (SELECT unit, candidate, rms, 2 * pow((duration_s - 0.35) / 0.1, 2) + 5 * pow((rms - 0.08) / 0.02, 2) AS t FROM inv),
one AS (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY unit, rms ORDER BY t, candidate) = 1),
use AS (SELECT * FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.unit = a.unit AND b.rms <> a.rms AND b.t + 200 * abs(a.rms - b.rms) <= a.t)),
pos AS (SELECT l_orderkey AS sent_id, (k - 1)::INTEGER AS pos, p_brand AS unit FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem) JOIN part ON p_partkey = l_partkey),
tc AS (SELECT pos.*, candidate, t AS target_cost, rms FROM pos JOIN use USING (unit))"""
_DP = UNITS_SQL + """,
uj AS (SELECT a.unit AS u1, a.candidate AS c1, b.unit AS u2, b.candidate AS c2, 100 * abs(a.rms - b.rms) + CASE WHEN a.unit <> b.unit THEN 0.5 ELSE 0 END AS j FROM use a, use b),
dp AS (SELECT sent_id, pos, unit, candidate, target_cost AS v FROM tc WHERE pos = 0
  UNION ALL SELECT w.sent_id, w.pos, w.unit, w.candidate, min(dp.v + j) + w.target_cost FROM dp JOIN tc w ON w.sent_id = dp.sent_id AND w.pos = dp.pos + 1
    JOIN uj ON u1 = dp.unit AND c1 = dp.candidate AND u2 = w.unit AND c2 = w.candidate GROUP BY w.sent_id, w.pos, w.unit, w.candidate, w.target_cost),
ends AS (SELECT sent_id, max(pos) AS pos FROM pos GROUP BY sent_id),
best AS (SELECT sent_id, min(v) AS cost FROM dp JOIN ends USING (sent_id, pos) GROUP BY sent_id)"""


@query(f"WITH {UNITS_SQL} SELECT sent_id, pos, unit, candidate, round(target_cost, 6) AS target_cost FROM tc")
def target_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each useful part at each position."""
    i = inventory(spark, sf_dir).join(useful(spark, sf_dir).select("unit", "candidate"), ["unit", "candidate"], "left_semi")
    return U.target_cost(places(spark, sf_dir).join(i.select("unit", "candidate"), "unit"), i)


def lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Positions with their useful parts and prices, and the joins' costs."""
    u = useful(spark, sf_dir)
    return places(spark, sf_dir).join(u.select("unit", "candidate", "target_cost"), "unit"), edges(u)


@query(f"WITH {UNITS_SQL} SELECT a.sent_id, a.pos, a.candidate AS c_left, b.candidate AS c_right, round(100 * abs(a.rms - b.rms) + CASE WHEN a.unit <> b.unit THEN 0.5 ELSE 0 END, 6) AS join_cost FROM tc a JOIN tc b ON b.sent_id = a.sent_id AND b.pos = a.pos + 1")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lattice_edges(*lattice(spark, sf_dir)).select("sent_id", "pos", "c_left", "c_right", "join_cost")


@query(f"WITH RECURSIVE {_DP} SELECT sent_id, {decimals_sql('cost')} AS cost FROM best")
def unit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost over the lattice of all useful parts."""
    u = useful(spark, sf_dir)
    return U.table_selection(places(spark, sf_dir), u, edges(u)).select("sent_id", as_decimals(F.col("cost")).alias("cost"))


@query()
def unit_selection_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the parts chosen, and joins priced where positions meet instead of by a table of them."""
    d = U.least_cost(places(spark, sf_dir), inventory(spark, sf_dir))
    return d.select("sent_id", as_decimals(F.col("cost")).alias("cost"), F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query(f"""WITH RECURSIVE {_DP}, first AS (SELECT unit, arg_min(t, candidate) AS t, arg_min(rms, candidate) AS rms FROM price GROUP BY unit),
fx AS (SELECT sent_id, pos, unit, t, rms, lag(rms) OVER w AS rms0, lag(unit) OVER w AS unit0 FROM pos JOIN first USING (unit) WINDOW w AS (PARTITION BY sent_id ORDER BY pos)),
f AS (SELECT sent_id, sum(t + coalesce(100 * abs(rms - rms0) + CASE WHEN unit <> unit0 THEN 0.5 ELSE 0 END, 0)) AS fixed FROM fx GROUP BY sent_id)
SELECT sent_id, {decimals_sql('fixed')} AS fixed_cost, {decimals_sql('cost')} AS cost, {decimals_sql('100 * (fixed - cost) / fixed', 2)} + 0.0 AS reduction_pct FROM f JOIN best USING (sent_id)""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's first part all along against the best choice of all."""
    p, i = places(spark, sf_dir), inventory(spark, sf_dir)
    d = U.first_and_least(p, i)
    return d.withColumns({"reduction_pct": as_decimals(F.col("reduction_pct"), 2)} | {c: as_decimals(F.col(c)) for c in ("fixed_cost", "cost")})


@query("""WITH i AS (SELECT 0.2 + p_size / 100 AS d, p_retailprice / 20000 AS r FROM part)
SELECT floor(d / 0.05)::INTEGER AS bin, count(*) AS n, round(avg(d), 6) AS mean_duration, round(stddev_pop(d), 6) + 0.0 AS sd_duration, round(avg(r), 6) AS mean_rms FROM i GROUP BY 1""")
def inventory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.inventory_stats(table(spark, sf_dir, "part").select((0.2 + F.col("p_size") / 100).alias("duration_s"), (F.col("p_retailprice") / 20000).alias("rms")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, f0_base, f1, f2, f3, dur_ms, voiced) of every token: from the part whose number its count leads to."""
    t = tokens(spark, sf_dir).groupBy("token").agg((1 + F.count("*") % 100).alias("p_partkey"))
    d = t.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"), F.floor("p_retailprice").cast("int").alias("r")), "p_partkey")
    number = lambda c: c.cast("double")
    return d.select("token", number(100 + 2 * F.col("s")).alias("f0_base"), number(300 + F.col("r") % 500).alias("f1"), number(900 + F.col("r") * 7 % 800).alias("f2"), number(2200 + 8 * F.col("s")).alias("f3"), (80 + 4 * F.col("s")).alias("dur_ms"), (F.col("s") % 4 != 0).alias("voiced"))


_TRACKS_SQL = f"""WITH {TOKENS_SQL}, prof AS (SELECT token, (100 + 2 * p_size)::DOUBLE AS f0_base, (300 + floor(p_retailprice)::INTEGER % 500)::DOUBLE AS f1, (900 + floor(p_retailprice)::INTEGER * 7 % 800)::DOUBLE AS f2, (2200 + 8 * p_size)::DOUBLE AS f3,
  80 + 4 * p_size AS dur_ms, p_size % 4 <> 0 AS voiced FROM (SELECT token, 1 + count(*) % 100 AS k FROM tok GROUP BY token) JOIN part ON p_partkey = k),
len AS (SELECT sent_id, pos, token, prof.* EXCLUDE (token), greatest(3, round_even(dur_ms / 1000 * 100, 0))::INTEGER AS frames FROM tok JOIN prof USING (token)),
ab AS (SELECT *, round_even(frames * 0.25, 0)::INTEGER AS la, round_even(frames * 0.5, 0)::INTEGER AS lb, coalesce(sum(frames) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM len),
st AS (SELECT *, 0 AS state, la AS ln, 0 AS shift FROM ab UNION ALL SELECT *, 1, lb, la FROM ab UNION ALL SELECT *, 2, frames - la - lb, la + lb FROM ab),
ex AS (SELECT *, unnest(range(0, ln))::INTEGER AS fr FROM st WHERE ln > 0),
fr AS (SELECT sent_id, pos, token, (state + 1)::INTEGER AS state, start + shift + fr AS t, CASE WHEN voiced THEN f0_base + 15.0 * sin(pi() * (fr + state * ln) / frames) ELSE 0 END AS f0,
  f1 * CASE state WHEN 0 THEN 0.85 WHEN 1 THEN 1.05 ELSE 0.9 END AS f1, f2 * CASE state WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 0.95 END AS f2, f3,
  CASE WHEN voiced THEN 0.08 * pow(sin(pi() * ((start + shift + fr) % frames) / frames), 0.8) ELSE 0.0008 END AS energy FROM ex),
cnt AS (SELECT sent_id, count(*) AS n FROM fr GROUP BY sent_id), ix AS (SELECT fr.*, n FROM fr JOIN cnt USING (sent_id)),
nb AS (SELECT sent_id, t, o, CASE WHEN t + o < 0 THEN -(t + o) - 1 WHEN t + o >= n THEN 2 * n - 1 - t - o ELSE t + o END AS u, n FROM ix, range(-3, 4) AS q(o)),
sm AS (SELECT nb.sent_id, nb.t, avg(h.f0) FILTER (WHERE abs(o) <= 2) AS f0, avg(h.f1) AS f1, avg(h.f2) AS f2, avg(h.f3) AS f3, avg(h.energy) FILTER (WHERE abs(o) <= 2) AS energy FROM nb JOIN fr h ON h.sent_id = nb.sent_id AND h.t = least(greatest(u, 0), n - 1) GROUP BY nb.sent_id, nb.t)
SELECT ix.sent_id, ix.t, pos, token, state, round(sm.f0, 6) AS f0, round(sm.f1, 6) AS f1, round(sm.f2, 6) AS f2, round(sm.f3, 6) AS f3, round(sm.energy, 6) + 0.0 AS energy FROM ix JOIN sm ON sm.sent_id = ix.sent_id AND sm.t = ix.t"""


@query(_TRACKS_SQL)
def parametric_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.parametric_tracks(tokens(spark, sf_dir), profiles(spark, sf_dir))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are embeddings, 64 samples each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def cut_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of 0 to 64 samples: embeddings, cut by their numbers, a third of them whole."""
    return waves(spark, sf_dir).withColumn("samples", F.slice("samples", F.lit(1), F.when(F.col("vec_id") % 3 == 0, 64).otherwise((F.col("vec_id") * 7 % 65).cast("int"))))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("left"), F.lead("vec_id").over(W.partitionBy("label").orderBy("vec_id")).cast("string").alias("right")).dropna()


@query(Q.JOIN_COST)
def join_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a label at 1,600 samples a second, where 25 ms are 40 samples: longer, shorter and empty units."""
    return U.join_cost(neighbours(spark, sf_dir), cut_waves(spark, sf_dir), fs=1600)


@query(Q.BOUNDARY_LSD)
def boundary_lsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = U.join_cost(neighbours(spark, sf_dir), cut_waves(spark, sf_dir), fs=1600)
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("left"), "label")
    return d.join(label, "left").groupBy("label").agg(F.avg("boundary_lsd").alias("mean_lsd"), F.count("*").alias("n"))


#: Milliseconds of the ramps that are compared, at 800 samples a second.
FADES = (0, 5, 15, 30)


@query(f"WITH {Q.CELLS} " + " UNION ALL ".join(f"SELECT {ms} AS fade_ms, * FROM ({Q.crossfade(ms * 8 // 10)})" for ms in FADES))
def crossfade_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of crossfade_concat with ramps of several lengths."""
    out = None
    for ms in FADES:
        d = _crossfaded(spark, sf_dir, ms * 8 // 10).select(F.lit(ms).alias("fade_ms"), "*")
        out = d if out is None else out.unionAll(d)
    return out


@query(f"WITH {Q.CELLS} {Q.crossfade(8)}")
def crossfade_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossfaded(spark, sf_dir, 8)


def _crossfaded(spark: SparkSession, sf_dir: str, fade: int) -> DataFrame:
    """Each ten vectors in a row are a sentence."""
    w = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("sent_id"), (F.col("vec_id") % 10).cast("int").alias("pos"), "samples")
    return U.crossfade_concat(w, fade).select("sent_id", F.size("samples").alias("n_samples"), F.array_join(F.col("boundaries").cast("array<string>"), " ").alias("boundaries"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


@query(f"""WITH {SEQUENCES_SQL}, s AS (SELECT rec_id, dim, avg(v) AS m, stddev_pop(v) AS d FROM seq GROUP BY rec_id, dim),
e AS (SELECT rec_id, 0 AS part, dim, m AS y FROM s UNION ALL SELECT rec_id, 1, dim, d FROM s)
SELECT rec_id, (part * 8 + dim)::INTEGER AS k, round(y / (sqrt(sum(y * y) OVER (PARTITION BY rec_id)) + 1e-12), 6) + 0.0 AS y FROM e""")
def speaker_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speaker_embedding(sequences(spark, sf_dir)).select("rec_id", F.posexplode("vec").alias("k", "y"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speaker_models(vectors(spark, sf_dir).filter("role = 'enroll'"))


def _models_sql(where: str = "role = 'enroll'", name: str = "mod") -> str:
    return f""", {name}_l AS (SELECT speaker, generate_subscripts(vec, 1) AS i, unnest(vec) AS v FROM vectors WHERE {where}),
{name}_m AS (SELECT speaker, i, avg(v) AS y FROM {name}_l GROUP BY speaker, i),
{name} AS (SELECT speaker, list(y / (n + 1e-12) ORDER BY i) AS vec FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY speaker)) AS n FROM {name}_m) GROUP BY speaker)"""


def _trials_sql(role: str, name: str = "tri", mod: str = "mod") -> str:
    return f""", {name} AS (SELECT m.speaker AS claim, t.speaker AS actual, t.rec_id, list_dot_product(t.vec, m.vec) / (sqrt(list_dot_product(t.vec, t.vec)) * sqrt(list_dot_product(m.vec, m.vec)) + 1e-12) AS score,
  (m.speaker = t.speaker)::INTEGER AS genuine FROM vectors t, {mod} m WHERE t.role = '{role}')"""


@query(f"WITH {VECTORS_SQL}{_models_sql()} SELECT speaker, (generate_subscripts(vec, 1) - 1)::INTEGER AS i, round(unnest(vec), 6) + 0.0 AS y FROM mod")
def speaker_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("speaker", F.posexplode("vec").alias("i", "y"))


@query(f"""WITH {VECTORS_SQL}, p AS (SELECT rec_id, vec, lead(vec) OVER (ORDER BY rec_id) AS nxt, lead(rec_id) OVER (ORDER BY rec_id) AS other FROM vectors)
SELECT rec_id, other, round(list_dot_product(vec, nxt) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(nxt, nxt)) + 1e-12), 6) + 0.0 AS score,
  round(sqrt(list_dot_product(vec, vec) + list_dot_product(nxt, nxt) - 2 * list_dot_product(vec, nxt)), 6) AS distance FROM p WHERE nxt IS NOT NULL""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonolake.functions.columns import cosine_similarity, frame_distance

    v = vectors(spark, sf_dir).select("rec_id", "vec")
    n = v.select((F.col("rec_id") - 1).alias("rec_id"), F.col("rec_id").alias("other"), F.col("vec").alias("nxt"))
    return v.join(n, "rec_id").select("rec_id", "other", cosine_similarity(F.col("vec"), F.col("nxt")).alias("score"), frame_distance(F.col("vec"), F.col("nxt")).alias("distance"))


def trials(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return S.verification_trials(vectors(spark, sf_dir).filter(F.col("role") == role), models(spark, sf_dir))


@query(f"WITH {VECTORS_SQL}{_models_sql()}{_trials_sql('test')} SELECT claim, actual, rec_id, round(score, 6) + 0.0 AS score, genuine FROM tri")
def verification_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir, "test")


_BEST = """SELECT rec_id, actual, claim AS pred, score, score - lead(score) OVER (PARTITION BY rec_id ORDER BY score DESC, claim) AS margin,
  row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, claim) AS k FROM {t}"""


@query(f"WITH {VECTORS_SQL}{_models_sql()}{_trials_sql('test')}, b AS ({_BEST.format(t='tri')}) SELECT rec_id, actual, pred, round(score, 6) AS score, round(margin, 6) AS margin FROM b WHERE k = 1")
def speaker_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speaker_identify(vectors(spark, sf_dir).filter("role = 'test'"), models(spark, sf_dir))


SWEEP_SQL = f"""{VECTORS_SQL}{_models_sql()}{_trials_sql('dev')}, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM tri),
grid AS (SELECT DISTINCT theta FROM (SELECT -1 + 2 * k / 400 AS theta FROM range(401) AS r(k) UNION ALL SELECT lo - 0.005 + (hi - lo + 0.01) * k / 999 FROM range(1000) AS r(k), ends)),
sweep AS (SELECT theta, avg((score >= theta)::INTEGER) FILTER (WHERE genuine = 0) AS far, avg((score < theta)::INTEGER) FILTER (WHERE genuine = 1) AS frr FROM grid, tri GROUP BY theta)"""


@query(f"WITH {SWEEP_SQL} SELECT round(theta, 6) + 0.0 AS theta, round(far, 6) AS far, round(frr, 6) AS frr FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.threshold_sweep(trials(spark, sf_dir, "dev"))


@query(f"WITH {SWEEP_SQL} SELECT round(theta, 6) AS theta, round(far, 6) AS far, round(frr, 6) AS frr FROM sweep ORDER BY round(abs(far - frr), 12), sweep.theta LIMIT 1")
def equal_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.equal_error(S.threshold_sweep(trials(spark, sf_dir, "dev")))


@query(f"""WITH {VECTORS_SQL}{_models_sql()}{_trials_sql('test')}
SELECT round(avg((score >= 0.1)::INTEGER) FILTER (WHERE genuine = 0), 6) AS far, round(avg((score < 0.1)::INTEGER) FILTER (WHERE genuine = 1), 6) AS frr, count(*) AS n FROM tri""")
def verify_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.verify_at_threshold(trials(spark, sf_dir, "test"), 0.1)


_ABLATION_SQL = f"""WITH {VECTORS_SQL}, {SEQUENCES_SQL}, ft AS (SELECT rec_id, dim, frame_idx AS t, v FROM seq), {Q.delta("ft", "dl")},
kinds AS (SELECT 'plain' AS kind, rec_id, dim, t, v FROM ft UNION ALL SELECT 'delta', rec_id, dim, t, v FROM ft UNION ALL SELECT 'delta', rec_id, dim + 8, t, v FROM dl
  UNION ALL SELECT 'cmn', rec_id, dim, t, v - avg(v) OVER (PARTITION BY rec_id, dim) FROM ft UNION ALL SELECT 'cmn', rec_id, dim + 8, t, v FROM dl),
st AS (SELECT kind, rec_id, dim, avg(v) AS m, stddev_pop(v) AS d FROM kinds GROUP BY ALL), parts AS (SELECT kind, rec_id, dim, m AS y FROM st UNION ALL SELECT kind, rec_id, dim + 100, d FROM st),
emb AS (SELECT kind, rec_id, dim, y / (sqrt(sum(y * y) OVER (PARTITION BY kind, rec_id)) + 1e-12) AS y FROM parts),
cfg(config, kind, first) AS (VALUES {", ".join(f"('{n}', '{'cmn' if c else 'delta' if d else 'plain'}', {k})" for n, d, c, k in S.ABLATION)}),
enr AS (SELECT rec_id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY rec_id) AS j FROM vectors WHERE role = 'enroll'),
mean AS (SELECT config, speaker, dim, avg(y) AS y FROM cfg JOIN emb USING (kind) JOIN enr USING (rec_id) WHERE j <= first GROUP BY ALL),
sc AS (SELECT c.config, t.rec_id, t.speaker AS actual, m.speaker AS claim, sum(e.y * m.y) / (sqrt(sum(e.y * e.y)) * sqrt(sum(m.y * m.y)) + 1e-12) AS score FROM cfg c JOIN emb e USING (kind) JOIN vectors t ON t.rec_id = e.rec_id AND t.role = 'test'
  JOIN mean m ON m.config = c.config AND m.dim = e.dim GROUP BY ALL),
b AS (SELECT config, actual, claim AS pred, score - lead(score) OVER w AS margin, row_number() OVER w AS k FROM sc WINDOW w AS (PARTITION BY config, rec_id ORDER BY score DESC, claim))
SELECT config, round(100 * avg((pred = actual)::INTEGER), 6) AS accuracy_pct, round(avg(margin), 6) AS mean_margin FROM b WHERE k = 1 GROUP BY config"""


@query(_ABLATION_SQL)
def speaker_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speaker_ablation(sequences(spark, sf_dir), vectors(spark, sf_dir).select("rec_id", "speaker", "role"))


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events in order of their ids: values that rise within each seven, and each other one's own value."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), "value", "user_id")
    return e.select("n", ((F.col("n") % 7) - 3.0).alias("x")), e.select("n", F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("x"))


MIX_SQL = """src AS (SELECT event_id AS n, event_id % 7 - 3.0 AS a, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS b FROM events),
nrm AS (SELECT sqrt(avg(a * a)) AS ra, sqrt(avg(b * b)) AS rb FROM src), s AS (SELECT n, a / ra AS s1, b / rb AS s2 FROM src, nrm),
mix AS (SELECT n, s1, s2, s1 + 0.6 * s2 AS x1, 0.4 * s1 + s2 AS x2 FROM s)"""


@query(f"WITH {MIX_SQL} SELECT n, round(s1, 6) + 0.0 AS s1, round(s2, 6) + 0.0 AS s2, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2 FROM mix")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.mix_sources(*sources(spark, sf_dir))


def _ica_sql(mix: str, p: str) -> str:
    """mix (n, s1, s2, x1, x2) -> {p}end (it, w11, w12, w21, w22, change) and {p}sep (n, s1, s2, x1, x2, e1, e2): axes and polar factors of 2 x 2 matrices in closed form,
    the steps by recursion."""
    return f"""{p}c AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c FROM {mix}),
{p}l AS (SELECT *, (a + c) / 2 + sg * sqrt((a - c) * (a - c) / 4 + b * b) AS l, sg FROM {p}c, (VALUES (-1), (1)) AS q(sg)),
{p}v AS (SELECT *, abs(b) / sqrt(b * b + (l - a) * (l - a)) AS v1, sign(b) * (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v2 FROM {p}l),
{p}w AS (SELECT m1, m2, v1 / sqrt(l) AS u1, v2 / sqrt(l) AS u2, sg FROM {p}v),
{p}z AS (SELECT n, s1, s2, x1, x2, lo.u1 * (x1 - lo.m1) + lo.u2 * (x2 - lo.m2) AS z1, hi.u1 * (x1 - hi.m1) + hi.u2 * (x2 - hi.m2) AS z2 FROM {mix}, {p}w lo, {p}w hi WHERE lo.sg = -1 AND hi.sg = 1),
{p}steps AS (SELECT 0 AS it, 0.8::DOUBLE AS w11, 0.6::DOUBLE AS w12, -0.6::DOUBLE AS w21, 0.8::DOUBLE AS w22, 1e300::DOUBLE AS change UNION ALL
  SELECT it + 1, u11, u12, u21, u22, greatest(abs(abs(u11 * w11 + u12 * w12) - 1), abs(abs(u21 * w21 + u22 * w22) - 1)) FROM (
  SELECT it, w11, w12, w21, w22, p11 / len AS u11, p12 / len AS u12, p21 / len AS u21, p22 / len AS u22 FROM (
  SELECT *, a + d * s AS p11, b - c * s AS p12, c - b * s AS p21, d + a * s AS p22, sqrt((a + d * s) * (a + d * s) + (b - c * s) * (b - c * s)) AS len FROM (
  SELECT *, CASE WHEN a * d >= b * c THEN 1 ELSE -1 END AS s FROM (
  SELECT it, w11, w12, w21, w22, avg(z1 * t1) - w11 * avg(1 - t1 * t1) AS a, avg(z2 * t1) - w12 * avg(1 - t1 * t1) AS b, avg(z1 * t2) - w21 * avg(1 - t2 * t2) AS c, avg(z2 * t2) - w22 * avg(1 - t2 * t2) AS d FROM (
  SELECT it, w11, w12, w21, w22, z1, z2, tanh(w11 * z1 + w12 * z2) AS t1, tanh(w21 * z1 + w22 * z2) AS t2 FROM {p}steps, {p}z WHERE change >= 1e-4 AND it < 1000) GROUP BY it, w11, w12, w21, w22))))),
{p}end AS (SELECT * FROM {p}steps ORDER BY it DESC LIMIT 1),
{p}sep AS (SELECT n, s1, s2, x1, x2, w11 * z1 + w12 * z2 AS e1, w21 * z1 + w22 * z2 AS e2 FROM {p}z, {p}end)"""


def _resolved_sql(p: str) -> str:
    """{p}sep -> {p}r (source, estimate, corr): estimates in the order and with the signs that fit the sources best."""
    return f"""{p}k AS (SELECT corr(s1, e1) AS c11, corr(s1, e2) AS c12, corr(s2, e1) AS c21, corr(s2, e2) AS c22 FROM {p}sep), {p}o AS (SELECT *, abs(c12) + abs(c21) > abs(c11) + abs(c22) AS swap FROM {p}k),
{p}f AS (SELECT CASE WHEN swap THEN c12 ELSE c11 END AS a, CASE WHEN swap THEN c11 ELSE c12 END AS b, CASE WHEN swap THEN c22 ELSE c21 END AS c, CASE WHEN swap THEN c21 ELSE c22 END AS d FROM {p}o),
{p}g AS (SELECT *, CASE WHEN a >= 0 THEN 1 ELSE -1 END AS i, CASE WHEN d >= 0 THEN 1 ELSE -1 END AS j FROM {p}f),
{p}r AS (SELECT 1 AS source, 1 AS estimate, a * i AS corr FROM {p}g UNION ALL SELECT 1, 2, b * j FROM {p}g UNION ALL SELECT 2, 1, c * i FROM {p}g UNION ALL SELECT 2, 2, d * j FROM {p}g)"""


@query(f"""WITH RECURSIVE {MIX_SQL}, {_ica_sql('mix', 'i')} SELECT n, round(s1, 6) + 0.0 AS s1, round(s2, 6) + 0.0 AS s2, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2,
  round(e1, 6) + 0.0 AS e1, round(e2, 6) + 0.0 AS e2 FROM isep""")
def fast_ica(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fast_ica(I.mix_sources(*sources(spark, sf_dir)))


@query(f"WITH RECURSIVE {MIX_SQL}, {_ica_sql('mix', 'i')} SELECT it::INTEGER AS steps, round(change, 6) AS change, change < 1e-4 AS settled FROM iend")
def ica_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the separation ended: steps, the last change, and whether it settled."""
    w = I.unmixing(I.mix_sources(*sources(spark, sf_dir)))
    return spark.createDataFrame([(w.steps, w.change, w.settled)], "steps int, change double, settled boolean")


@query(f"""WITH {MIX_SQL} SELECT 1 AS source, 1 AS estimate, round(corr(s1, x1), 6) AS corr FROM mix UNION ALL SELECT 1, 2, round(corr(s1, x2), 6) FROM mix
UNION ALL SELECT 2, 1, round(corr(s2, x1), 6) FROM mix UNION ALL SELECT 2, 2, round(corr(s2, x2), 6) FROM mix""")
def source_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.mix_sources(*sources(spark, sf_dir))
    return I.source_correlation(m.withColumns({"e1": F.col("x1"), "e2": F.col("x2")}))


@query(f"WITH RECURSIVE {MIX_SQL}, {_ica_sql('mix', 'i')}, {_resolved_sql('i')} SELECT source, estimate, round(corr, 6) + 0.0 AS corr FROM ir")
def resolve_ica(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.resolve_ica(I.fast_ica(I.mix_sources(*sources(spark, sf_dir))))
    return I.source_correlation(d)


#: Name, mixing matrix and level of noise in dB.
ICA_CASES = [("clean", ((1.0, 0.6), (0.4, 1.0)), None), ("20 dB", ((1.0, 0.6), (0.4, 1.0)), 20), ("10 dB", ((1.0, 0.6), (0.4, 1.0)), 10), ("ill", ((1.0, 0.98), (0.97, 1.0)), None)]


def _noise_study_sql() -> str:
    tables, out = [MIX_SQL.rsplit(",\nmix AS", 1)[0]], []
    for i, (name, a, snr) in enumerate(ICA_CASES):
        noise = lambda k: f" + {10 ** (-snr / 20)!r} * ((('0x' || md5('{k} ' || n)[1:8])::BIGINT + 0.5) / 4294967296 - 0.5) * sqrt(12)" if snr else ""  # noqa: E731, B023
        tables.append(f"mix{i} AS (SELECT n, s1, s2, {a[0][0]} * s1 + {a[0][1]} * s2{noise('x1')} AS x1, {a[1][0]} * s1 + {a[1][1]} * s2{noise('x2')} AS x2 FROM s)")
        tables += [_ica_sql(f"mix{i}", f"i{i}"), _resolved_sql(f"i{i}")]
        flat, det = [v for row in a for v in row], f"({a[0][0]}::DOUBLE * {a[1][1]} - {a[0][1]}::DOUBLE * {a[1][0]})"
        power = f"({' + '.join(f'{v}::DOUBLE * {v}' for v in flat)})"
        cond = f"({power} + sqrt({power} * {power} - 4 * {det} * {det})) / (2 * abs({det}))"
        out.append(f"SELECT '{name}' AS \"case\", round(avg(abs(corr)), 6) AS mean_corr, round({det}, 6) AS det, round({cond}, 6) AS cond FROM i{i}r WHERE source = estimate")
    return f"WITH RECURSIVE {', '.join(tables)} {' UNION ALL '.join(out)}"


@query(_noise_study_sql())
def ica_noise_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations after separation at several noise levels, and for a mixing matrix that is close to singular."""
    out = None
    for name, a, snr in ICA_CASES:
        m = I.mix_sources(*sources(spark, sf_dir), a)
        if snr:  # uniform noise of unit variance, fixed by n
            u = lambda x: ((F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(x), F.col("n").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 - 0.5) * (12**0.5)
            m = m.withColumns({x: F.col(x) + 10 ** (-snr / 20) * u(x) for x in ("x1", "x2")})
        c = I.source_correlation(I.resolve_ica(I.fast_ica(m))).filter("source = estimate").agg(F.avg(F.abs("corr")).alias("mean_corr"))
        det, cond = I.mixing_condition(a)
        c = c.select(F.lit(name).alias("case"), "mean_corr", F.lit(det).alias("det"), F.lit(cond).alias("cond"))
        out = c if out is None else out.unionAll(c)
    return out
