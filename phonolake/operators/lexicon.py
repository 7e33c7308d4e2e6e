"""Pronunciation: a lexicon table (word, phones), letter-to-sound rules, and where phones lie in frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letter-to-sound rules, the first one that fits is taken.
RULES = (
    ("kh", "kh"), ("ng", "ng"), ("nh", "nh"), ("ch", "ch"), ("ph", "f"), ("th", "t_asp"), ("tr", "tr"), ("gi", "z"),
    ("oo", "oo"), ("uu", "uu"), ("aa", "aa"), ("ee", "ee"),
    ("b", "b"), ("c", "k"), ("d", "d"), ("đ", "d"), ("g", "g"), ("h", "h"), ("i", "i"), ("k", "k"), ("l", "l"), ("m", "m"), ("n", "n"), ("o", "o"),
    ("p", "p"), ("q", "kw"), ("r", "r"), ("s", "s"), ("t", "t"), ("u", "u"), ("v", "v"), ("x", "s"), ("y", "i"), ("a", "a"), ("e", "e"),
)


def g2p(word: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Phones of a word; characters that no rule has stay as they are. An alternation tries the rules in their order."""
    pattern = "(?i)" + "|".join(p for p, _ in rules) + "|."
    table = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    return F.transform(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), lambda g: F.coalesce(F.try_element_at(table, F.lower(g)), g))


def lexicon_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word) -> (word, phones, source): from the lexicon, else by rule."""
    d = words.join(lexicon.select("word", F.col("phones").alias("_own")), "word", "left")
    return d.withColumn("phones", F.coalesce("_own", g2p(F.col("word")))).withColumn("source", F.when(F.col("_own").isNotNull(), "lexicon").otherwise("rules")).drop("_own")


def phoneme_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.explode("phones").alias("phone")).groupBy("phone").agg(F.count("*").alias("n"))


def phoneme_classes(lexicon: DataFrame, vowels: tuple[str, ...] = ("a", "aa", "e", "ee", "i", "o", "oo", "u", "uu")) -> DataFrame:
    """How many distinct phones are codas (named _final), vowels and onsets."""
    p = lexicon.select(F.explode("phones").alias("phone")).distinct()
    kind = F.when(F.col("phone").endswith("_final"), "coda").when(F.col("phone").isin(*vowels), "vowel").otherwise("onset")
    return p.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def phoneme_alignment(words: DataFrame, fs: int = 16_000, hop: int = 160) -> DataFrame:
    """(rec_id, phones, n_frames) -> a row for each phone with its share of the frames, in frames and ms."""
    d = words.select("rec_id", "n_frames", F.size("phones").alias("k"), F.posexplode("phones").alias("pos", "phone"))
    each = F.col("n_frames") / F.col("k")
    d = d.withColumn("start_frame", F.floor(F.col("pos") * each).cast("int")).withColumn("end_frame", F.least(F.floor((F.col("pos") + 1) * each).cast("int"), F.col("n_frames")))
    ms = 1000 * hop / fs
    return d.select("rec_id", "pos", "phone", "start_frame", "end_frame", (F.col("start_frame") * ms).alias("start_ms"), (F.col("end_frame") * ms).alias("end_ms"))


def word_phone_chain(lexicon: DataFrame) -> DataFrame:
    """The names of the models that a word's phones make, one after the other."""
    return lexicon.select("word", F.concat_ws("-", F.transform("phones", lambda p: F.concat(F.lit("hmm_"), p))).alias("chain"))
