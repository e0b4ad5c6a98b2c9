"""Mining English loanwords: direct candidates from dictionaries and a skeleton probe of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import skeleton_score

#: Bangla consonants in the sounds of english_skeleton().
_SOUND = {"ক": "k", "খ": "k", "গ": "g", "ঘ": "g", "ঙ": "n", "চ": "s", "ছ": "s", "জ": "j", "ঝ": "j", "ঞ": "n", "ট": "t", "ঠ": "t", "ড": "d", "ঢ": "d", "ণ": "n", "ত": "t", "থ": "t", "দ": "d", "ধ": "d", "ন": "n", "প": "p", "ফ": "f", "ব": "b", "ভ": "b", "ম": "m", "য": "j", "র": "r", "ল": "l", "শ": "s", "ষ": "s", "স": "s", "ড়": "r", "ঢ়": "r", "ৎ": "t", "ং": "n"}


def bangla_skeleton(word: Column) -> Column:
    keys = "".join(k for k in _SOUND if len(k) == 1)
    out = F.regexp_replace(F.translate(word, keys, "".join(_SOUND[k] for k in keys)), "[^a-z]", "")
    return F.regexp_replace(out, r"(.)\1+", "$1")


def english_key(value: Column) -> Column:
    """A clean lower-case key, or null: outer punctuation off, inner white space single; a letter, then up to 80 letters, spaces, dots, quotes and hyphens; no names of the language."""
    outer = r'[.,;:()\[\]{}"“”‘’]+'
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), f"^{outer}|{outer}$", ""), r"\s+", " ")
    low = F.lower(key)
    return F.when(key.rlike(r"^[A-Za-z][A-Za-z .'\-]{0,80}$") & ~low.isin("english", "middle english", "old english"), low)


def direct(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(english, bangla, frequency, evidence): pairs (english, bangla, evidence) whose Bangla word the lexicon has; evidence is a sorted set."""
    rows = pairs.select(english_key(F.col("english")).alias("english"), F.col("bangla").alias("word"), "evidence").where(F.col("english").isNotNull() & T.is_loose_bangla(F.col("word")))
    joined = rows.join(lexicon, "word")
    return joined.groupBy("english", F.col("word").alias("bangla")).agg(F.max("frequency").alias("frequency"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def rejects(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(reason, n): why pairs are no candidates."""
    known = lexicon.select(F.col("word").alias("bangla"), F.lit(True).alias("known")).distinct()
    reason = F.when(english_key(F.col("english")).isNull(), "english_key").when(~F.coalesce(T.is_loose_bangla(F.col("bangla")), F.lit(False)), "not_bangla").when(F.col("known").isNull(), "not_in_lexicon")
    return pairs.join(known, "bangla", "left").select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def probe(keys: DataFrame, lexicon: DataFrame, distance: int = 3, k: int = 12) -> DataFrame:
    """(english, rank, word, distance, score): lexicon words with a skeleton near the key's, of the same first sound and a length within 3.

    The band join's equality is on the first sound and the length, each key asking for the seven lengths about its own.
    """
    a = keys.select("english", T.english_skeleton(F.col("english")).alias("sk")).where(F.length("sk") > 1).distinct()
    a = a.select("english", "sk", F.explode(F.sequence(F.length("sk") - 3, F.length("sk") + 3)).alias("n"), F.substring("sk", 1, 1).alias("s"))
    b = lexicon.select("word", "frequency", bangla_skeleton(F.col("word")).alias("sk2")).where(F.length("sk2") > 1)
    b = b.select("word", "frequency", "sk2", F.length("sk2").alias("n"), F.substring("sk2", 1, 1).alias("s"))
    d = F.levenshtein("sk", "sk2", distance)
    rows = a.join(b, ["n", "s"]).withColumn("distance", d).where("distance >= 0").withColumn("score", skeleton_score(F.col("distance"), F.col("frequency")))
    order = Window.partitionBy("english").orderBy(F.desc("score"), "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("english", "rank", "word", "distance", "score")


def coverage(keys: DataFrame, table: DataFrame, probes: DataFrame) -> DataFrame:
    """(english, listed, probed): per key the Bangla words listed for it, and those the probe finds, in order."""
    listed = table.groupBy("english").agg(F.array_sort(F.collect_set("bangla")).alias("listed"))
    found = probes.groupBy("english").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("probed"))
    return keys.select("english").distinct().join(listed, "english", "left").join(found, "english", "left")
