"""Lexicons: word frequencies, audits, merges, curation, prefix and fuzzy lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def frequencies(docs: DataFrame, tokens=T.latin_tokens, text: str = "text", min_frequency: int = 1, max_entries: int | None = None) -> DataFrame:
    """(word, frequency), most frequent first where max_entries cuts."""
    out = docs.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)
    return out if max_entries is None else out.orderBy(F.desc("frequency"), "word").limit(max_entries)


def validated(rows: DataFrame, valid=T.is_lexicon_word) -> DataFrame:
    """rows (word, frequency) with reason: why an entry is refused, null where it is good."""
    bad = F.when(F.coalesce(F.col("word"), F.lit("")) == "", "empty").when(F.col("frequency").isNull() | (F.col("frequency") < 0) | (F.col("frequency") > 4_294_967_295), "frequency").when(~valid(F.col("word")), "not_a_word")
    return rows.withColumn("reason", bad)


def strict(rows: DataFrame, valid=T.is_lexicon_word) -> DataFrame:
    """rows, failing on the first bad entry."""
    checked = validated(rows, valid)
    return checked.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("bad lexicon entry: "), F.col("reason"))).cast("boolean"))).drop("reason")


def merge_sum(lexicons: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Entries of any number of lexicons, frequencies of equal words added."""
    return lexicons.groupBy("word").agg(F.sum("frequency").alias("frequency")).where(F.col("frequency") >= min_frequency)


def merge_max(lexicons: DataFrame) -> DataFrame:
    """Entries with the largest frequency of equal words; empty words dropped."""
    return lexicons.where("word <> ''").groupBy("word").agg(F.max("frequency").alias("frequency"))


def audit(rows: DataFrame, valid: Column) -> DataFrame:
    """One row of counts over raw entries (word, frequency)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_distinct(F.when(ok, F.col("word"))).alias("unique_words"),
        F.coalesce(F.sum(F.when(ok, F.col("frequency"))), F.lit(0)).alias("total_frequency"), F.max(F.when(ok, F.col("frequency"))).alias("max_frequency"),
    )


def audit_pairs(pairs: DataFrame, cost: Column) -> DataFrame:
    """One row over pairs (source, expected): rows, accepted, identities, distinct, total and largest cost."""
    ok = F.coalesce((F.col("source") != "") & (F.col("expected") != "") & (F.col("source") != F.col("expected")), F.lit(False))
    return pairs.agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("accepted"), F.count_if(F.col("source") == F.col("expected")).alias("identity"),
        F.count_distinct(F.when(ok, F.struct("source", "expected"))).alias("unique_pairs"), F.coalesce(F.sum(F.when(ok, cost)), F.lit(0)).cast("long").alias("total_cost"), F.max(F.when(ok, cost)).cast("long").alias("max_cost"),
    )


def statistics(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count("*").alias("entries"), F.sum("frequency").alias("total_frequency"), F.max("frequency").alias("max_frequency"), F.max(F.length("word")).cast("long").alias("longest_word"))


#: By source and frequency the longest word that a rare entry may be without other evidence.
RARE_LENGTHS = {"epub": {1: 10, 2: 14}, "wiki": {2: 12}, "news": {2: 12}}


def curation(rows: DataFrame, loanwords: DataFrame, valid=T.is_lexicon_word, rare_lengths: dict = RARE_LENGTHS) -> DataFrame:
    """rows (source, word, frequency; a word once per source) with decision and reason: keep, drop or quarantine.

    Words against the grammar and of a corrupt shape are dropped. Of the others those stay that are more frequent than 2, that
    another source or the loanwords have too, or that are short enough for their source and frequency and hold no joiner.
    """
    sources = rows.groupBy("word").agg(F.count_distinct("source").alias("_sources"))
    loans = loanwords.select("word", F.lit(True).alias("_loan")).distinct()
    joined = rows.join(sources, "word").join(loans, "word", "left")
    f, fits = F.col("frequency"), F.lit(False)
    for source, lengths in rare_lengths.items():
        for n, longest in lengths.items():
            fits = fits | ((F.col("source") == source) & (f == n) & (F.length("word") <= longest))
    kept = (f > 2) | (F.col("_sources") > 1) | F.coalesce("_loan", F.lit(False)) | (fits & ~F.col("word").rlike(f"[{T.JOINER}]"))
    reason = F.when(~valid(F.col("word")), "invalid_bangla_token").when(T.has_corrupt_shape(F.col("word")), "obvious_corruption_shape").when(~kept, "unsupported_low_frequency")
    decision = F.when(F.col("reason").isNull(), "keep").when(F.col("reason") == "unsupported_low_frequency", "quarantine").otherwise("drop")
    return joined.select("source", "word", "frequency", reason.alias("reason")).withColumn("decision", decision)


def prefix_index(lexicon: DataFrame, k: int = 8, units: Column | None = None) -> DataFrame:
    """(prefix, rank, word, frequency): for every prefix of every word its k words of highest frequency, ties by word.

    Prefixes are runs of units (characters by default). A hot prefix is cut to k per input partition by the window's
    group limit before it is shuffled.
    """
    parts = F.col("_units")
    rows = lexicon.withColumn("_units", F.split("word", "") if units is None else units)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))
    rows = rows.where(F.size(parts) > 0).select("word", "frequency", F.explode(heads).alias("prefix"))
    order = Window.partitionBy("prefix").orderBy(F.desc("frequency"), "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("prefix", "rank", "word", "frequency")


def complete(queries: DataFrame, lexicon: DataFrame, n: int = 8) -> DataFrame:
    """(query, rank, word, frequency): the first n words in byte order that begin with the query, itself included.

    Words are keyed by their prefix of the queries' lengths, of which there are few, so the match is an equi-join.
    """
    lengths = queries.where("query <> ''").select(F.length("query").alias("n")).distinct()
    keyed = lexicon.join(F.broadcast(lengths), F.length("word") >= F.col("n")).select("word", "frequency", F.expr("left(word, n)").alias("query"))
    order = Window.partitionBy("query").orderBy("word")
    return queries.select("query").distinct().join(keyed, "query").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query", "rank", "word", "frequency")


def _neighbourhood(words: DataFrame, distance: int) -> DataFrame:
    """words with key: the word and all that remains after up to `distance` deletions. Made within each row, without a shuffle."""
    level = keys = F.array("word")
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, T.deletions)))
        keys = F.concat(keys, level)
    return words.select("*", F.explode(F.array_distinct(keys)).alias("key"))


#: Left words up to which a fuzzy join compares each right word with those of near length, at a cost that is linear in the right.
FEW = 256


def fuzzy_join(left: DataFrame, right: DataFrame, distance: int = 1, few: int = FEW) -> DataFrame:
    """(left_word, right_word, distance): pairs of words within an edit distance.

    A few left words are sent to all right ones and compared where lengths allow. More are found by shared deletions, then
    verified: a right word has some length ** distance / 2 of them, whether a left one is near or not.
    """
    words = left.select("word").where("word is not null").distinct()
    d = F.levenshtein("left_word", "right_word", distance)
    found = [r.word for r in words.limit(few + 1).collect()]
    if len(found) <= few:
        own = right.select(F.col("word").alias("right_word")).where("right_word is not null").distinct()
        known = left.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, found)).cast("array<string>")).alias("left_word"))
        known = known.select("left_word", F.explode(F.sequence(F.length("left_word") - distance, F.length("left_word") + distance)).alias("n"))
        return own.join(F.broadcast(known), (F.length("right_word") == F.col("n")) & (d >= 0)).select("left_word", "right_word", d.alias("distance"))
    a = _neighbourhood(words, distance).withColumnRenamed("word", "left_word")
    b = _neighbourhood(right.select("word").distinct(), distance).withColumnRenamed("word", "right_word")
    pairs = a.join(b, "key").select("left_word", "right_word").distinct()
    return pairs.withColumn("distance", d).where(F.col("distance") >= 0)


def _with_skeleton(words: DataFrame, name: str, skeleton, *others: str) -> DataFrame:
    """(name, skeleton, others): a word's skeleton is worked out once. As a generator's output it keeps filters above what counted
    the words; as a projection they are pushed below that aggregate and run the expression on each occurrence of a word."""
    made = F.explode(F.array(F.struct(F.col("word").alias(name), skeleton(F.col("word")).alias("skeleton"))))
    return words.select(*others, made.alias("_x")).select("_x.*", *others)


def skeleton_join(left: DataFrame, right: DataFrame, skeleton=T.english_skeleton, k: int = 16) -> DataFrame:
    """(left_word, right_word, frequency, rank): words of equal skeleton (2 to 12 characters), the k most frequent of each."""
    a = _with_skeleton(left, "left_word", skeleton).where(F.length("skeleton").between(2, 12))
    b = _with_skeleton(right, "right_word", skeleton, "frequency").where(F.length("skeleton").between(2, 12))
    order = Window.partitionBy("left_word").orderBy(F.desc("frequency"), "right_word")
    pairs = a.join(b, "skeleton").where("left_word <> right_word")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("left_word", "right_word", "frequency", "rank")


def fuzzy_skeleton_join(left: DataFrame, right: DataFrame, skeleton=T.english_skeleton, k: int = 16, seeds: int | None = None) -> DataFrame:
    """(left_word, right_word, distance, frequency, rank): words whose skeletons are within one edit, by that, frequency and word.

    Skeletons meet by the deletion index: their own and each less one character; distances are verified. seeds bounds the
    right words of a key that are looked at, in key order, for a caller that wants an answer in bounded time (None: all).
    """
    def keyed(df, word, *others):
        rows = _with_skeleton(df, word, skeleton, *others).withColumnRenamed("skeleton", "sk").where(F.length("sk") > 0)
        return rows.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("sk"), T.deletions(F.col("sk"))))))

    a = keyed(left.select("word").distinct(), "left_word").withColumnRenamed("sk", "sk1")
    b = keyed(right, "right_word", "frequency")
    if seeds is not None:
        b = b.withColumn("_s", F.row_number().over(Window.partitionBy("key").orderBy("sk", "right_word"))).where(F.col("_s") <= seeds).drop("_s")
    pairs = a.join(b, "key").where("left_word <> right_word").select("left_word", "right_word", "frequency", F.levenshtein("sk1", "sk", 1).alias("distance")).where("distance >= 0").distinct()
    order = Window.partitionBy("left_word").orderBy("distance", F.desc("frequency"), "right_word")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("left_word", "right_word", "distance", "frequency", "rank")


def loanword_table(entries: DataFrame) -> DataFrame:
    """(english, bangla, frequency): the largest frequency of equal pairs."""
    return entries.groupBy("english", "bangla").agg(F.max("frequency").alias("frequency"))


def loanword_targets(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.col("bangla").alias("word")).agg(F.max("frequency").alias("frequency"))
