"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines (cut at line feeds) are compared as sequences of words, lower-cased, white space dropped. A line goes if an
earlier one, in the order of (doc_id, line number), is equal or, for lines of MIN_WORDS words or more, within one
inserted, deleted or replaced word, whatever their length: a similarity of 0.8 for 5 words, but of 0.98 for 50, so long
lines that differ in two words or more both stay. Lines are judged on the input, not on what is left;
lines without words stay.

Plan:
1. Every line becomes a hash; a combining aggregation finds the first place of each distinct line. Copies end here.
2. Two lines within one edit agree in the first or the second half of the shorter one's length. Each distinct line is
   keyed by its halves (for its own length and for one word less); lines that share no half with another distinct line
   have no neighbour, exactly, and leave.
3. The others emit their deletion neighbourhood: the hash of the line and of the line less each one of its words. Such
   hashes combine those of (word, place) by exclusive or, so running ones from both ends give all in linear time.
   Variants of one line alone leave. Lines
   that share a variant with the same word left out differ in that word at most, so the first of them stands for all
   in one combining aggregation and no pairs within a group arise. A line equal to another less one word is found by
   joining the lines' own hashes, which are distinct, to the variants.
4. What was found is verified on the words themselves, a pair for each line and variant at most.

Hashes of equal lines have 96 bits (two functions).

Defined results: a null text has no lines and stays null; an empty text keeps its empty line; rows of equal doc_id
stand in the order of a hash of their texts, and rows that are equal in both are one document and keep the same lines;
a null doc_id comes after all others; extra columns pass unchanged in `dedup`, whatever their names, but for those of
the two counts that it adds; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_WORDS = 5
BROADCAST_ROWS = 1_000_000


def line_words(line: Column) -> Column:
    """The words of a line whose white space _plain() has made spaces."""
    return F.array_remove(F.split(line, " "), "")


def _plain(text: Column) -> Column:
    """Of the separators of words none but spaces and line feeds: replacements and plain splits cost less than a pattern or translate()."""
    for c in "\t\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _hash(words: Column) -> Column:
    return F.xxhash64(words)  # of an array: each word's hash is the seed of the next one's


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, order, text): order makes rows of equal doc_id differ in place."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"), "text").where("text is not null")


def first_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, n): the places of all lines that stay, d and t naming the text, n the line's number from 0; t is the text's hash."""
    lines = _texts(docs).select("d", "t", F.posexplode(F.split(_plain(F.lower("text")), "\n")).alias("n", "line"))
    w = lines.where(F.trim("line") != "").select("d", "t", "n", line_words(F.col("line")).alias("w"))
    size = F.size("w")
    keys = []
    for m in (size, size - 1):
        half = F.shiftright(m, 1)
        keys += [F.xxhash64(m, F.lit(0), _hash(F.slice("w", F.lit(1), half))), F.xxhash64(m, F.lit(1), _hash(F.slice("w", size - m + half + 1, m - half)))]
    halves = F.when(size >= min_words, F.array(*keys))
    h = w.select(F.struct("d", "t", "n").alias("at"), _hash(F.col("w")).alias("h"), F.hash("w").alias("h2"), halves.alias("halves"))
    distinct = written(h.groupBy("h", "h2").agg(F.min("at").alias("at"), F.min("halves").alias("halves")), "lines")
    # the halves of a line are functions of its words, so the smallest is any
    keyed = distinct.where("halves is not null").select("h", F.explode(F.array_distinct("halves")).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")  # a line has each of its keys once
    left = written(distinct.join(keyed.join(shared, "key", "left_semi").select("h").distinct(), "h", "left_semi").select(F.col("at.d").alias("d"), F.col("at.t").alias("t"), F.col("at.n").alias("n"), "h"), "candidates")
    small = left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = lines.join(F.broadcast(left) if small else left, ["d", "t", "n"]).select(F.struct("d", "t", "n").alias("at"), "h", line_words(F.col("line")).alias("w"))
    near = written(texts.dropDuplicates(["h"]), "near")
    gone = _near(near)
    stay = distinct.join(gone, "h", "left_anti")
    return stay.select(F.col("at.d").alias("d"), F.col("at.t").alias("t"), F.col("at.n").alias("n"))


def _near(lines: DataFrame) -> DataFrame:
    """(h) of those distinct lines (at, h, w) that an earlier one is one word's edit away from."""
    words = lines.select("h", F.posexplode("w").alias("i", "word"))
    line = Window.partitionBy("h")
    before = F.coalesce(F.bit_xor(F.xxhash64("word", "i")).over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.bit_xor(F.xxhash64("word", F.col("i") - 1)).over(line.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    variants = words.select("h", "i", before.bitwiseXOR(after).alias("v"))
    whole = F.aggregate(F.transform("w", lambda x, i: F.xxhash64(x, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    every = variants.unionByName(lines.select("h", F.lit(-1).alias("i"), whole.alias("v")))
    # a line has equal variants only where it repeats a word: counted once
    met = every.groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("v")
    shared = written(every.join(met, "v", "left_semi").join(lines.select("h", "at"), "h"), "variants")
    own = shared.where("i = -1").select(F.col("at").alias("at2"), F.col("h").alias("h2"), "v")
    variants = shared.where("i >= 0")
    # replaced words: the same word left out gives the same variant
    first = variants.groupBy("v", "i").agg(F.min("at").alias("at2"), F.min_by("h", "at").alias("h2"), F.count("*").alias("c")).where("c > 1").drop("c")
    replaced = variants.join(first, ["v", "i"]).where(F.col("at2") < F.col("at")).select("h", "h2", F.lit(-1).alias("i"))
    # inserted or deleted words: `own` is the shorter line
    pairs = variants.join(own, "v").where("h <> h2")
    longer = pairs.where(F.col("at2") < F.col("at")).groupBy("h").agg(F.min(F.struct("at2", "h2", "i")).alias("p")).select("h", "p.h2", "p.i")
    shorter = pairs.where(F.col("at") < F.col("at2")).groupBy("h2").agg(F.min(F.struct("at", "h", "i")).alias("p")).select(F.col("h2").alias("h"), F.col("p.h").alias("h2"), (-2 - F.col("p.i")).alias("i"))
    found = replaced.unionByName(longer).unionByName(shorter).distinct()
    words = lines.select("h", "w")
    both = found.join(words, "h").join(words.select(F.col("h").alias("h2"), F.col("w").alias("w2")), "h2")
    less = lambda w, i: F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.size(w)))
    one = (F.size("w") == F.size("w2")) & (F.size(F.filter(F.zip_with("w", "w2", lambda a, b: a != b), lambda x: x)) <= 1)
    ok = F.when(F.col("i") == -1, one).when(F.col("i") >= 0, less(F.col("w"), F.greatest("i", F.lit(0))) == F.col("w2")).otherwise(less(F.col("w2"), F.greatest(-2 - F.col("i"), F.lit(0))) == F.col("w"))
    return both.where(ok).select("h").distinct()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple = ("n_lines", "n_removed")) -> DataFrame:
    """docs with `text` cut to the lines that stay, and two longs added, named by counts; columns of docs that have these names are replaced, all others pass."""
    stay = first_lines(docs, min_words).groupBy("d", "t").agg(F.array_sort(F.collect_set("n")).alias("kept"))
    tagged = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"), "text", *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"))
    joined = tagged.join(stay, ["d", "t"], "left").withColumn("lines", F.split("text", "\n"))
    gap = lambda x, k: x - F.when(k == 0, -1).otherwise(F.get("kept", k - 1)) - 1
    joined = joined.withColumn("mask", F.flatten(F.transform("kept", lambda x, k: F.concat(F.array_repeat(F.lit(False), gap(x, k)), F.array(F.lit(True))))))
    wordless = lambda x: F.trim(_plain(x)) == ""
    kept = F.filter("lines", lambda x, i: F.coalesce(F.get("mask", i), F.lit(False)) | wordless(x))
    done = joined.withColumn("new", kept)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("new")).cast("long")
    passed = [F.array_join("new", "\n").alias("text") if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in counts]
    return done.select(*passed, n.alias(counts[0]), removed.alias(counts[1]))
