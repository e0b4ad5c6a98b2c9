"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: the mix holds `share` times the words of all documents; sources in code-point order, null last, weigh
`weights` in rotation and divide that by weight; no target passes `cap` times its source's words, and what is above is
divided again among the others. That has a closed form: with caps and weights c and w the targets are min(c, w * level),
and the level follows from running sums over the sources in order of c / w.

Selection: a target of e whole times the source's words and a rest takes every document e times (complete epochs) and
then, for the rest, documents in the order of exponential keys -ln(u) / quality, u a hash of the document: weighted
sampling without replacement that gives the same at every run. Running sums of words cut that order at the budget. The
document on the cut gives its first words, as many as the budget lacks (boundary="cut"), or is taken whole where that
comes nearer to the budget (boundary="whole").

A source may hold a third of all rows: its keys are divided into BUCKETS ranges, words are summed by source and range
(combined before the shuffle), and only the range that holds the cut is sorted. Nothing else is ordered.

Defined results: null texts and texts without words have size 0 and are taken with 0 words; sources without words have
target 0; null doc_ids are documents like others; repeated rows count each, and share the key; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

BUCKETS = 4096
BROADCAST_SOURCES = 100_000  #: rows of seven numbers and a name
WEIGHTS = (5, 2, 1)


def letters_share(text: Column) -> Column:
    """Quality weight between 0.05 and 1: the share of letters and white space among the characters."""
    n = F.length(text)
    return F.greatest(F.lit(0.05), F.when(n > 0, 1 - F.length(F.regexp_replace(text, r"[\p{L}\s]+", "")) / n).otherwise(F.lit(0.05)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size). The window over sources sees one narrow row for each."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("i", F.row_number().over(by_ratio))
    s = s.withColumn("below", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("above", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share)
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("i", "level"))
    s = s.withColumn("level", F.min(fits).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("w") * F.col("level"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17, boundary: str = "cut", quality=letters_share, carry: Column | None = None) -> DataFrame:
    """Per document: doc_id, source, digest (md5 of the text), size, source_size, target, epochs, part, taken.

    epochs: complete copies; part: words of one more copy, from its beginning; taken: epochs * size + part.
    carry: a hash that orders rows of equal id and text; with it each row of docs comes along as `row`, a struct.
    """
    more = [] if carry is None else [carry.alias("same"), F.struct("*").alias("row")]
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text.cast("binary"))
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(str(seed)), digest).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = docs.select("doc_id", "source", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(u) / quality(text)).alias("key"), *more)
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    rows = written(rows, "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).checkpoint()
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).checkpoint()
    span = Window.partitionBy("source").orderBy("bucket")
    sums = buckets.withColumn("before", F.coalesce(F.sum("words").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumnRenamed("source", "s")
    cut = goals.join(sums, F.col("source").eqNullSafe(F.col("s"))).where("before < rest and rest <= before + words").select("s", F.col("bucket").alias("cut"), F.col("before").alias("cut_before"))
    goals = goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("s")))
    apart = joined.where(~F.col("bucket").eqNullSafe(F.col("cut"))).withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "digest", *(["same"] if more else [])).rowsBetween(Window.unboundedPreceding, -1)
    on = joined.where(F.col("bucket").eqNullSafe(F.col("cut"))).withColumn("room", F.col("rest") - F.col("cut_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    if boundary == "cut":
        part = F.greatest(F.lit(0), F.least("size", "room"))
    else:
        part = F.when(F.col("room") * 2 > F.col("size"), F.col("size")).otherwise(0)
    on = on.withColumn("part", part).drop("room")
    done = apart.unionByName(on)
    return done.select("doc_id", "source", "digest", "size", "source_size", "target", "epochs", F.col("part").cast("long").alias("part"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *(["row"] if more else []))
