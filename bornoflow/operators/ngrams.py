"""N-gram counts of orders 1 to 4, their statistics, discounts, scores and top candidates.

Tables are long: one row per (context, token). A table of order n has columns c1 .. c(n-1) (oldest first), token_id, count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import log_probability

MODES = ("count", "smoothed-log", "stupid-backoff", "kneser-ney", "modified-kneser-ney")


def context_columns(order: int) -> list[str]:
    return [f"c{i}" for i in range(1, order)]


def occurrences(encoded: DataFrame, weight: Column | None = None) -> DataFrame:
    """(c1, c2, c3, token_id, weight) for each target; contexts before the sentence's BOS are null. One narrow pass."""
    at = lambda i, back: F.get("ids", i - back)
    grams = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(F.when(i >= 3, at(i, 3)).alias("c1"), F.when(i >= 2, at(i, 2)).alias("c2"), at(i, 1).alias("c3"), at(i, 0).alias("token_id")))
    rows = encoded.where(F.size("ids") > 1).select((F.lit(1) if weight is None else weight).cast("long").alias("weight"), F.explode(grams).alias("g"))
    return rows.select("g.*", "weight").where("token_id > 2")


def counts(encoded: DataFrame, order: int, weight: Column | None = None) -> DataFrame:
    """Counts of one order: targets are words, contexts neither pad nor unknown (BOS is a context)."""
    rows = occurrences(encoded, weight)
    used = ["c1", "c2", "c3"][4 - order :]
    for c in used:
        rows = rows.where(F.col(c).isNotNull() & ~F.col(c).isin(0, 2))
    named = rows.select(*[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(used)], "token_id", "weight")
    return named.groupBy(*context_columns(order), "token_id").agg(F.sum("weight").alias("count"))


def context_stats(table: DataFrame, order: int) -> DataFrame:
    """Per context: total, distinct, singletons, doubletons, high (three or more)."""
    n = F.col("count")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table.groupBy(*context_columns(order)).agg(F.sum(n).alias("total"), F.count("*").alias("distinct_tokens"), one(n == 1).alias("singletons"), one(n == 2).alias("doubletons"), one(n >= 3).alias("high"))


def histogram(table: DataFrame) -> DataFrame:
    """(bucket, n): how many rows have count 1, 2, 3, and 4 or more."""
    return table.groupBy(F.least("count", F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def discounts(table: DataFrame, fallback: float = 0.75) -> DataFrame:
    """One row (d1, d2, d3): modified Kneser-Ney discounts, each within (0, 1), (0, 2), (0, 3), else the fallback."""
    fixed = max(0.0, min(1.0, fallback))
    n = [F.coalesce(F.sum(F.when(F.least("count", F.lit(4)) == k, 1)), F.lit(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0)
    raw = (
        F.when(usable, 1 - 2 * y * F.col("n2") / F.col("n1")),
        F.when(usable & (F.col("n3") > 0), 2 - 3 * y * F.col("n3") / F.col("n2")),
        F.when(usable & (F.col("n3") > 0) & (F.col("n4") > 0), 3 - 4 * y * F.col("n4") / F.col("n3")),
    )
    kept = [F.coalesce(F.when((d > 0) & (d < k), d), F.lit(fixed)).alias(f"d{k}") for k, d in enumerate(raw, 1)]
    return table.agg(*n).select(*kept)


def continuation_counts(bigrams: DataFrame) -> DataFrame:
    """(token_id, continuations): distinct predecessors of each token."""
    return bigrams.groupBy("token_id").agg(F.count("*").alias("continuations"))


def with_probability(tables: dict[int, DataFrame], order: int, mode: str, discount: float = 0.75) -> DataFrame:
    """The table of `order` with p: (modified) Kneser-Ney, interpolated with the next lower order down to continuations.

    Each order is one join with its lower order on (context less its oldest token, token_id), plus context sums in a window.
    """
    if order == 1:
        uni, cont = tables[1], continuation_counts(tables[2])
        totals = uni.agg(F.sum("count").alias("u"))
        every = cont.agg(F.sum("continuations").alias("c"))
        joined = uni.join(cont, "token_id", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(every))  # single rows
        return joined.select("token_id", "count", F.when(F.col("continuations") > 0, F.col("continuations") / F.col("c")).otherwise(F.col("count") / F.col("u")).alias("p"))
    lower = with_probability(tables, order - 1, mode, discount)
    context = context_columns(order)
    shorter = [F.col(c).alias(f"l{i}") for i, c in enumerate(context_columns(order - 1))]
    low = lower.select(*shorter, F.col("token_id").alias("lt"), F.col("p").alias("lp"))
    table, n = tables[order], F.col("count")
    w = Window.partitionBy(*context)
    part = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    if mode == "kneser-ney":
        rows = table.withColumn("total", F.sum("count").over(w)).withColumn("mass", discount * F.count("*").over(w)).withColumn("off", F.lit(discount))
    else:
        d = F.broadcast(discounts(table, discount))  # a single row
        rows = table.withColumn("total", F.sum("count").over(w)).withColumn("s", part(n == 1)).withColumn("b", part(n == 2)).withColumn("h", part(n >= 3)).crossJoin(d)
        rows = rows.withColumn("mass", F.col("d1") * F.col("s") + F.col("d2") * F.col("b") + F.col("d3") * F.col("h")).withColumn("off", F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")))
    on = [F.col(c) == F.col(f"l{i}") for i, c in enumerate(context[1:])] + [F.col("token_id") == F.col("lt")]
    joined = rows.join(low, reduce(lambda a, b: a & b, on), "left")
    p = F.greatest(n - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * F.coalesce("lp", F.lit(0.0))
    return joined.select(*context, "token_id", "count", p.alias("p"))


def scored(tables: dict[int, DataFrame], order: int, mode: str = "modified-kneser-ney", smoothing: float = 0.5, alpha: float = 0.4, discount: float = 0.75, highest: int = 4) -> DataFrame:
    """The table of `order` with score (long)."""
    table, context = tables[order], context_columns(order)
    if mode == "count":
        return table.withColumn("score", F.least("count", F.lit(2_147_483_647)).cast("long"))
    if mode in ("kneser-ney", "modified-kneser-ney"):
        return with_probability(tables, order, mode, discount).withColumn("score", log_probability(F.col("p"))).drop("p")
    total = F.broadcast(tables[1].agg(F.sum("count").alias("all_words")))  # a single row
    rows = table.crossJoin(total)
    if order > 1:
        rows = rows.withColumn("total", F.sum("count").over(Window.partitionBy(*context)))
    if mode == "stupid-backoff":
        p = (F.col("count") / (F.col("total") if order > 1 else F.col("all_words"))) * alpha ** max(0, highest - order)
        return rows.withColumn("score", log_probability(p)).select(*context, "token_id", "count", "score")
    if order == 1:
        p = F.col("count") / F.col("all_words")
    else:
        uni = tables[1].select("token_id", F.col("count").alias("u"))
        rows = rows.join(uni, "token_id")
        p = (F.col("count") + smoothing * (F.col("u") / F.col("all_words"))) / (F.col("total") + smoothing) if smoothing > 0 else F.col("count") / F.col("total")
    return rows.withColumn("score", log_probability(p)).select(*context, "token_id", "count", "score")


def top_candidates(table: DataFrame, order: int, k: int = 16, min_count: int = 1) -> DataFrame:
    """Per context the k best by score, count, then smaller id, after pruning by count; rank from 1. Order 1 ranks globally."""
    keys = [F.desc("score"), F.desc("count"), F.col("token_id")]
    rows = table.where(F.col("count") >= min_count)
    if order == 1:
        rows = rows.orderBy(*keys).limit(k)
    window = Window.partitionBy(*context_columns(order)).orderBy(*keys) if order > 1 else Window.orderBy(*keys)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
