"""Personal suggestions over a batch of commits: observed contexts, lookups, decay, eviction, merging.

The batch forms give what the stateful stream gives when no eviction happens; with a bounded store the order of
evictions decides, and `streaming.sessions` is exact where `evicted` keeps the strongest entries of the whole batch.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CONTEXT, MAX_ENTRIES, MIN_COUNT = 3, 4096, 2
#: Bytes of text in a partition of users. Each word becomes four observations, some forty times its bytes in an aggregate.
TASK_BYTES = 1 << 20


def committed(turns: DataFrame, tokens=T.latin_tokens, task_bytes: int = TASK_BYTES) -> DataFrame:
    """turns (user_id, turn, text) to (user_id, tick, token_id): the words of each user's turns, ticks from 1. Equal turns are read word by word in turn.

    Texts, not words, go through the one shuffle. Its partitions follow the amount of text and are set, as coalescing by shuffled
    bytes doesn't see what the words become; all that is grouped by user stays within them.
    """
    size = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, ceil(size / task_bytes))
    rows = turns.select("user_id", "turn", "text").repartition(parts, "user_id").select("user_id", "turn", tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    merged = rows.groupBy("user_id", "turn").agg(F.collect_list("ts").alias("w"))
    at = lambda i: F.transform(F.filter("w", lambda t: F.size(t) > i), lambda t: F.get(t, i))
    longest = F.array_max(F.transform("w", lambda t: F.size(t)))
    one = merged.select("user_id", "turn", F.when(F.size("w") == 1, F.get("w", F.lit(0))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), at))).alias("ts"))
    before = F.coalesce(F.sum(F.size("ts")).over(Window.partitionBy("user_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.withColumn("_b", before).select("user_id", "_b", F.posexplode("ts").alias("i", "token_id")).select("user_id", (F.col("_b") + F.col("i") + 1).cast("int").alias("tick"), "token_id")


def observations(commits: DataFrame) -> DataFrame:
    """(user_id, tick, context_len, context, token_id): each commit under its 0 to 3 tokens before it; context is joined by spaces.

    Where commits have a column `starts`, true at a sentence's first token, no context reaches back beyond that, and the first token
    stands under the context "\\n" too, as in a session."""
    keys_of_sentence, named = ["user_id"], "starts" in commits.columns
    if named:
        commits = commits.withColumn("_s", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("user_id").orderBy("tick")))
        keys_of_sentence = ["user_id", "_s"]
    own = Window.partitionBy(*keys_of_sentence).orderBy("tick")
    back = [F.lag("token_id", k).over(own) for k in range(1, MAX_CONTEXT + 1)]
    rows = commits.select("user_id", "tick", "token_id", *[b.alias(f"b{k + 1}") for k, b in enumerate(back)])
    keys = [F.struct(F.lit(0).alias("context_len"), F.lit("").alias("context"))]
    if named:
        keys.append(F.when(F.col("b1").isNull(), F.struct(F.lit(0).alias("context_len"), F.lit("\n").alias("context"))))
    for k in range(1, MAX_CONTEXT + 1):
        keys.append(F.when(F.col(f"b{k}").isNotNull(), F.struct(F.lit(k).alias("context_len"), F.concat_ws(" ", *[F.col(f"b{i}").cast("string") for i in range(k, 0, -1)]).alias("context"))))
    return rows.select("user_id", "tick", F.explode(F.array_compact(F.array(*keys))).alias("x"), "token_id").select("user_id", "tick", "x.*", "token_id")


def entries(commits: DataFrame) -> DataFrame:
    """(user_id, context_len, context, token_id, count, last_seen): combined before the shuffle."""
    return observations(commits).groupBy("user_id", "context_len", "context", "token_id").agg(F.count("*").alias("count"), F.max("tick").alias("last_seen"))


def lookup(store: DataFrame, k: int = 3, min_count: int = MIN_COUNT) -> DataFrame:
    """Per user and context the k strongest tokens: by count, last seen, then smaller token; rank from 1."""
    order = Window.partitionBy("user_id", "context_len", "context").orderBy(F.desc("count"), F.desc("last_seen"), "token_id")
    return store.where(F.col("count") >= min_count).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def decay(store: DataFrame) -> DataFrame:
    """Counts halved, those that reach 0 dropped."""
    return store.withColumn("count", F.floor(F.col("count") / 2).cast("long")).where("count > 0")


def evicted(store: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """The strongest `limit` entries of each user: by count, last seen, longer context, token."""
    order = Window.partitionBy("user_id").orderBy(F.desc("count"), F.desc("last_seen"), F.desc("context_len"), "context", "token_id")
    return store.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def current_contexts(commits: DataFrame) -> DataFrame:
    """(user_id, context_len, context) for each length of what each user has typed last."""
    last = Window.partitionBy("user_id").orderBy(F.desc("tick"))
    tail = commits.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= MAX_CONTEXT)
    rows = tail.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tick", F.col("token_id").cast("string").alias("t")))), lambda x: x["t"]).alias("ts"))
    return rows.select("user_id", F.explode(F.sequence(F.lit(0), F.size("ts"))).alias("context_len"), "ts").select("user_id", "context_len", F.array_join(F.when(F.col("context_len") > 0, F.slice("ts", F.size("ts") - F.col("context_len") + 1, F.col("context_len"))).otherwise(F.array().cast("array<string>")), " ").alias("context"))


def merged(contexts: DataFrame, store: DataFrame, model: DataFrame, limit: int = 5) -> DataFrame:
    """(user_id, rank, token_id): contextual personal rows by longer context first, then the model's (token_id, rank), then personal rows of no context."""
    mine = contexts.join(lookup(store, limit), ["user_id", "context_len", "context"]).select("user_id", "token_id", F.when(F.col("context_len") > 0, 0).otherwise(2).alias("tier"), (-F.col("context_len")).alias("a"), F.col("rank").alias("b"))
    users = contexts.select("user_id").distinct()
    list_ = model.agg(F.array_sort(F.collect_list(F.struct("rank", "token_id"))).alias("m"))  # one row of the model's few best
    theirs = users.crossJoin(F.broadcast(list_)).select("user_id", F.explode("m").alias("m")).select("user_id", "m.token_id", F.lit(1).alias("tier"), F.lit(0).alias("a"), F.col("m.rank").alias("b"))
    every = mine.unionByName(theirs)
    first = Window.partitionBy("user_id", "token_id").orderBy("tier", "a", "b")
    order = Window.partitionBy("user_id").orderBy("tier", "a", "b", "token_id")
    kept = every.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("user_id", "rank", "token_id")
