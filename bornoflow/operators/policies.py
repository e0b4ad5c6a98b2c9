"""Merging static candidates with a model's: rerank, merge with a locked prefix, scored union, unified ranking, policy grids.

static: (query, token_id, static_rank from 0, count, source_order 0..4, model_score); generated: (query, token_id,
model_rank from 0, model_score). Scores that aren't finite count as minus infinity.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import finite

LOCKED_BONUS = 1e6


@dataclass(frozen=True)
class UnionPolicy:
    static_bonus: float = 0.0
    static_rank_penalty: float = 0.1
    static_log_count_scale: float = 0.0
    static_source_bonus: float = 0.0
    locked_static_prefix: int = 1
    generated_penalty: float = 0.0
    generated_rank_penalty: float = 0.05
    overlap_bonus: float = 0.0


def rerank(static: DataFrame, rank_penalty: float = 0.05, locked: int = 1, limit: int = 10) -> DataFrame:
    """The first `locked` candidates stay; the rest go by model score less a penalty per rank, ties by old rank; rank from 1."""
    locked = min(locked, limit)
    score = finite(F.col("model_score")) - max(0.0, rank_penalty) * F.col("static_rank")
    tail = F.when(F.col("static_rank") < locked, float("inf")).otherwise(score)
    order = Window.partitionBy("query").orderBy(F.desc(tail), "static_rank", "token_id")
    return static.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def merge_locked(static: DataFrame, generated: DataFrame, locked: int = 1, limit: int = 10) -> DataFrame:
    """(query, rank, token_id): locked static candidates, generated ones, then the other static ones; a token's first place counts."""
    a = static.select("query", "token_id", F.when(F.col("static_rank") < locked, 0).otherwise(2).alias("tier"), F.col("static_rank").alias("r"))
    b = generated.select("query", "token_id", F.lit(1).alias("tier"), F.col("model_rank").alias("r"))
    first = a.unionByName(b).groupBy("query", "token_id").agg(F.min(F.struct("tier", "r")).alias("at"))
    order = Window.partitionBy("query").orderBy("at", "token_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "token_id")


def _static_score(p: UnionPolicy | dict) -> Column:
    g = (lambda k: F.lit(getattr(p, k))) if isinstance(p, UnionPolicy) else (lambda k: F.col(p[k]))
    lock = F.when(F.col("static_rank") < g("locked_static_prefix"), LOCKED_BONUS).otherwise(0.0)
    return g("static_bonus") - g("static_rank_penalty") * F.col("static_rank") + g("static_log_count_scale") * F.log1p(F.col("count")) + g("static_source_bonus") * F.col("source_order") + lock


def scored_union(static: DataFrame, generated: DataFrame, policy: UnionPolicy = UnionPolicy(), limit: int = 10) -> DataFrame:
    """(query, rank, token_id, static_rank, model_rank, union_score): all candidates, a token's best score counts."""
    s = static.select("query", "token_id", "static_rank", (finite(F.col("model_score")) + _static_score(policy)).alias("s"))
    g = generated.select("query", "token_id", "model_rank", (finite(F.col("model_score")) - policy.generated_penalty - policy.generated_rank_penalty * F.col("model_rank")).alias("g"))
    both = s.join(g, ["query", "token_id"], "full_outer")
    score = F.greatest("s", "g") + F.when(F.col("s").isNotNull() & F.col("g").isNotNull(), policy.overlap_bonus).otherwise(0.0)
    order = Window.partitionBy("query").orderBy(F.desc("union_score"), F.col("static_rank").asc_nulls_last(), F.col("model_rank").asc_nulls_last(), "token_id")
    return both.withColumn("union_score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "token_id", "static_rank", "model_rank", "union_score")


def unified(static: DataFrame, generated: DataFrame, texts: DataFrame, policy: UnionPolicy = UnionPolicy(), text_penalty: float = 0.2, text_rank_penalty: float = 0.05, overlap: float = 0.25, limit: int = 10) -> DataFrame:
    """(query, rank, text, final_score): static (query, text, static_rank, count, source_order), generated tokens (query, text,
    model_rank, model_score) and generated texts (query, text, text_rank, text_score) as one list by text; the best signal
    counts, plus a bonus per further signal. Of a text generated twice the best rank and the best score count apart."""
    t = texts.groupBy("query", "text").agg(F.min("text_rank").alias("text_rank"), F.max(finite(F.col("text_score"))).alias("text_score"))
    s = static.select("query", "text", "static_rank", _static_score(policy).alias("s"))
    g = generated.select("query", "text", "model_rank", (finite(F.col("model_score")) - policy.generated_penalty - policy.generated_rank_penalty * F.col("model_rank")).alias("g"))
    both = s.join(g, ["query", "text"], "full_outer").join(t.withColumn("t", F.col("text_score") - text_penalty - text_rank_penalty * F.col("text_rank")), ["query", "text"], "full_outer")
    signals = sum((F.col(c).isNotNull().cast("int") for c in ("s", "g", "t")), F.lit(0))
    order = Window.partitionBy("query").orderBy(F.desc("final_score"), F.col("static_rank").asc_nulls_last(), F.col("model_rank").asc_nulls_last(), F.col("text_rank").asc_nulls_last(), "text")
    out = both.withColumn("final_score", F.greatest("s", "g", "t") + overlap * (signals - 1))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "text", "final_score")


def grid(static: DataFrame, labels: DataFrame, policies: list[UnionPolicy], cutoffs: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Per policy (numbered from 0) hits and reciprocal rank of labels (query, label) among the static candidates it orders.

    The grid is a literal of bounded size: each candidate row is exploded into one row per policy, no join.
    """
    fields = list(asdict(policies[0]))
    literal = F.array(*[F.struct(F.lit(i).alias("policy"), *[F.lit(float(v)).alias(f"_{k}") for k, v in asdict(p).items()]) for i, p in enumerate(policies)])
    rows = static.withColumn("_p", F.explode(literal)).select("*", "_p.*").drop("_p")
    score = finite(F.col("model_score")) + _static_score({k: f"_{k}" for k in fields})
    order = Window.partitionBy("policy", "query").orderBy(F.desc(score), "static_rank", "token_id")
    hit = rows.withColumn("rank", F.row_number().over(order)).join(labels, "query").where(F.col("token_id") == F.col("label")).select("policy", "rank")
    sums = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"hits{k}") for k in cutoffs]
    return hit.groupBy("policy").agg(F.count("*").alias("found"), *sums, F.round(F.sum(1.0 / F.col("rank")), 6).alias("reciprocal_ranks"))


def best(results: DataFrame) -> DataFrame:
    """The policy with the most hits at 5, then the largest reciprocal ranks, then hits at 1, then the smallest number."""
    return results.orderBy(F.desc("hits5"), F.desc("reciprocal_ranks"), F.desc("hits1"), "policy").limit(1)


def held_out_choice(static: DataFrame, labels: DataFrame, policies: list[UnionPolicy], held: Column) -> DataFrame:
    """One row: the policy that is best where `held` (over labels' columns) is false, and how it does where it is true."""
    chosen = best(grid(static, labels.where(~held), policies)).select("policy")
    tested = grid(static, labels.where(held), policies)
    return tested.join(F.broadcast(chosen), "policy")  # a single row


def grid_by(static: DataFrame, labels: DataFrame, policies: list[UnionPolicy], group: str, cutoffs: tuple[int, ...] = (1, 5)) -> DataFrame:
    """grid() per value of a column of labels, such as their source."""
    tagged = static.join(labels.select("query", F.col(group).alias("_group")), "query").withColumn("query", F.struct("_group", "query"))
    own = labels.select(F.struct(F.col(group).alias("_group"), "query").alias("query"), "label", group)
    fields = list(asdict(policies[0]))
    literal = F.array(*[F.struct(F.lit(i).alias("policy"), *[F.lit(float(v)).alias(f"_{k}") for k, v in asdict(p).items()]) for i, p in enumerate(policies)])
    rows = tagged.withColumn("_p", F.explode(literal)).select("*", "_p.*").drop("_p")
    order = Window.partitionBy("policy", "query").orderBy(F.desc(finite(F.col("model_score")) + _static_score({k: f"_{k}" for k in fields})), "static_rank", "token_id")
    hit = rows.withColumn("rank", F.row_number().over(order)).join(own, "query").where(F.col("token_id") == F.col("label"))
    sums = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"hits{k}") for k in cutoffs]
    return hit.groupBy(group, "policy").agg(F.count("*").alias("found"), *sums, F.round(F.sum(1.0 / F.col("rank")), 6).alias("reciprocal_ranks"))


def pool_scores(contexts: DataFrame, pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query, token_id, score): of contexts (query, hidden) and pools (query, token_id) by tokens (token_id, embedding, bias): dot product and bias."""
    rows = pools.join(tokens, "token_id").join(contexts, "query")
    dot = F.aggregate(F.zip_with("hidden", "embedding", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.select("query", "token_id", (dot + F.col("bias")).alias("score"))


def pool_recall(static: DataFrame, generated: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labels, and how many the static pool, the generated pool and their union hold."""
    a = static.select("query", F.col("token_id").alias("label"), F.lit(1).alias("a")).distinct()
    b = generated.select("query", F.col("token_id").alias("label"), F.lit(1).alias("b")).distinct()
    j = labels.join(a, ["query", "label"], "left").join(b, ["query", "label"], "left")
    return j.agg(F.count("*").alias("labels"), F.count("a").alias("static_hits"), F.count("b").alias("generated_hits"), F.count(F.coalesce("a", "b")).alias("union_hits"))


def normalised(features: DataFrame, columns: list[str], query: str = "query") -> DataFrame:
    """Features less their query's mean, over its standard deviation, which counts as 1 at least where it is 0."""
    w = Window.partitionBy(query)
    out = features
    for c in columns:
        sd = F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))
        out = out.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(w)) / F.greatest(sd, F.lit(1.0)))
    return out
