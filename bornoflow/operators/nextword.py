"""Next-word queries over ranked n-gram tables, and their evaluation.

A context is (c1, c2, c3), oldest first, null where absent: the words since the last unknown one, at most three; at a
sentence's start it is BOS alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import context_columns

ORDER_NAMES = {4: "fourgram", 3: "trigram", 2: "bigram", 1: "unigram"}


def positions(encoded: DataFrame) -> DataFrame:
    """(source, document_id, sentence_id, idx, c1, c2, c3, target): one row per target, known or not."""
    back = lambda i, k: F.when(i - k >= 1, F.get("ids", i - k))  # noqa: E731  (BOS, at 0, counts only as a start)
    word = lambda x: F.when(x > 2, x)
    at = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(i.alias("idx"), F.when(i == 1, F.lit(1)).otherwise(word(back(i, 1))).alias("c3"), word(back(i, 2)).alias("b"), word(back(i, 3)).alias("a"), F.get("ids", i).alias("target")))
    rows = encoded.where(F.size("ids") > 1).select("source", "document_id", "sentence_id", F.explode(at).alias("x")).select("source", "document_id", "sentence_id", "x.*")
    c2 = F.when(F.col("c3").isNotNull(), F.col("b"))
    return rows.select("source", "document_id", "sentence_id", "idx", F.when(c2.isNotNull(), F.col("a")).alias("c1"), c2.alias("c2"), "c3", "target")


def model_input(encoded: DataFrame, width: int = 8) -> DataFrame:
    """Per target the ids before it, left-padded with 0 to a fixed width."""
    taken = lambda i: F.slice("ids", F.greatest(F.lit(1), i - width + 1), F.least(i, F.lit(width)))
    at = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(i.alias("idx"), F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - i)), taken(i)).alias("input"), F.get("ids", i).alias("target")))
    return encoded.where(F.size("ids") > 1).select("source", "document_id", "sentence_id", F.explode(at).alias("x")).select("source", "document_id", "sentence_id", "x.*")


def rows_by_context(ranked: DataFrame, order: int) -> DataFrame:
    """(context columns, row): each context's candidates in rank order; their number is bounded by the ranking's k."""
    item = F.struct("rank", "token_id", "score", "count")
    return ranked.groupBy(*context_columns(order)).agg(F.array_sort(F.collect_list(item)).alias("row"))


def _lookup(contexts: DataFrame, ranked: dict[int, DataFrame]) -> DataFrame:
    out = contexts
    for order in (4, 3, 2):
        keys = ["c1", "c2", "c3"][4 - order :]
        if order in ranked:
            rows = rows_by_context(ranked[order], order)
            rows = rows.select(*[F.col(c).alias(k) for c, k in zip(context_columns(order), keys)], F.col("row").alias(f"r{order}"))
            out = out.join(rows, keys, "left")
        else:
            out = out.withColumn(f"r{order}", F.lit(None).cast("array<struct<rank:int,token_id:int,score:bigint,count:bigint>>"))
    uni = ranked[1].agg(F.array_sort(F.collect_list(F.struct("rank", "token_id", "score", "count"))).alias("r1"))  # one row of at most k
    return out.crossJoin(F.broadcast(uni))


def context_length() -> Column:
    return F.when(F.col("c1").isNotNull(), 3).when(F.col("c2").isNotNull(), 2).when(F.col("c3").isNotNull(), 1).otherwise(0)


def reserved_caps(limit: int) -> dict[int, list[int]]:
    """Cumulative caps per order, by the number of words of context, that keep room for lower orders."""
    r3 = (max(8, limit // 4), max(4, limit // 8), max(2, limit // 16))
    r2 = (max(8, limit // 4), max(2, limit // 16))
    r1 = (max(2, limit // 8),)
    cap = lambda *left: max(1, limit - sum(left))
    return {4: [cap(*r3)] * 4, 3: [cap(*r2)] * 3 + [cap(*r3[1:])], 2: [cap(*r1)] * 2 + [cap(*r2[1:]), cap(*r3[2:])], 1: [limit] * 4}


def _caps(limit: int, policy: str) -> dict[int, Column]:
    """Cumulative caps per order; 'reserved' keeps room for lower orders."""
    if policy != "reserved":
        return {o: F.lit(limit) for o in (4, 3, 2, 1)}
    return {o: F.get(F.array(*map(F.lit, caps)), context_length()) for o, caps in reserved_caps(limit).items()}


def suggest(contexts: DataFrame, ranked: dict[int, DataFrame], limit: int = 10, policy: str = "backoff") -> DataFrame:
    """contexts (c1, c2, c3, ...) with ids: the suggested token ids, best first.

    policy: 'backoff' (higher orders first, lower fill up), 'reserved' (the same under caps), 'merge' (all orders by score,
    order, count, smaller id). Each order is one equi-join; what is combined per context is bounded by the ranking's k.
    """
    rows = _lookup(contexts, ranked)
    if policy == "merge":
        none = F.array().cast("array<struct<score:bigint,priority:int,count:bigint,neg:int>>")
        item = lambda o: F.coalesce(F.transform(f"r{o}", lambda x: F.struct(x["score"].alias("score"), F.lit(o).alias("priority"), x["count"].alias("count"), (-x["token_id"]).alias("neg"))), none)
        every = F.reverse(F.array_sort(F.concat(*[item(o) for o in (4, 3, 2, 1)])))
        ids = F.array_distinct(F.transform(every, lambda x: -x["neg"]))  # a token's first place is its best
        return rows.withColumn("ids", F.slice(ids, 1, limit)).drop("r4", "r3", "r2", "r1")
    out, caps = F.array().cast("array<int>"), _caps(limit, policy)
    rows = rows.withColumn("ids", out)
    for order in (4, 3, 2, 1):
        own = F.coalesce(F.transform(f"r{order}", lambda x: x["token_id"]), F.array().cast("array<int>"))
        room = F.greatest(F.lit(0), caps[order] - F.size("ids"))
        rows = rows.withColumn("ids", F.concat("ids", F.slice(F.array_except(own, F.col("ids")), F.lit(1), room)))
    return rows.drop("r4", "r3", "r2", "r1")


def ranks(targets: DataFrame, ranked: dict[int, DataFrame], limit: int = 10, policy: str = "backoff") -> DataFrame:
    """positions() rows with rank: the target's place among the suggestions, null if absent or unknown.

    Suggestions are made once per distinct context and joined back, null-safely.
    """
    distinct = targets.select("c1", "c2", "c3").distinct()
    found = suggest(distinct, ranked, limit, policy).select(*[F.col(c).alias(f"k{c}") for c in ("c1", "c2", "c3")], "ids")
    on = [F.col(c).eqNullSafe(F.col(f"k{c}")) for c in ("c1", "c2", "c3")]
    place = F.array_position("ids", F.col("target"))
    return targets.join(found, on).withColumn("rank", F.when((F.col("target") > 2) & (place > 0), place)).drop("kc1", "kc2", "kc3")


def _weight(rows: DataFrame) -> Column:
    return F.col("weight") if "weight" in rows.columns else F.lit(1)


def metrics(ranked_targets: DataFrame, *groups: str, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hits and reciprocal ranks, over eligible targets (known words) and over all; one row per group. A column `weight` says how often a row counts."""
    known, w = F.col("target") > 2, _weight(ranked_targets)
    eligible = F.sum(F.when(known, w).otherwise(0))
    every = F.coalesce(F.sum(w), F.lit(0))
    out = [every.cast("long").alias("all_targets"), eligible.cast("long").alias("targets"), F.sum(F.when(known, 0).otherwise(w)).cast("long").alias("unknown_targets")]
    for k in cutoffs:
        hit = F.sum(F.when(F.col("rank") <= k, w).otherwise(0))
        out += [hit.cast("long").alias(f"hits{k}"), F.round(hit / F.nullif(eligible, F.lit(0)), 6).alias(f"top{k}"), F.round(hit / every, 6).alias(f"top{k}_all_targets")]
    out.append(F.round(F.sum(F.coalesce(w * 1.0 / F.col("rank"), F.lit(0.0))) / F.nullif(eligible, F.lit(0)), 6).alias("mrr"))
    return ranked_targets.groupBy(*groups).agg(*out) if groups else ranked_targets.agg(*out)


def with_bucket(targets: DataFrame) -> DataFrame:
    """targets with context_bucket: sentence_start, or the number of words of context."""
    return targets.withColumn("context_bucket", F.when(F.col("c3") == 1, "sentence_start").otherwise(F.concat(F.lit("context_"), context_length().cast("string"))))


def top_missed(ranked_targets: DataFrame, limit: int = 20) -> DataFrame:
    return ranked_targets.where("target > 2 and rank is null").groupBy(F.col("target").alias("token_id")).agg(F.sum(_weight(ranked_targets)).alias("misses")).orderBy(F.desc("misses"), "token_id").limit(limit)


def probe(encoded_train: DataFrame, encoded_eval: DataFrame, order: int, k: int = 10) -> DataFrame:
    """Context-order probe: hits and reciprocal rank when only contexts of `order` - 1 words and shorter are used."""
    from . import ngrams

    ranked = {o: ngrams.top_candidates(ngrams.counts(encoded_train, o).withColumn("score", F.col("count")), o, k) for o in range(1, order + 1)}
    return metrics(ranks(positions(encoded_eval), ranked, k)).withColumn("context_order", F.lit(order - 1))


def competition_rank(scores: DataFrame, query: str = "query", label: str = "label", token: str = "token_id", score: str = "score") -> DataFrame:
    """(query, rank): 1 + the number of scores above the label's."""
    own = scores.where(F.col(token) == F.col(label)).select(query, F.col(score).alias("_own"))
    joined = scores.join(own, query)
    return joined.groupBy(query).agg((F.sum(F.when(F.col(score) > F.col("_own"), 1).otherwise(0)) + 1).cast("long").alias("rank"))


def repetition_guard(history: DataFrame, user: str = "user_id", order: str = "tick", token: str = "token_id", frame: int = 256, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """history with repeats: whether the token completes a 3- or 4-gram that the user's last `frame` tokens already hold.

    A gram's last earlier place is found by a window over (user, gram), so the work is linear in the history.
    """
    own = Window.partitionBy(user).orderBy(order)
    rows = history.withColumn("_n", F.row_number().over(own))
    flags = []
    for k in sizes:
        parts = [F.lag(token, i).over(own) for i in range(k - 1, 0, -1)]
        rows = rows.withColumn(f"_g{k}", F.when(parts[0].isNotNull(), F.array(*parts, F.col(token))))
        before = F.lag("_n").over(Window.partitionBy(user, f"_g{k}").orderBy("_n"))
        rows = rows.withColumn(f"_b{k}", F.when(F.col(f"_g{k}").isNotNull(), before))
        flags.append(F.coalesce(F.col(f"_b{k}") - (k - 1) >= F.col("_n") - frame, F.lit(False)))
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return rows.withColumn("repeats", out).drop("_n", *[f"_g{k}" for k in sizes], *[f"_b{k}" for k in sizes])
