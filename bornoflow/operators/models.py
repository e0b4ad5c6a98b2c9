"""Next-word models as tables: saving and loading with checks, identity, hand-overs to and from a scorer, and reports."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import PAD, UNK
from .nextword import suggest

RESERVED = ("<pad>", "<bos>", "<unk>")
FNV64, PRIME64, FNV32, PRIME32 = 0xCBF29CE484222325, 0x100000001B3, 0x811C9DC5, 0x01000193
BACKOFF, INTERPOLATED = "backoff", "merge"  #: how suggest() combines orders, by a model's scores


def fingerprint64(data: bytes) -> int:
    """FNV-1a of a file's bytes; never 0."""
    h = FNV64
    for b in data:
        h = (h ^ b) * PRIME64 & 0xFFFFFFFFFFFFFFFF
    return h or 1


def stable_hash(text: str) -> int:
    """FNV-1 (multiplied first) of a text's UTF-8."""
    h = FNV64
    for b in text.encode():
        h = h * PRIME64 & 0xFFFFFFFFFFFFFFFF ^ b
    return h


def vocabulary_fingerprint(words: list[str]) -> int:
    """FNV-1a of 32 bits over a vocabulary in order of its ids: its size twice, the bytes, each word's place and length, all words; never 0."""
    import struct

    raw = [w.encode() for w in words]
    places, at = [], 0
    for w in raw:
        places += [at, len(w)]
        at += len(w)
    h = FNV32
    for b in struct.pack(f"<{3 + len(places)}I", len(words), len(words), at, *places) + b"".join(raw):
        h = (h ^ b) * PRIME32 & 0xFFFFFFFF
    return h or 1


def text_context_id(text: str) -> int:
    """The id, with the highest of 32 bits set, under which a word outside the vocabulary is a context."""
    h = FNV64
    for b in text.encode():
        h = (h ^ b) * PRIME64 & 0xFFFFFFFFFFFFFFFF
    return 0x80000000 | max(1, (h >> 31 ^ h) & 0x7FFFFFFF)


def checked_vocabulary(vocab: DataFrame) -> DataFrame:
    """vocab (token_id, token, ...), failing where an id of 0 to 2 isn't its reserved word, an id or a word comes twice, or ids leave a gap."""
    facts = vocab.agg(
        F.count("*").alias("n"), F.count_distinct("token_id").alias("ids"), F.count_distinct("token").alias("words"), F.min("token_id").alias("low"), F.max("token_id").alias("high"),
        *[F.max(F.when(F.col("token_id") == k, F.col("token"))).alias(f"r{k}") for k in range(3)],
    ).first()
    if tuple(facts[f"r{k}"] for k in range(3)) != RESERVED:
        raise ValueError(f"ids 0, 1, 2 must be {', '.join(RESERVED)}")
    if not facts.n == facts.ids == facts.words == facts.high + 1 or facts.low != 0:
        raise ValueError("a vocabulary's ids run from 0 without gaps, and its words are distinct")
    return vocab


def is_word_id(token_id: Column, size: int) -> Column:
    """Whether an id names a word: above the reserved ones, below the vocabulary's size."""
    return token_id.between(UNK + 1, size - 1)


def score_mode(unigrams: DataFrame) -> str:
    """BACKOFF where the best unigrams' scores are their counts, else INTERPOLATED: whether orders are tried in turn or merged by score."""
    first = unigrams.orderBy("rank").limit(8).select("score", "count").collect()
    return BACKOFF if first and all(r["score"] == r["count"] for r in first) else INTERPOLATED


@dataclasses.dataclass
class Model:
    """vocab (token_id, token, frequency); ranked: top candidates by order; how to combine orders; the vocabulary's fingerprint."""

    vocab: DataFrame
    ranked: dict[int, DataFrame]
    mode: str
    fingerprint: int

    def suggest(self, contexts: DataFrame, limit: int = 10) -> DataFrame:
        return suggest(contexts, self.ranked, limit, self.mode)


def _fingerprint(vocab: DataFrame) -> int:
    return vocabulary_fingerprint([r.token for r in vocab.orderBy("token_id").select("token").collect()])  # a vocabulary's size is bounded


def save(vocab: DataFrame, ranked: dict[int, DataFrame], path: str) -> None:
    """Tables vocab and order=n under path; each order has the vocabulary's fingerprint in a column."""
    from ..sources.writers import ngram_tables

    mark = _fingerprint(checked_vocabulary(vocab))
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    ngram_tables({o: t.withColumn("vocabulary", F.lit(mark).cast("long")) for o, t in ranked.items()}, path)


def load(spark: SparkSession, path: str) -> Model:
    """What save() wrote: the vocabulary is checked, and each order must have been written with it."""
    vocab = checked_vocabulary(spark.read.parquet(f"{path}/vocab"))
    mark, size = _fingerprint(vocab), vocab.count()
    ranked = {}
    for order in (1, 2, 3, 4):
        t = spark.read.parquet(f"{path}/order={order}")
        wrong = t.where((F.col("vocabulary") != mark) | ~is_word_id(F.col("token_id"), size)).limit(1).count()
        if wrong:
            raise ValueError(f"order {order} is of another vocabulary")
        ranked[order] = t.drop("vocabulary")
    return Model(vocab, ranked, score_mode(ranked[1]), mark)


def info(model: Model) -> DataFrame:
    """One row: the vocabulary's size and fingerprint, rows per order, and the mode."""
    rows = [model.ranked[o].agg(F.count("*").alias(f"rows{o}")) for o in (1, 2, 3, 4)]
    out = model.vocab.agg(F.count("*").alias("vocabulary"))
    for r in rows:
        out = out.crossJoin(F.broadcast(r))  # single rows
    return out.withColumn("fingerprint", F.lit(model.fingerprint).cast("long")).withColumn("mode", F.lit(model.mode))


def rerank_input(contexts: DataFrame, ranked: dict[int, DataFrame], pool: int = 16, width: int = 3, policy: str = BACKOFF) -> DataFrame:
    """contexts (c1, c2, c3, ...) with context: their ids, left-padded to width, and candidates: the pool that a scorer is to rank."""
    ids = F.array_compact(F.array("c1", "c2", "c3"))
    padded = F.concat(F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), width - F.size(ids))), F.slice(ids, F.greatest(F.lit(1), F.size(ids) - width + 1), F.lit(width)))
    return suggest(contexts, ranked, pool, policy).withColumn("context", padded).withColumnRenamed("ids", "candidates")


def accepted_ids(generated: DataFrame, size: int) -> DataFrame:
    """generated (query, token_id, model_rank, model_score) without reserved ids, a token once by its best rank; an id beyond the vocabulary fails."""
    inside = F.when(F.col("token_id").between(0, size - 1), True).otherwise(F.raise_error(F.concat(F.lit("id out of the vocabulary: "), F.col("token_id").cast("string"))).cast("boolean"))
    rows = generated.where(inside).where(F.col("token_id") > UNK)
    best = rows.groupBy("query", "token_id").agg(F.min_by(F.struct("model_rank", "model_score"), F.struct("model_rank", -F.col("model_score"))).alias("b"))
    return best.select("query", "token_id", "b.model_rank", "b.model_score")


def context_priors(candidates: DataFrame, contexts: DataFrame, model: Model, pool: int = 64) -> DataFrame:
    """candidates (context_id, candidate_index, text) that the model's pool for their context (context_id, c1, c2, c3) has: token_id and prior_rank, from 1."""
    ranked = model.suggest(contexts.select("c1", "c2", "c3").distinct(), pool).select(*[F.col(c).alias(f"k{c}") for c in ("c1", "c2", "c3")], F.posexplode("ids").alias("p", "token_id"))
    on = [F.col(c).eqNullSafe(F.col(f"k{c}")) for c in ("c1", "c2", "c3")]
    prior = contexts.join(ranked, on).select("context_id", "token_id", (F.col("p") + 1).alias("prior_rank"))
    words = candidates.join(model.vocab.select(F.col("token").alias("text"), "token_id"), "text")
    return words.join(prior, ["context_id", "token_id"]).select("context_id", "candidate_index", "text", "token_id", "prior_rank")


def output_bias(vocab: DataFrame, unigrams: DataFrame, floor: float = 0.1) -> DataFrame:
    """(token_id, bias): log of each id's share of the unigram counts, reserved and unseen ids counting as `floor`."""
    rows = vocab.select("token_id").join(unigrams.select("token_id", "count"), "token_id", "left")
    n = F.when(F.col("token_id") > UNK, F.greatest(F.coalesce(F.col("count").cast("double"), F.lit(floor)), F.lit(floor))).otherwise(F.lit(floor))
    rows = rows.select("token_id", n.alias("n"))
    total = rows.agg(F.sum("n").alias("total"))  # a single row
    return rows.crossJoin(F.broadcast(total)).select("token_id", F.log(F.col("n") / F.col("total")).alias("bias"))


def source_gains(model: DataFrame, baseline: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """metrics() by source of a model and of a baseline, to the model's shares of all targets and their gains; sources that both have."""
    named = baseline.select("source", *[F.col(f"top{k}_all_targets").alias(f"_b{k}") for k in cutoffs], (F.col("mrr") * F.col("targets") / F.col("all_targets")).alias("_bm"))
    own = (F.col("mrr") * F.col("targets") / F.col("all_targets")).alias("mrr_all_targets")
    gains = [(F.col(f"top{k}_all_targets") - F.col(f"_b{k}")).alias(f"top{k}_gain") for k in cutoffs]
    rows = model.join(named, "source").select("source", "targets", "all_targets", *[f"top{k}_all_targets" for k in cutoffs], *gains, own, "_bm")
    return rows.withColumn("mrr_gain", F.col("mrr_all_targets") - F.col("_bm")).drop("_bm")


def source_balance(gains: DataFrame) -> DataFrame:
    """One row over source_gains(): sources, whether none loses in top 5 or reciprocal rank, and the smallest gains (0 without sources)."""
    return gains.agg(
        F.count("*").alias("source_count"), F.coalesce(F.every((F.col("top5_gain") >= 0) & (F.col("mrr_gain") >= 0)), F.lit(False)).alias("all_sources_non_regressing"),
        F.coalesce(F.min("top5_gain"), F.lit(0.0)).alias("min_top5_gain"), F.coalesce(F.min("mrr_gain"), F.lit(0.0)).alias("min_mrr_gain"),
    )


def save_personal(store: DataFrame, path: str, fingerprint: int) -> None:
    """A snapshot of personal entries, each marked with the model it was learnt beside."""
    store.withColumn("model_fingerprint", F.lit(fingerprint).cast("long")).write.mode("overwrite").parquet(path)


def load_personal(spark: SparkSession, path: str, fingerprint: int, limit: int | None = None) -> DataFrame:
    """A snapshot's entries, cut to the store's size; one of another model, or entries that aren't distinct, fail."""
    from .personal import MAX_ENTRIES, evicted

    rows = spark.read.parquet(path)
    if rows.where(~F.col("model_fingerprint").eqNullSafe(F.lit(fingerprint))).limit(1).count():
        raise ValueError("the snapshot is of another model")
    key = ["user_id", "context_len", "context", "token_id"]
    if rows.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError("an entry comes twice")
    return evicted(rows.drop("model_fingerprint"), limit or MAX_ENTRIES)


def personal_size(store: DataFrame) -> DataFrame:
    """(user_id, entries, bytes): how much each user's entries hold."""
    return store.groupBy("user_id").agg(F.count("*").alias("entries"), F.sum(F.octet_length("context") + F.octet_length(F.col("token_id").cast("string")) + 16).cast("long").alias("bytes"))


def pairwise_weights(features: DataFrame, label: str = "is_label", query: str = "query", columns: tuple[str, ...] = (), epochs: int = 20, rate: float = 0.1, l2: float = 1e-4) -> dict[str, float]:
    """Weights of a linear ranking: logistic loss on the differences of each query's label and its other candidates.

    A pass over the data per epoch sums the gradient of all differences in the JVM; only that, one number a feature, comes back.
    """
    own = features.where(label).select(query, *[F.col(c).alias(f"_{c}") for c in columns])
    diffs = features.where(~F.col(label)).join(own, query).select(*[(F.col(f"_{c}") - F.col(c)).cast("double").alias(c) for c in columns])
    w = dict.fromkeys(columns, 0.0)
    n = diffs.count()
    for _ in range(epochs if n else 0):
        margin = sum((F.col(c) * w[c] for c in columns), F.lit(0.0))
        pull = 1 / (1 + F.exp(margin))
        g = diffs.agg(*[F.sum(pull * F.col(c)).alias(c) for c in columns]).first()
        w = {c: w[c] + rate * (g[c] / n - l2 * w[c]) for c in columns}
    return w
