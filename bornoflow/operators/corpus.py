"""Documents to sentences, dedup, vocabulary, splits, encoding. DataFrame to DataFrame, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAD, BOS, UNK = 0, 1, 2


def scan_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, content, token_type, position): scanner tokens in rows; position counts UTF-8 bytes before the token."""
    rows = docs.select(key, F.posexplode(T.scan_pieces(F.col(text))).alias("idx", "content"))
    before = F.sum(F.octet_length("content")).over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, "idx", "content", T.piece_type(F.col("content")).alias("token_type"), F.coalesce(before, F.lit(0)).cast("long").alias("position"))


def sentence_rows(docs: DataFrame, tokens=T.latin_tokens, min_tokens: int = 2, max_tokens: int = 64, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, document_id, sentence_id, tokens): sentences of min_tokens or more, cut into chunks of at most max_tokens.

    All within a document's arrays, so without a shuffle. Ids count from 1 and are given before dedup.
    """
    sized = F.filter(F.transform(F.split(F.col(text), T.SENTENCE_END), tokens), lambda t: F.size(t) >= min_tokens)
    chunks = F.flatten(F.transform(sized, lambda t: F.transform(F.sequence(F.lit(0), F.ceil(F.size(t) / max_tokens).cast("int") - 1), lambda k: F.slice(t, k * max_tokens + 1, F.lit(max_tokens)))))
    kept = F.filter(chunks, lambda t: F.size(t) >= min_tokens)
    return docs.select(F.col(source).alias("source"), F.col(key).alias("document_id"), F.posexplode(kept).alias("p", "tokens")).select("source", "document_id", (F.col("p") + 1).alias("sentence_id"), "tokens")


def dedup_sentences(sentences: DataFrame) -> DataFrame:
    """The first of equal sentences in the order of (source, document_id, sentence_id). Combines before its one shuffle."""
    first = sentences.groupBy("tokens").agg(F.min(F.struct("source", "document_id", "sentence_id")).alias("at"))
    return first.select("at.*", "tokens")


def source_stats(sentences: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source: documents with sentences, sentences, duplicates, emitted sentences and tokens."""
    every = sentences.groupBy("source").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("sentences"))
    emitted = kept.groupBy("source").agg(F.count("*").alias("emitted_sentences"), F.sum(F.size("tokens")).alias("emitted_tokens"))
    out = every.join(emitted, "source", "left").na.fill(0, ["emitted_sentences", "emitted_tokens"])
    return out.withColumn("duplicate_sentences", F.col("sentences") - F.col("emitted_sentences"))


def document_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document: source_bytes, emitted_sentences, emitted_tokens; documents without sentences count 0."""
    per = kept.groupBy("document_id").agg(F.count("*").alias("emitted_sentences"), F.sum(F.size("tokens")).alias("emitted_tokens"))
    base = docs.select(F.col("doc_id").alias("document_id"), "source", F.octet_length("text").cast("long").alias("source_bytes"))
    return base.join(per, "document_id", "left").na.fill(0, ["emitted_sentences", "emitted_tokens"])


def vocabulary(sentences: DataFrame, size: int = 32_768, min_count: int = 3) -> DataFrame:
    """(token_id, token, frequency): ids 0, 1, 2 are pad, bos, unk; then the size - 3 most frequent, ties by token.

    The ranking runs over at most `size` rows: a distributed top-k comes first.
    """
    counts = sentences.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= min_count)
    top = counts.orderBy(F.desc("count"), "token").limit(size - 3)
    ranked = top.select((F.row_number().over(Window.orderBy(F.desc("count"), "token")) + 2).alias("token_id"), "token", F.col("count").alias("frequency"))
    special = sentences.sparkSession.createDataFrame([(PAD, "<pad>", 0), (BOS, "<bos>", 0), (UNK, "<unk>", 0)], "token_id int, token string, frequency long")
    return special.unionByName(ranked)


def coverage(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: tokens of the corpus, those in the vocabulary, and their share."""
    known = vocab.where("token_id > 2").select("token", F.lit(1).alias("k"))
    words = sentences.select(F.explode("tokens").alias("token")).groupBy("token").count()
    sums = words.join(known, "token", "left").agg(F.sum("count").alias("total_tokens"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("count"))), F.lit(0)).alias("covered_tokens"))
    return sums.withColumn("coverage", F.col("covered_tokens") / F.col("total_tokens"))


def encode(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """sentences with ids: BOS, then each token's id or UNK. A narrow pass without a shuffle.

    The vocabulary has a bounded size (vocabulary()'s `size` rows); it is sent to the executors once, where a batch's tokens are
    looked up together. Catalyst has no such lookup: a map's is linear, and a join would shuffle tokens twice.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = vocab.where(F.col("token_id") > UNK).select("token", "token_id").collect()
    sent = sentences.sparkSession.sparkContext.broadcast(([r.token for r in rows], [r.token_id for r in rows]))
    keys = ["source", "document_id", "sentence_id"]

    def run(batches):
        import numpy as np

        words, ids = pa.array(sent.value[0], pa.string()), np.append(np.array(sent.value[1], "i4"), UNK)
        for b in batches:
            tokens = b.column(len(keys))
            sizes = np.asarray(pc.list_value_length(tokens).fill_null(0), "i8")
            found = np.asarray(pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=words), len(words)))
            ends = np.cumsum(sizes + 1)
            out = np.empty(int(ends[-1]) if len(ends) else 0, "i4")
            first = np.zeros(len(out), bool)
            first[ends - sizes - 1] = True
            out[first], out[~first] = BOS, ids[found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))], [*keys, "ids"])

    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys) + ", ids array<int>"
    return sentences.select(*keys, "tokens").mapInArrow(run, schema)


def ordinals(sentences: DataFrame) -> DataFrame:
    """sentences with ordinal: its place (from 0) within its source, by document and sentence.

    Counts per document come first and are added up over documents, which is what one task of a large source orders;
    within documents places come from their own windows.
    """
    per = sentences.groupBy("source", "document_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("source", "document_id", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("source", "document_id").orderBy("sentence_id")) - 1
    return sentences.withColumn("place", place).join(starts, ["source", "document_id"]).withColumn("ordinal", (F.col("start") + F.col("place")).cast("long")).drop("start", "place")


def split(sentences: DataFrame, train_start: int = 0, train_limit: int = 100_000, eval_start: int = 100_000, eval_limit: int = 25_000) -> DataFrame:
    """sentences with split: 'train', 'eval' or null by ranges of their ordinal within the source."""
    o = F.col("ordinal")
    part = F.when((o >= train_start) & (o < train_start + train_limit), "train").when((o >= eval_start) & (o < eval_start + eval_limit), "eval")
    return ordinals(sentences).withColumn("split", part)


def limited(sentences: DataFrame, skip: int = 0, limit: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """Per source the sentences from `skip` on, at most `limit`."""
    rows = sentences if sources is None else sentences.where(F.col("source").isin(sources))
    rows = ordinals(rows).where(F.col("ordinal") >= skip)
    return rows if limit is None else rows.where(F.col("ordinal") < skip + limit)


def source_weight(weights: dict[str, int], default: int = 1) -> Column:
    """The weight of column source."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col("source") == name, w).otherwise(out)
    return out
