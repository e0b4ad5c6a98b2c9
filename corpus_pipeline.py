"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bornoflow.llm import byte_bpe, line_dedup, mixing, quality, shingle_sets, simhash
from bornoflow.llm.common import fresh, read, removed, shared_dir
from bornoflow.llm.components import connected

#: SQL can't express the learned classifier, SimHash or BPE; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged.

    Null and empty texts are scored like others; equal texts get equal scores, so repeated rows stay or go together; a text at
    the threshold stays; without labelled rows every score is the prior; an empty table stays empty."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one repeats; a document that had words and keeps none goes.

    Null texts stay null and empty ones empty; of lines at the same place (rows equal in id and text) all or none stay; rows of
    null id come last; other columns pass unchanged, whatever their names; an empty table stays empty."""
    word = r"[^\x20\x09-\x0D]"
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    out = line_dedup.dedup(docs, counts=(n_lines, n_removed))
    return out.where((F.col(n_removed) == 0) | F.col("text").rlike(word)).select(docs.columns)


def _identity(docs: DataFrame):
    """A hash of a row's columns, which tells rows of equal id and text apart."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant", "void") else F.col(f"`{f.name}`") for f in docs.schema])


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, null ids last; of rows of equal id the one of smallest text hash.

    Texts are linked by fingerprints of 3 differing bits or fewer, as in op10, and by five-word shingles of Jaccard similarity 0.8 or more.
    Null, empty and wordless texts are one group; repeated rows leave one; rows of equal id and unlike texts all stay; columns of any
    name pass unchanged; an empty table stays empty."""
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "doc_id", _identity(docs).alias("same"), F.struct("*").alias("row"))
    texts = rows.select("key", F.col("row.text").alias("text"))
    prints = simhash.near_duplicates(texts.withColumnRenamed("key", "doc_id")).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    roots = connected(prints.unionByName(shingle_sets.links(texts)))
    owner = rows.select("key", "doc_id", "same").join(roots, F.col("key") == F.col("node"), "left").select("key", "doc_id", "same", F.coalesce("root", "key").alias("root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "same")).alias("x")
    chosen = owner.groupBy("root").agg(least).select(F.col("x.key").alias("key"), F.col("x.same").alias("same"))
    return rows.join(chosen, ["key", "same"], "left_semi").dropDuplicates(["key", "same"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole; a row that it doesn't take goes.

    Null and wordless texts have no words and come as often as complete epochs of their source do; rows equal in id and text
    are ordered by a hash of their other columns, and count each; null sources are a source; an empty table stays empty."""
    taken = mixing.mix(docs, boundary="whole", carry=_identity(docs))
    return taken.select(F.inline(F.array_repeat("row", (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text: their number, and the little-endian 32-bit ids in base64.

    A null or empty text has no ids; rows stand for themselves, repeated or of null id; an empty table stays empty."""
    import public_tokenizers

    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.base64("ids").alias("ids_base64"))


STAGES = [
    ("quality", classify),
    ("lines", dedup_lines),
    ("near_duplicates", drop_similar),
    ("mix", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; each stage's docstring says what becomes of nulls, ties and repeated rows."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # the stage before has been read for the last time
                removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
