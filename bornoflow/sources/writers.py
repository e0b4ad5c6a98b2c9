"""Writers: lexicons, sentence corpora, n-gram tables, candidates, quarantine, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon_tsv(lexicon: DataFrame, path: str) -> None:
    """Words by falling frequency, then by word; the order runs through the part files."""
    lexicon.orderBy(F.desc("frequency"), "word").select("word", "frequency").write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def lexicon_table(lexicon: DataFrame, path: str) -> None:
    """Parquet in word order: row groups prune prefix lookups."""
    lexicon.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def sentence_corpus(sentences: DataFrame, path: str) -> None:
    """A folder per source. Ranges of (source, document) are the tasks, so a large source is many files and not one task."""
    sentences.repartitionByRange("source", "document_id").sortWithinPartitions("source", "document_id", "sentence_id").write.mode("overwrite").partitionBy("source").parquet(path)


def ngram_tables(tables: dict[int, DataFrame], path: str) -> None:
    for order, t in tables.items():
        keys = [f"c{i}" for i in range(1, order)] or ["token_id"]
        t.repartitionByRange(*keys).sortWithinPartitions(*keys, "rank").write.mode("overwrite").parquet(f"{path}/order={order}")


def candidates_json(suggestions: DataFrame, path: str) -> None:
    """One JSON line per query with its candidates in rank order."""
    item = F.struct(*[c for c in suggestions.columns if c != "query"])
    suggestions.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("candidates")).write.mode("overwrite").json(path)


def _tsv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", quote="", escape="", header=header)


def quarantine_tsv(rows: DataFrame, path: str) -> None:
    """curation()'s rows that don't stay, by source, reason, frequency and word."""
    _tsv(rows.where("reason is not null").orderBy("source", "reason", "frequency", "word").select("word", "frequency", "source", "decision", "reason"), path, True)


def loanword_seed_tsv(candidates: DataFrame, path: str) -> None:
    """Mined pairs (english, bangla, frequency, evidence) by key and word, evidence joined by commas."""
    _tsv(candidates.orderBy("english", "bangla").select(F.col("english").alias("english_key"), F.col("bangla").alias("bangla_word"), F.col("frequency").alias("bangla_frequency"), F.array_join(F.array_sort("evidence"), ",").alias("evidence")), path, True)


def loanword_gaps_tsv(coverage: DataFrame, path: str) -> None:
    """Keys of coverage() (english, listed, probed) that no list has a word for, with what the probe finds."""
    gaps = coverage.where(F.coalesce(F.size("listed"), F.lit(0)) <= 0)
    _tsv(gaps.orderBy("english").select(F.col("english").alias("english_key"), F.coalesce(F.to_json("probed"), F.lit("[]")).alias("skeleton_candidates")), path, True)


def manifest(values: dict, path: str) -> None:
    """A small JSON file, keys sorted, written by the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")


def tree_hash(spark, root: str) -> str:
    """SHA-256 of a folder: of the paths and hashes of its files in order."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("h"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat_ws(" ", x["path"], x["h"]))), 256)).first()[0]
