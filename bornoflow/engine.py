"""A facade for callers with a session: transliterate, suggest, next words; SQL functions; a small command line.

    python -m bornoflow.engine strict "ami banglay gan gai"
    python -m bornoflow.engine units biggan
    python -m bornoflow.engine repairs bangi
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import repairs as R
from .functions import translit as W
from .operators import corpus, ngrams, nextword


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register(self) -> None:
        """Register the SQL functions bn_render, bn_units and bn_nfc."""
        from .operators import transliteration as X

        self.spark.udf.register("bn_render", X.rendered)
        self.spark.udf.register("bn_units", X.word_units)
        self.spark.udf.register("bn_nfc", X.nfc)

    def transliterate(self, df: DataFrame, column: str = "text", lenient: bool = False) -> DataFrame:
        from .operators import transliteration as X

        return df.withColumn("bangla", (X.lenient if lenient else X.strict)(F.col(column)))

    def correct(self, words: DataFrame, lexicon: DataFrame, limit: int = 8) -> DataFrame:
        """words (roman) to ranked corrections; limit is kept within 1 and 8."""
        from .operators import autocorrect
        from .operators import transliteration as X

        queries = words.select("roman", X.rendered("roman").alias("query"))
        return queries.join(autocorrect.suggest(queries, lexicon, max(1, min(8, limit))), "query")

    def model(self, sentences: DataFrame, vocabulary_size: int = 32_768, min_count: int = 3, k: int = 16, mode: str = "modified-kneser-ney") -> tuple[DataFrame, dict[int, DataFrame]]:
        """(vocabulary, ranked tables of orders 1 to 4)."""
        vocab = corpus.vocabulary(sentences, vocabulary_size, min_count)
        encoded = corpus.encode(sentences, vocab)
        tables = {o: ngrams.counts(encoded, o) for o in (1, 2, 3, 4)}
        return vocab, {o: ngrams.top_candidates(ngrams.scored(tables, o, mode), o, k) for o in tables}

    def next_words(self, contexts: DataFrame, vocab: DataFrame, ranked: dict[int, DataFrame], limit: int = 8, policy: str = "merge") -> DataFrame:
        """contexts (context_id, tokens) to (context_id, rank, token); limit is kept within 1 and 16."""
        rows = contexts.select(F.lit("q").alias("source"), F.col("context_id").alias("document_id"), F.lit(1).alias("sentence_id"), F.concat("tokens", F.array(F.lit("\x00"))).alias("tokens"))
        targets = nextword.positions(corpus.encode(rows, vocab))
        last = targets.groupBy("document_id").agg(F.max_by(F.struct("c1", "c2", "c3"), "idx").alias("c")).select("document_id", "c.*")
        found = nextword.suggest(last, ranked, max(1, min(16, limit)), policy)
        ids = found.select(F.col("document_id").alias("context_id"), F.posexplode("ids").alias("rank", "token_id"))
        return ids.join(vocab.select("token_id", "token"), "token_id").select("context_id", (F.col("rank") + 1).alias("rank"), "token")


def check_manifest(manifest: dict, vocabulary: int, max_bytes: int, min_top5: float) -> list[str]:
    """What is wrong with a model's manifest: identity, size budget, quality overall and gain in every source."""
    faults = []
    if manifest.get("vocabulary") != vocabulary:
        faults.append("vocabulary differs")
    if not isinstance(manifest.get("bytes"), int) or not 0 < manifest["bytes"] <= max_bytes:
        faults.append("size is out of budget")
    if not manifest.get("eval", {}).get("top5", 0.0) >= min_top5:
        faults.append("top-5 is below the gate")
    gains = [s.get("gain") for s in manifest.get("eval_per_source", {}).values()]
    if not gains or any(g is None or g < 0 for g in gains):
        faults.append("a source regresses")
    return faults


def main(args: list[str]) -> int:
    commands = {
        "strict": lambda t: W.render_text(t), "units": lambda t: "\n".join(f"{u.position}\t{u.kind}\t{u.text}" for u in W.units(t)),
        "tokens": lambda t: "\n".join(W.pieces(t)), "repairs": lambda t: "\n".join(f"{c}\t{k}\t{r}\t{W.render(r)}" for r, c, k in R.repairs(t)),
    }
    if len(args) != 2 or args[0] not in commands:
        print(__doc__)
        return 2
    print(commands[args[0]](args[1]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
