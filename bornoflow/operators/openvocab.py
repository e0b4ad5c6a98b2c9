"""Open-vocabulary texts from a model: an ordered chain of reasons to refuse them, and their acceptance in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER, HASANT, ZWNJ = "\u0985-\u09b9\u09ce\u09dc-\u09e1", "\u09cd", "\u200c"
MARK = "ঁ-ঃ়-্ৗৢৣ৾"


def reason(text: Column, score: Column, min_score: float = float("-inf"), max_chars: int = 32, max_run: int = 3) -> Column:
    """Why a text is refused, null where it is accepted. The first fault from the left decides, as a scan would find it."""
    good = f"(?:[{LETTER}]|(?<!{HASANT})(?<!^)[{MARK}]|(?<!^)(?<!{ZWNJ}){ZWNJ}(?!$))"
    # the longest faultless beginning; what follows it is the fault
    head = F.regexp_extract(text, f"^{good}*", 0)
    rest = F.substring(text, F.length(head) + 1, F.lit(2))
    c, before = F.substring(rest, 1, 1), F.substring(head, -1, 1)
    repeated = F.length(F.regexp_extract(text, rf"^(.*?)(.)\2{{{max_run}}}", 0))
    fault = (
        F.when(c == ZWNJ, "invalid_zwnj").when(c.rlike(r"^\s"), "whitespace").when(c.rlike(r"^[!-/:-@\[-`{-~।॥৳৺]"), "punctuation").when(c.rlike("^[0-9০-৯]"), "digit")
        .when(~c.rlike(f"^[{LETTER}{MARK}]"), "non_bangla").when(F.length(head) == 0, "starts_with_mark").when((before == HASANT) & (c == HASANT), "consecutive_hasant").otherwise("mark_after_hasant")
    )
    return (
        F.when(F.isnan(score) | score.isin(float("inf"), float("-inf")), "non_finite_score").when(score < min_score, "score_below_threshold").when(text == "", "empty")
        .when(F.trim(text) != text, "outer_whitespace").when(F.length(text) > max_chars, "too_long").when((repeated > 0) & (repeated <= F.length(head) + 1), "repeated_run")
        .when(c != "", fault).when(text.endswith(HASANT), "ends_with_hasant").when(~text.rlike(f"[{LETTER}]"), "missing_letter")
    )


def accepted(texts: DataFrame, limit: int = 8, **policy) -> DataFrame:
    """(query, text, text_rank, text_score): per query the accepted texts, each once with its best rank and best score apart."""
    good = texts.where(reason(F.col("text"), F.col("score"), **policy).isNull())
    one = good.groupBy("query", "text").agg(F.min("rank").alias("text_rank"), F.max("score").alias("text_score"))
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("text_rank", "text"))).where(F.col("_r") <= limit).drop("_r")
