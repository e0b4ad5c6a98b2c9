"""Transliteration over columns. Words are rendered in Arrow batches with a cache per worker: Catalyst has no such rules."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.translit import render_text, units

UNITS = ArrayType(StructType([StructField("text", StringType()), StructField("kind", StringType()), StructField("position", IntegerType())]))


SLICE = 64  #: Texts that are Python strings at one time; an Arrow batch may hold 10,000.


def rendered_array(text: pa.Array) -> pa.Array:
    """Each text rendered, slice by slice, so that only Arrow's bytes of a batch are held whole."""
    out = [pa.array([None if t is None else render_text(t) for t in text.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(text), SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def rendered(text: pa.Array) -> pa.Array:
    return rendered_array(text)


@F.pandas_udf(UNITS)
def word_units(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else [u._asdict() for u in units(w)])


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    import html

    return text.map(html.unescape, na_action="ignore")


def strict(text: Column) -> Column:
    """Bangla, or the text as it is if it holds any character the sanitizer stops."""
    return F.coalesce(rendered(F.when(T.is_valid(text), text)), text)  # the renderer passes nulls: it only sees valid texts


def lenient(text: Column) -> Column:
    """Bangla of the text without the characters that the sanitizer stops."""
    return rendered(T.clean(text))


def dictionary(words: DataFrame) -> DataFrame:
    """(word, bangla) of distinct words."""
    return words.select("word").distinct().select("word", rendered("word").alias("bangla"))
