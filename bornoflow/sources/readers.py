"""Readers: corpora by format, JSON prose, wiki and news articles, EPUB, lexicon and pair tables, sentence corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.transliteration import nfc, unescaped

EXTENSIONS = "epub|html|htm|xhtml|json|txt|text|md|markdown"
PROSE = ("title", "headline", "content", "text", "body", "article")
LEXICON = "word string, frequency string, extra string"


def files(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, content, format): the files of a corpus by extension, each once; an error if there are none."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    kind = F.lower(F.regexp_extract("path", rf"\.({EXTENSIONS})$", 1))
    return df.where(F.lower("path").rlike(rf"\.({EXTENSIONS})$")).dropDuplicates(["path"]).select("path", "content", F.when(kind.isin("html", "htm", "xhtml"), "html").when(kind.isin("epub", "json"), kind).otherwise("text").alias("format"))


@F.pandas_udf(StringType())
def json_prose(json: pd.Series) -> pd.Series:
    """Strings of a JSON value: of an object, its prose fields in a fixed order if it has any, else all its values."""
    import json as J

    def walk(x):
        if isinstance(x, str):
            yield x
        elif isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            for y in [x[k] for k in PROSE if k in x] or x.values():
                yield from walk(y)

    def read(s):
        try:
            return None if s is None else "\n".join(walk(J.loads(s)))
        except ValueError:
            return None

    return json.map(read)


def epub_members(data: bytes) -> list[tuple[str, str]]:
    """(name, markup) of a book's texts in spine order, without navigation and non-linear items; all text members if there is no spine."""
    import io
    import posixpath
    import re
    import zipfile
    from urllib.parse import unquote
    from xml.etree import ElementTree as E

    text = re.compile(r"\.(xhtml|html?|txt)$", re.IGNORECASE)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = []
        try:
            own = lambda tree, tag: (x for x in tree.iter() if x.tag.rsplit("}", 1)[-1] == tag)
            opf = next(x.get("full-path", "") for x in own(E.fromstring(z.read("META-INF/container.xml")), "rootfile"))
            tree = E.fromstring(z.read(opf))
            items = {x.get("id"): x for x in own(tree, "item") if x.get("href")}
            for ref in own(tree, "itemref"):
                item = items.get(ref.get("idref"))
                if item is None or ref.get("linear", "").lower() == "no" or "nav" in item.get("properties", "").split():
                    continue
                href = unquote(item.get("href").split("#", 1)[0])
                if item.get("media-type") in ("application/xhtml+xml", "text/html", "text/plain") or text.search(href):
                    names.append(posixpath.normpath(posixpath.join(posixpath.dirname(opf), href)))
        except (KeyError, StopIteration, E.ParseError):
            names = []
        names = list(dict.fromkeys(names)) or sorted(n for n in z.namelist() if text.search(n))
        there = set(z.namelist())
        return [(n, z.read(n).decode("utf-8", "replace")) for n in names if n in there]


class EpubSource(DataSource):
    """spark.read.format("epub").load(folder): (book, idx, member, markup), one partition per book."""

    @classmethod
    def name(cls):
        return "epub"

    def schema(self):
        return "book string, idx int, member string, markup string"

    def reader(self, schema):
        return EpubReader(self.options["path"])


class EpubReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs

        root = self.root if "://" in self.root else f"file://{self.root}"
        system, base = fs.FileSystem.from_uri(root)
        found = system.get_file_info(fs.FileSelector(base, recursive=True)) if system.get_file_info(base).is_file is False else [system.get_file_info(base)]
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.lower().endswith(".epub")] or [InputPartition(None)]

    def read(self, partition):
        from pyarrow import fs

        if partition.value is None:
            return
        system = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")[0]
        with system.open_input_file(partition.value) as f:
            for i, (name, markup) in enumerate(epub_members(f.read())):
                yield partition.value, i, name, markup


def markup_text(markup):
    """Text of markup with all named and numeric entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    return unescaped(bare)


def corpus(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, format, text): every file of a corpus as NFC text, by its format's reader."""
    rows = files(spark, *roots)
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    epub = F.udf(lambda b: None if b is None else "\n".join(m for _, m in epub_members(bytes(b))), StringType())
    text = F.when(F.col("format") == "json", json_prose(plain)).when(F.col("format") == "html", T.html_to_text(plain)).when(F.col("format") == "epub", T.html_to_text(epub(F.when(F.col("format") == "epub", F.col("content"))))).otherwise(plain)
    return rows.select("path", "format", nfc(text).alias("text"))


def wiki(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, title, text, ref) of JSON articles; malformed files are dropped."""
    df = spark.read.schema("pageid long, title string, content string, url string").json(folder, multiLine=True, mode="DROPMALFORMED")
    return df.where("title is not null or content is not null").select(F.sha2(F.coalesce("url", F.col("pageid").cast("string")), 256).alias("document_id"), "title", F.concat_ws("\n", "title", "content").alias("text"), F.col("url").alias("ref"))


def news(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(document_id, title, text) of one JSON array of items with a title or content, each a string or a list of strings."""
    df = spark.read.schema("id string, title string, content string, url string").json(path, multiLine=True)
    flat = lambda c: F.coalesce(F.array_join(F.from_json(c, "array<string>"), "\n"), F.col(c))
    rows = df.where("title is not null or content is not null").select(F.coalesce("id", "url").alias("document_id"), flat("title").alias("title"), F.concat_ws("\n", flat("title"), flat("content")).alias("text"))
    return rows if limit is None else rows.limit(limit)


def lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """(word, frequency, reason) of word/frequency tables: frequency defaults to 1, lines that begin with # are comments; reason names what is wrong."""
    df = spark.read.schema(LEXICON).csv(list(paths), sep="\t", comment="#", quote="", mode="PERMISSIVE")
    n = F.expr("try_cast(frequency as bigint)")
    reason = F.when(F.col("extra").isNotNull(), "extra_column").when(F.coalesce(F.trim("word"), F.lit("")) == "", "empty").when(F.col("frequency").isNotNull() & (n.isNull() | ~n.between(0, 4_294_967_295)), "frequency").when(~T.is_lexicon_word(F.col("word")), "not_a_word")
    return df.select("word", F.coalesce(n, F.lit(1)).alias("frequency"), reason.alias("reason"))


def lexicon_strict(spark: SparkSession, *paths: str) -> DataFrame:
    rows = lexicon(spark, *paths)
    return rows.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad lexicon line:"), "word", "reason")).cast("boolean"))).drop("reason")


def lexicon_lenient(spark: SparkSession, *paths: str) -> DataFrame:
    """Good lines alone, frequencies of equal words added."""
    return lexicon(spark, *paths).where("reason is null").groupBy("word").agg(F.sum("frequency").alias("frequency"))


def loanwords(spark: SparkSession, path: str, frequency: int = 1) -> DataFrame:
    """(bangla, english, frequency, reason) of pairs; a header line counts as a bad key and so drops out; equal pairs once."""
    df = spark.read.schema("bangla string, english string, extra string").csv(path, sep="\t", comment="#", quote="")
    key = T.loanword_key(F.trim("english"))
    reason = F.when(F.col("extra").isNotNull() | F.col("english").isNull(), "columns").when(key.isNull(), "english").when(~T.is_loose_bangla(F.col("bangla")), "bangla")
    return df.select("bangla", F.coalesce(key, F.col("english")).alias("english"), F.lit(frequency).alias("frequency"), reason.alias("reason")).dropDuplicates(["bangla", "english"])


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, expected): exactly two columns, neither empty; anything else fails."""
    df = spark.read.schema("source string, expected string, extra string").csv(path, sep="\t", comment="#", quote="")
    ok = F.col("extra").isNull() & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("expected", F.lit("")) != "")
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a pair needs two columns")).cast("boolean"))).select("source", "expected")


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(source, document_id, sentence_id, tokens) of a sentence corpus in tab-separated text, plain or gz."""
    df = spark.read.schema("source string, document_id string, sentence_id int, token_count int, tokens string").csv(path, sep="\t", header=True, quote="")
    return df.select("source", "document_id", "sentence_id", F.split("tokens", " ").alias("tokens"))


NEWS_FIELDS = ("title", "content", "category_bn", "tag")


def news_lexicon(spark: SparkSession, path: str, fields: tuple[str, ...] = NEWS_FIELDS, min_frequency: int = 1, limit: int | None = None) -> DataFrame:
    """(word, frequency) of chosen fields of a news file (one JSON array): strings, or the strings of lists; other values count as absent."""
    df = spark.read.schema(", ".join(f"`{f}` string" for f in fields)).json(path, multiLine=True)
    df = df if limit is None else df.limit(limit)
    strings = lambda c: F.when(c.startswith("["), F.coalesce(F.transform(F.filter(F.from_json(c, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array(c))).when(~c.startswith("{"), F.array(c))
    texts = df.select(F.explode(F.flatten(F.array_compact(F.array(*[strings(F.col(f"`{f}`")) for f in fields])))).alias("text"))
    words = texts.select(F.explode(T.bangla_tokens(F.col("text"))).alias("word")).where(T.is_lexicon_word(F.col("word")))
    return words.groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)


def _checked(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing where rows share the keys."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows of equal {', '.join(keys)}")
    return df


def lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, frequency) that writers.lexicon_table wrote: words are distinct, not empty, and frequencies fit 32 bits, or it fails."""
    df = _checked(spark.read.parquet(path), "word")
    if df.where("word is null or word = '' or frequency is null or frequency not between 0 and 4294967295").limit(1).count():
        raise ValueError("an entry without a word, or whose frequency is out of range")
    return df


def loanword_table(spark: SparkSession, path: str) -> DataFrame:
    """(english, bangla, frequency) as Parquet: pairs are distinct and keys clean, or it fails."""
    df = _checked(spark.read.parquet(path), "english", "bangla")
    if df.where(~F.coalesce(T.is_loanword_key(F.col("english")), F.lit(False)) | (F.coalesce("bangla", F.lit("")) == "")).limit(1).count():
        raise ValueError("an entry whose key or value is no word")
    return df


#: Templates of a dictionary's etymologies that name the English word something was borrowed from.
TEMPLATES = ("bor", "bor+", "borrowing", "der", "der+", "lbor", "translit", "uder")
BORROWED = r"[Bb]orrowed from English ([A-Za-z][A-Za-z .'\-’]{0,80})"
WRITTEN = r"[Tt]ransliteration of English ([A-Za-z][A-Za-z .'\-’]{0,80})"


def dictionary_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(english, bangla, evidence) of a dictionary in JSON lines (word, etymology_templates, etymology_text): English words by template, and by the text."""
    schema = "word string, etymology_text string, etymology_templates array<struct<name: string, args: map<string, string>>>"
    df = spark.read.schema(schema).json(path).select(F.trim("word").alias("bangla"), "etymology_text", "etymology_templates")
    named = df.select("bangla", F.explode("etymology_templates").alias("t")).where(F.col("t.name").isin(*TEMPLATES) & (F.col("t.args")["2"] == "en"))
    named = named.select(F.col("t.args")["3"].alias("english"), "bangla", F.concat(F.lit("template:"), "t.name").alias("evidence"))
    said = [df.select(F.explode(F.regexp_extract_all("etymology_text", F.lit(p), F.lit(1))).alias("english"), "bangla", F.lit(e).alias("evidence")) for p, e in ((BORROWED, "text:borrowed"), (WRITTEN, "text:translit"))]
    told = said[0].unionByName(said[1]).withColumn("english", F.translate("english", "’", "'"))
    return named.unionByName(told)


def loanword_bank(spark: SparkSession, path: str) -> DataFrame:
    """(english, bangla, evidence) of a CSV file with columns L2_orth and L2_etym."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    return df.select(F.col("L2_etym").alias("english"), F.trim("L2_orth").alias("bangla"), F.lit("bank:etym").alias("evidence"))


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """(english, sounds) of a pronouncing dictionary: lines of a word, perhaps numbered in brackets, and its sounds; ;;; begins a comment."""
    cut = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith(";;;")).select(F.lower(F.regexp_replace(cut[0], r"\(\d+\)$", "")).alias("english"), F.array_join(F.slice(cut, F.lit(2), F.greatest(F.lit(0), F.size(cut) - 1)), " ").alias("sounds"))
    return rows.where((F.col("sounds") != "") & F.col("english").rlike("^[a-z]+$"))
