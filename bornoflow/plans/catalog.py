"""The registered queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no Bangla, so corpus queries take Latin words; the same operators take the Bangla tokeniser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import corpus, lexicon, ngrams, nextword, packed
from .tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentence_rows(table(spark, sf_dir, "documents"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_sentences(sentences(spark, sf_dir))


VOCAB, MIN_COUNT = 32_768, 3
#: Held out for evaluation: the sentences of one document of ten. All others train.
FOLDS = 10


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept sentences in ids, worked out once."""
    own = written(kept(spark, sf_dir), "kept")
    return written(corpus.encode(own, corpus.vocabulary(own, VOCAB, MIN_COUNT)), "encoded")


def folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The encoded sentences to train on, and those held out; the vocabulary is of the former."""
    own = written(kept(spark, sf_dir), "kept")
    held = F.pmod("document_id", F.lit(FOLDS)) == 0
    every = written(corpus.encode(own, corpus.vocabulary(own.where(~held), VOCAB, MIN_COUNT)), "encoded")
    return every.where(~held), every.where(held)


# The SQL's common parts, each a list of named steps.
MASKED = r"regexp_replace(regexp_replace(text, '(\p{Nd})\.', '\1' || chr(1), 'g'), '\.(\p{Nd})', chr(1) || '\1', 'g')"
PARTS = rf"string_split_regex({MASKED}, '[।!?]+|\.|[\r\n]+')"
S_CHUNKS = rf"""
parts AS (SELECT doc_id, source, unnest({PARTS}) AS part, generate_subscripts({PARTS}, 1) AS pi FROM documents),
toks AS (SELECT doc_id, source, pi, regexp_extract_all(lower(part), '\p{{L}}+') AS t FROM parts),
chunks AS (SELECT doc_id, source, pi, k, t[k * 64 + 1 : k * 64 + 64] AS tokens FROM (SELECT *, unnest(range(0, (len(t) + 63) // 64)) AS k FROM toks WHERE len(t) >= 2)),
sents AS (SELECT source, doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pi, k) AS INTEGER) AS sentence_id, tokens FROM chunks WHERE len(tokens) >= 2)"""
S_KEPT = S_CHUNKS + """,
kept AS (SELECT a.source, a.document_id, a.sentence_id, tokens FROM (SELECT tokens, min({'source': source, 'document_id': document_id, 'sentence_id': sentence_id}) AS a FROM sents GROUP BY tokens))"""
S_VOCAB = S_KEPT + f""",
words AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM kept) GROUP BY 1 HAVING count(*) >= {MIN_COUNT}),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS token_id, token, n AS frequency FROM (SELECT * FROM words ORDER BY n DESC, token LIMIT {VOCAB - 3}))"""
S_COUNTED = """,
enc AS (SELECT source, document_id, sentence_id, pos, coalesce(token_id, 2) AS id FROM (SELECT source, document_id, sentence_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kept) LEFT JOIN vocab USING (token)
  UNION ALL SELECT source, document_id, sentence_id, 0, 1 FROM kept),
g AS (SELECT source, document_id, sentence_id, pos, id, lag(id) OVER w AS p1, lag(id, 2) OVER w AS p2, lag(id, 3) OVER w AS p3 FROM enc WINDOW w AS (PARTITION BY document_id, sentence_id ORDER BY pos)),
n1 AS (SELECT id AS token_id, CAST(count(*) AS BIGINT) AS count FROM g WHERE id > 2 GROUP BY ALL),
n2 AS (SELECT p1 AS c1, id AS token_id, CAST(count(*) AS BIGINT) AS count FROM g WHERE id > 2 AND p1 NOT IN (0, 2) GROUP BY ALL),
n3 AS (SELECT p2 AS c1, p1 AS c2, id AS token_id, CAST(count(*) AS BIGINT) AS count FROM g WHERE id > 2 AND p1 NOT IN (0, 2) AND p2 NOT IN (0, 2) GROUP BY ALL),
n4 AS (SELECT p3 AS c1, p2 AS c2, p1 AS c3, id AS token_id, CAST(count(*) AS BIGINT) AS count FROM g WHERE id > 2 AND p1 NOT IN (0, 2) AND p2 NOT IN (0, 2) AND p3 NOT IN (0, 2) GROUP BY ALL)"""
S_ENC = S_VOCAB + S_COUNTED
#: The same with the vocabulary and the counts of the sentences to train on, and all sentences in g.
S_HELD = S_VOCAB.replace("FROM kept)", f"FROM kept WHERE document_id % {FOLDS} <> 0)") + S_COUNTED.replace("FROM g WHERE", f"FROM g WHERE document_id % {FOLDS} <> 0 AND")
LOGP = "CAST(round_even(ln(greatest(least({p}, 1.0), 1e-12)) * 1e6, 0) AS BIGINT)"


@query(rf"SELECT doc_id, CAST(len(list_filter(list_transform({PARTS}, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')) AS INTEGER) AS sentences, array_to_string(list_filter(list_transform({PARTS}, lambda s: replace(trim(regexp_replace(s, '\s+', ' ', 'g')), chr(1), '.')), lambda s: s <> ''), '|') AS joined FROM documents")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("sentences"), F.array_join(s, "|").alias("joined"))


@query(f"WITH {S_CHUNKS} SELECT source, document_id, sentence_id, array_to_string(tokens, ' ') AS tokens FROM sents")
def sentence_chunks(spark, sf_dir):
    return sentences(spark, sf_dir).withColumn("tokens", F.array_join("tokens", " "))


@query(f"WITH {S_KEPT} SELECT source, document_id, sentence_id, array_to_string(tokens, ' ') AS tokens FROM kept")
def sentence_dedup(spark, sf_dir):
    return kept(spark, sf_dir).withColumn("tokens", F.array_join("tokens", " "))


@query(f"""WITH {S_KEPT},
a AS (SELECT source, count(DISTINCT document_id) AS documents, count(*) AS sentences FROM sents GROUP BY 1),
b AS (SELECT source, count(*) AS emitted_sentences, CAST(sum(len(tokens)) AS BIGINT) AS emitted_tokens FROM kept GROUP BY 1)
SELECT source, documents, sentences, coalesce(emitted_sentences, 0) AS emitted_sentences, coalesce(emitted_tokens, 0) AS emitted_tokens, sentences - coalesce(emitted_sentences, 0) AS duplicate_sentences FROM a LEFT JOIN b USING (source)""")
def sentence_stats_by_source(spark, sf_dir):
    s = sentences(spark, sf_dir)
    return corpus.source_stats(s, corpus.dedup_sentences(s))


@query(f"""WITH {S_KEPT}, b AS (SELECT document_id, count(*) AS emitted_sentences, CAST(sum(len(tokens)) AS BIGINT) AS emitted_tokens FROM kept GROUP BY 1)
SELECT doc_id AS document_id, d.source, CAST(octet_length(encode(text)) AS BIGINT) AS source_bytes, coalesce(emitted_sentences, 0) AS emitted_sentences, coalesce(emitted_tokens, 0) AS emitted_tokens FROM documents d LEFT JOIN b ON doc_id = document_id""")
def document_stats(spark, sf_dir):
    return corpus.document_stats(table(spark, sf_dir, "documents"), kept(spark, sf_dir))


S_SCAN = r"""pieces AS (SELECT doc_id, regexp_extract_all(text, '(?:[\^:]|,,|[\p{L}\p{N}])+|\.{2,}|(?s:.)') AS p FROM documents),
rows_ AS (SELECT doc_id, unnest(p) AS content, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS idx FROM pieces),
typed AS (SELECT *, CASE WHEN regexp_matches(content, '^\p{N}+$') THEN 'Number' WHEN regexp_matches(content, '^(?:[\^:]|,,|[\p{L}\p{N}])+$') THEN 'Word' WHEN regexp_matches(content, '^[\s\p{Z}]$') THEN 'Whitespace'
  WHEN regexp_matches(content, '^\.+$|^[!-#%-*,\-/:;?@\[\]\\_{}।]$') THEN 'Punctuation' ELSE 'Symbol' END AS token_type FROM rows_)"""


@query(f"WITH {S_SCAN} SELECT doc_id, idx, content, token_type, CAST(coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM typed")
def token_scan(spark, sf_dir):
    """The SQL's regular expressions can't follow combining marks and backticks; the tables hold none."""
    return corpus.scan_rows(table(spark, sf_dir, "documents"))


@query(f"WITH {S_SCAN} SELECT token_type, count(*) AS tokens, count(DISTINCT content) AS distinct_tokens FROM typed GROUP BY 1")
def token_type_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(T.scan_pieces(F.col("text"))).alias("content"))
    return rows.groupBy(T.piece_type(F.col("content")).alias("token_type")).agg(F.count("*").alias("tokens"), F.count_distinct("content").alias("distinct_tokens"))


SQL_ALLOWED = r"\s0-9A-Za-z\x{0980}-\x{09FF}।\x{200C}\x{200D}.,;:!?''\"()\[\]{}<>\-_+=*&\^%$#@/\\|`"


@query(f"SELECT doc_id, NOT regexp_matches(text, '[^{SQL_ALLOWED}]') AS valid FROM documents")
def sanitize_valid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_valid(F.col("text")).alias("valid"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '[^{SQL_ALLOWED}]', '', 'g')) AS cleaned FROM documents")
def sanitize_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^{SQL_ALLOWED}]'))), '') AS chars FROM documents")
def invalid_char_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.invalid_chars(F.col("text")).alias("chars"))


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') AS bangla FROM orders")
def digit_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.digits(F.col("o_orderkey").cast("string")).alias("bangla"))


@query("SELECT doc_id, md5(translate(text, '.$', '।৳')) AS mapped FROM documents")
def symbol_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.symbols(F.col("text")).cast("binary")).alias("mapped"))


def S_SKIPPED(name: str, end: str) -> str:
    return rf"(?is)<\s*(?:[^\s/>:]*:)?{name}(?:[\s/][^>]*)?>.*?{end}"


S_CLOSED = "|".join(S_SKIPPED(n, rf"<\s*/\s*(?:[^\s/>:]*:)?{n}(?:[\s/][^>]*)?>") for n in ("script", "style"))
S_HTML = rf"""raw AS (SELECT page_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '{S_CLOSED}', '<><>', 'g'), '{S_SKIPPED("(?:script|style)", chr(92) + "z")}', '<>', 'g'), '<[^>]*>|<(?s:.*)|&[^;]{{0,32}};|&|[^<&]+') AS p FROM pages)),
named AS (SELECT *, CASE WHEN p LIKE '&%;' THEN p[2:-2] END AS e, CASE WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]{{1,8}};$') THEN CAST('0x' || p[4:-2] AS BIGINT) WHEN regexp_matches(p, '^&#[0-9]{{1,10}};$') THEN CAST(p[3:-2] AS BIGINT) END AS n FROM raw),
txt AS (SELECT page_id, string_agg(CASE WHEN p LIKE '<%>' THEN ' ' WHEN p LIKE '<%' THEN '' WHEN e IS NULL AND p = '&' THEN ' ' WHEN e IS NULL THEN p WHEN octet_length(encode(p)) > 34 THEN ' ' || p[2:]
  WHEN e = 'amp' THEN '&' WHEN e = 'lt' THEN '<' WHEN e = 'gt' THEN '>' WHEN e = 'quot' THEN chr(34) WHEN e = 'apos' THEN chr(39) WHEN n <= 1114111 AND n NOT BETWEEN 55296 AND 57343 THEN chr(CAST(n AS INTEGER)) ELSE ' ' END, '' ORDER BY i) AS t FROM named GROUP BY 1)"""


@query(f"WITH {S_HTML} SELECT page_id, md5(coalesce(t, '')) AS digest, CAST(length(coalesce(t, '')) AS INTEGER) AS chars FROM pages LEFT JOIN txt USING (page_id)")
def html_to_text(spark, sf_dir):
    out = T.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("chars"))


S_FREQ = r"freq AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY 1)"
S_PAGE = r"pfreq AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(html), '\p{L}+')) AS word FROM pages) GROUP BY 1)"


def _lexicons(spark, sf_dir):
    return lexicon.frequencies(table(spark, sf_dir, "documents")).unionByName(lexicon.frequencies(table(spark, sf_dir, "pages"), text="html"))


@query(f"WITH {S_FREQ} SELECT * FROM freq WHERE frequency >= 2 ORDER BY frequency DESC, word LIMIT 5000")
def word_frequency(spark, sf_dir):
    return lexicon.frequencies(table(spark, sf_dir, "documents"), min_frequency=2, max_entries=5000)


@query(f"WITH {S_FREQ}, {S_PAGE} SELECT word, CAST(sum(frequency) AS BIGINT) AS frequency FROM (SELECT * FROM freq UNION ALL SELECT * FROM pfreq) GROUP BY 1 HAVING sum(frequency) >= 3")
def lexicon_merge_sum(spark, sf_dir):
    return lexicon.merge_sum(_lexicons(spark, sf_dir), 3)


@query(f"WITH {S_FREQ}, {S_PAGE} SELECT word, max(frequency) AS frequency FROM (SELECT * FROM freq UNION ALL SELECT * FROM pfreq) WHERE word <> '' GROUP BY 1")
def lexicon_merge_max(spark, sf_dir):
    return lexicon.merge_max(_lexicons(spark, sf_dir))


@query(f"""WITH {S_FREQ}, {S_PAGE}, x AS (SELECT *, regexp_matches(word, '^[a-z]+$') AS ok FROM (SELECT * FROM freq UNION ALL SELECT * FROM pfreq))
SELECT count(*) AS rows, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, count(DISTINCT word) FILTER (ok) AS unique_words, CAST(coalesce(sum(frequency) FILTER (ok), 0) AS BIGINT) AS total_frequency, max(frequency) FILTER (ok) AS max_frequency FROM x""")
def lexicon_audit(spark, sf_dir):
    return lexicon.audit(_lexicons(spark, sf_dir), F.col("word").rlike("^[a-z]+$"))


@query(f"WITH {S_FREQ} SELECT count(*) AS entries, CAST(sum(frequency) AS BIGINT) AS total_frequency, max(frequency) AS max_frequency, max(length(word)) AS longest_word FROM freq")
def lexicon_statistics(spark, sf_dir):
    return lexicon.statistics(lexicon.frequencies(table(spark, sf_dir, "documents")))


S_CURATE = r"""src AS (SELECT source, word, count(*) AS frequency FROM (SELECT source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL),
loan AS (SELECT DISTINCT lower(unnest(regexp_extract_all(p_name, '\p{L}+'))) AS word FROM part),
n AS (SELECT word, count(DISTINCT source) AS k FROM src GROUP BY 1),
cur AS (SELECT src.*, CASE WHEN NOT regexp_matches(word, '^\p{L}+$') THEN 'invalid_bangla_token' WHEN regexp_matches(word, '""" + T.CORRUPT + r"""') THEN 'obvious_corruption_shape'
  WHEN frequency > 2 OR k > 1 OR loan.word IS NOT NULL OR (source = 'src0' AND (frequency = 2 AND length(word) <= 14 OR frequency = 1 AND length(word) <= 10)) OR (source = 'src1' AND frequency = 2 AND length(word) <= 12) THEN NULL ELSE 'unsupported_low_frequency' END AS reason
  FROM src JOIN n USING (word) LEFT JOIN loan USING (word))"""


def _curation(spark, sf_dir):
    """The tables' Latin words by the rule for Bangla ones, but for the grammar; two of their sources take the parts of books and wiki."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", F.explode(T.latin_tokens(F.col("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("frequency"))
    loans = table(spark, sf_dir, "part").select(F.explode(T.latin_tokens(F.col("p_name"))).alias("word"))
    rare = {"src0": lexicon.RARE_LENGTHS["epub"], "src1": lexicon.RARE_LENGTHS["wiki"]}
    return lexicon.curation(rows, loans, lambda w: w.rlike(r"^\p{L}+$"), rare)


@query(f"WITH {S_CURATE} SELECT source, word, frequency FROM cur WHERE reason IS NULL")
def lexicon_curate_keep(spark, sf_dir):
    return _curation(spark, sf_dir).where("reason is null").drop("reason", "decision")


@query(f"WITH {S_CURATE} SELECT source, word, frequency, reason, CASE reason WHEN 'unsupported_low_frequency' THEN 'quarantine' ELSE 'drop' END AS decision FROM cur WHERE reason IS NOT NULL")
def lexicon_quarantine(spark, sf_dir):
    return _curation(spark, sf_dir).where("reason is not null")


S_KEYED = r"""k AS (SELECT DISTINCT l, trim(regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[.,;:()\[\]{}"“”‘’]+|[.,;:()\[\]{}"“”‘’]+$', '', 'g'), '\s+', ' ', 'g'), '') AS key FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations))"""


@query(rf"WITH {S_KEYED} SELECT l AS line, CASE WHEN regexp_matches(key, '^[A-Za-z][A-Za-z .''\-]{{0,80}}$') AND lower(key) NOT IN ('english', 'middle english', 'old english') THEN lower(key) END AS english FROM k")
def english_keys(spark, sf_dir):
    """The loanword keys that the lines of conversations would be."""
    from ..operators import loanmining

    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", loanmining.english_key(F.col("line")).alias("english"))


@query(f"""WITH {S_FREQ}, x AS (SELECT word, frequency, left(word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER)) AS prefix FROM freq)
SELECT prefix, CAST(rank AS INTEGER) AS rank, word, frequency FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY frequency DESC, word) AS rank FROM x) WHERE rank <= 8""")
def prefix_top8(spark, sf_dir):
    return lexicon.prefix_index(lexicon.frequencies(table(spark, sf_dir, "documents")), units=F.regexp_extract_all("word", F.lit(r"[\s\S]"), F.lit(0)))


@query(f"""WITH {S_FREQ}, q AS (SELECT DISTINCT left(lower(p_name), 2) AS query FROM part),
x AS (SELECT query, word, frequency, row_number() OVER (PARTITION BY query ORDER BY word) AS rank FROM q JOIN freq ON starts_with(word, query))
SELECT query, CAST(rank AS INTEGER) AS rank, word, frequency FROM x WHERE rank <= 8""")
def prefix_first_n(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(F.substring(F.lower("p_name"), 1, 2).alias("query"))
    return lexicon.complete(queries, lexicon.frequencies(table(spark, sf_dir, "documents")))


def _part_words(spark, sf_dir):
    return lexicon.frequencies(table(spark, sf_dir, "part"), text="p_name")


S_PART = S_FREQ + r", pw AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(p_name), '\p{L}+')) AS word FROM part) GROUP BY 1)"
#: The SQL's distance counts bytes: letters outside ASCII become capitals, which lower-cased words don't hold.
BYTES = "translate({}, 'äöüßéèêçñóíáúàùâîôûëï', 'ABCDEFGHIJKLMNOPQRSTU')"


def _fuzzy_sql(d: int) -> str:
    apart = f"levenshtein({BYTES.format('a.word')}, {BYTES.format('b.word')})"
    return f"WITH {S_PART} SELECT a.word AS left_word, b.word AS right_word, CAST({apart} AS INTEGER) AS distance FROM pw a JOIN freq b ON abs(length(a.word) - length(b.word)) <= {d} AND {apart} <= {d}"


@query(_fuzzy_sql(1))
def fuzzy_join_d1(spark, sf_dir):
    """All words of part names against all words of documents."""
    return lexicon.fuzzy_join(_part_words(spark, sf_dir), lexicon.frequencies(table(spark, sf_dir, "documents")), 1)


@query(_fuzzy_sql(2))
def fuzzy_join_d2(spark, sf_dir):
    return lexicon.fuzzy_join(_part_words(spark, sf_dir), lexicon.frequencies(table(spark, sf_dir, "documents")), 2)


SKELETON = "word"
for _p, _s in (("ph", "f"), ("gh", "g"), ("ck", "k"), ("sch|sh|ch", "s"), ("th", "t"), ("qu", "kw"), ("x", "ks"), ("c([eiy])", r"s\1"), ("c|q", "k"), ("z", "j"), ("v", "b"), ("[aeiouyhw]", "")):
    SKELETON = f"regexp_replace({SKELETON}, '{_p}', '{_s}', 'g')"
for _c in "bdfgjklmnprstäöüßéèêçñóíáú":
    SKELETON = f"regexp_replace({SKELETON}, '{_c}+', '{_c}', 'g')"


@query(f"""WITH {S_PART}, l AS (SELECT word, {SKELETON} AS sk FROM pw), r AS (SELECT word, frequency, {SKELETON} AS sk FROM freq), p AS (SELECT l.word AS left_word, r.word AS right_word, r.frequency FROM l JOIN r ON l.sk = r.sk AND l.word <> r.word WHERE length(l.sk) BETWEEN 2 AND 12)
SELECT left_word, right_word, frequency, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_word ORDER BY frequency DESC, right_word) AS rank FROM p) WHERE rank <= 16""")
def skeleton_join(spark, sf_dir):
    return lexicon.skeleton_join(_part_words(spark, sf_dir), lexicon.frequencies(table(spark, sf_dir, "documents")))


@query(f"WITH {S_VOCAB} SELECT * FROM vocab UNION ALL VALUES (0, '<pad>', 0), (1, '<bos>', 0), (2, '<unk>', 0)")
def vocab_topn(spark, sf_dir):
    return corpus.vocabulary(kept(spark, sf_dir), VOCAB, MIN_COUNT)


@query(f"WITH {S_VOCAB}, a AS (SELECT unnest(tokens) AS token FROM kept) SELECT count(*) AS total_tokens, count(token_id) AS covered_tokens, count(token_id) / count(*) AS coverage FROM a LEFT JOIN vocab USING (token)")
def vocab_coverage(spark, sf_dir):
    k = kept(spark, sf_dir)
    return corpus.coverage(k, corpus.vocabulary(k, VOCAB, MIN_COUNT))


@query(f"WITH {S_ENC} SELECT source, document_id, sentence_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM enc GROUP BY ALL")
def encode_tokens(spark, sf_dir):
    return encoded(spark, sf_dir).select("source", "document_id", "sentence_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"""WITH {S_KEPT}, o AS (SELECT source, document_id, sentence_id, row_number() OVER (PARTITION BY source ORDER BY document_id, sentence_id) - 1 AS ordinal FROM kept)
SELECT source, document_id, sentence_id, ordinal, CASE WHEN ordinal < 100000 THEN 'train' WHEN ordinal < 125000 THEN 'eval' END AS split FROM o""")
def source_split(spark, sf_dir):
    return corpus.split(kept(spark, sf_dir)).drop("tokens")


@query(f"WITH {S_ENC} SELECT * FROM n1")
def unigrams(spark, sf_dir):
    return ngrams.counts(encoded(spark, sf_dir), 1)


@query(f"WITH {S_ENC} SELECT * FROM n2")
def bigrams(spark, sf_dir):
    return ngrams.counts(encoded(spark, sf_dir), 2)


@query(f"WITH {S_ENC} SELECT * FROM n3")
def trigrams(spark, sf_dir):
    return ngrams.counts(encoded(spark, sf_dir), 3)


@query(f"WITH {S_ENC} SELECT * FROM n4")
def fourgrams(spark, sf_dir):
    return ngrams.counts(encoded(spark, sf_dir), 4)


@query(f"WITH {S_ENC} SELECT p1 AS c1, id AS token_id, CAST(sum(CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END) AS BIGINT) AS count FROM g WHERE id > 2 AND p1 NOT IN (0, 2) GROUP BY ALL")
def weighted_bigrams(spark, sf_dir):
    return ngrams.counts(encoded(spark, sf_dir), 2, corpus.source_weight({"src0": 3, "src1": 2}))


S_STATS = "CAST(sum(count) AS BIGINT) AS total, count(*) AS distinct_tokens, count(*) FILTER (count = 1) AS singletons, count(*) FILTER (count = 2) AS doubletons, count(*) FILTER (count >= 3) AS high"


@query(f"WITH {S_ENC} SELECT c1, c2, {S_STATS} FROM n3 GROUP BY ALL")
def context_stats(spark, sf_dir):
    return ngrams.context_stats(ngrams.counts(encoded(spark, sf_dir), 3), 3)


@query(f"WITH {S_ENC} SELECT CAST(least(count, 4) AS INTEGER) AS bucket, count(*) AS n FROM n2 GROUP BY ALL")
def count_histogram(spark, sf_dir):
    return ngrams.histogram(ngrams.counts(encoded(spark, sf_dir), 2))


@query(f"WITH {S_ENC} SELECT token_id, count(*) AS continuations FROM n2 GROUP BY ALL")
def continuation_counts(spark, sf_dir):
    return ngrams.continuation_counts(ngrams.counts(encoded(spark, sf_dir), 2))


def S_DISC(k: int) -> str:
    return f"""h{k} AS (SELECT count(*) FILTER (count = 1)::DOUBLE AS n1, count(*) FILTER (count = 2)::DOUBLE AS n2, count(*) FILTER (count = 3)::DOUBLE AS n3, count(*) FILTER (count >= 4)::DOUBLE AS n4 FROM n{k}),
r{k} AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM h{k}),
q{k} AS (SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN 1 - 2 * y * n2 / n1 END AS a, CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN 2 - 3 * y * n3 / n2 END AS b, CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 THEN 3 - 4 * y * n4 / n3 END AS c FROM r{k}),
disc{k} AS (SELECT CASE WHEN a > 0 AND a < 1 THEN a ELSE 0.75 END AS d1, CASE WHEN b > 0 AND b < 2 THEN b ELSE 0.75 END AS d2, CASE WHEN c > 0 AND c < 3 THEN c ELSE 0.75 END AS d3 FROM q{k})"""


@query(f"WITH {S_ENC}, {S_DISC(2)}, {S_DISC(3)} SELECT 2 AS gram, d1, d2, d3 FROM disc2 UNION ALL SELECT 3, d1, d2, d3 FROM disc3")
def kn_discounts(spark, sf_dir):
    e = encoded(spark, sf_dir)
    two, three = (ngrams.discounts(ngrams.counts(e, k)).select(F.lit(k).alias("gram"), "d1", "d2", "d3") for k in (2, 3))
    return two.unionByName(three)


def _tables(spark, sf_dir, highest: int):
    e = encoded(spark, sf_dir)
    return {k: ngrams.counts(e, k) for k in range(1, highest + 1)}


P1 = "(SELECT n1.token_id, CASE WHEN k.n > 0 THEN k.n / (SELECT count(*) FROM n2) ELSE n1.count / (SELECT sum(count) FROM n1) END AS p FROM n1 LEFT JOIN (SELECT token_id, count(*) AS n FROM n2 GROUP BY 1) k USING (token_id))"


def S_KN(k: int, modified: bool) -> str:
    ctx = ", ".join(f"c{i}" for i in range(1, k))
    low = P1 if k == 2 else f"p{k - 1}"
    on = " AND ".join([f"w.c{i + 1} = l.c{i}" for i in range(1, k - 1)] + ["w.token_id = l.token_id"])
    mass = "d1 * s + d2 * b + d3 * h" if modified else "0.75 * n"
    off = "CASE WHEN w.count = 1 THEN d1 WHEN w.count = 2 THEN d2 ELSE d3 END" if modified else "0.75"
    return (f"{S_DISC(k)}, " if modified else "") + f"""w{k} AS (SELECT *, sum(count) OVER v AS total, count(*) OVER v AS n, count(*) FILTER (count = 1) OVER v AS s, count(*) FILTER (count = 2) OVER v AS b, count(*) FILTER (count >= 3) OVER v AS h FROM n{k} WINDOW v AS (PARTITION BY {ctx})),
p{k} AS (SELECT {", ".join(f"w.c{i}" for i in range(1, k))}, w.token_id, w.count, greatest(w.count - {off}, 0)::DOUBLE / total + ({mass})::DOUBLE / total * coalesce(l.p, 0) AS p FROM w{k} w {f"CROSS JOIN disc{k}" if modified else ""} LEFT JOIN {low} l ON {on})"""


@query(f"WITH {S_ENC} SELECT c1, token_id, n2.count, {LOGP.format(p='(n2.count + 0.5::DOUBLE * (n1.count / (SELECT sum(count) FROM n1))) / (sum(n2.count) OVER (PARTITION BY c1) + 0.5::DOUBLE)')} AS score FROM n2 JOIN n1 USING (token_id)")
def score_smoothed(spark, sf_dir):
    return ngrams.scored(_tables(spark, sf_dir, 2), 2, "smoothed-log")


@query(f"WITH {S_ENC} SELECT c1, c2, token_id, count, {LOGP.format(p='count / (sum(count) OVER (PARTITION BY c1, c2)) * 0.4::DOUBLE')} AS score FROM n3")
def score_stupid_backoff(spark, sf_dir):
    return ngrams.scored(_tables(spark, sf_dir, 3), 3, "stupid-backoff")


@query(f"WITH {S_ENC}, {S_KN(2, False)} SELECT c1, token_id, count, {LOGP.format(p='p')} AS score FROM p2")
def score_kn2(spark, sf_dir):
    return packed.kneser_ney(encoded(spark, sf_dir), 2, False, write=written)


@query(f"WITH {S_ENC}, {S_KN(2, False)}, {S_KN(3, False)} SELECT c1, c2, token_id, count, {LOGP.format(p='p')} AS score FROM p3")
def score_kn3(spark, sf_dir):
    return packed.kneser_ney(encoded(spark, sf_dir), 3, False, write=written)


@query(f"WITH {S_ENC}, {S_KN(2, True)}, {S_KN(3, True)} SELECT c1, c2, token_id, count, {LOGP.format(p='p')} AS score FROM p3")
def score_mkn3(spark, sf_dir):
    return packed.kneser_ney(encoded(spark, sf_dir), 3, True, write=written)


@query(f"WITH {S_ENC}, {S_KN(2, True)}, {S_KN(3, True)}, {S_KN(4, True)} SELECT c1, c2, c3, token_id, count, {LOGP.format(p='p')} AS score FROM p4")
def score_mkn4(spark, sf_dir):
    return packed.kneser_ney(encoded(spark, sf_dir), 4, True, write=written)


@query(f"WITH {S_ENC}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY c1, c2 ORDER BY count DESC, token_id) AS INTEGER) AS rank FROM n3 WHERE count >= 2) SELECT c1, c2, token_id, count, count AS score, rank FROM t WHERE rank <= 16")
def topk_per_context(spark, sf_dir):
    return ngrams.top_candidates(ngrams.scored(_tables(spark, sf_dir, 3), 3, "count"), 3, 16, 2)


@query(f"WITH {S_ENC} SELECT token_id, count, count AS score, CAST(row_number() OVER (ORDER BY count DESC, token_id) AS INTEGER) AS rank FROM n1 ORDER BY rank LIMIT 16")
def unigram_topk(spark, sf_dir):
    return ngrams.top_candidates(ngrams.scored(_tables(spark, sf_dir, 1), 1, "count"), 1, 16)


S_POS = """, pos AS (SELECT source, document_id, sentence_id, CAST(pos AS INTEGER) AS idx, CASE WHEN pos = 1 THEN 1 WHEN p1 > 2 THEN p1 END AS c3, CASE WHEN p1 > 2 AND p2 > 2 THEN p2 END AS c2, CASE WHEN p1 > 2 AND p2 > 2 AND p3 > 2 THEN p3 END AS c1, id AS target FROM g WHERE pos >= 1)"""


@query(f"WITH {S_ENC}{S_POS} SELECT * FROM pos")
def context_reset(spark, sf_dir):
    return nextword.positions(encoded(spark, sf_dir))


@query(f"""WITH {S_ENC}, l AS (SELECT source, document_id, sentence_id, list(id ORDER BY pos) AS ids FROM enc GROUP BY ALL), i AS (SELECT *, unnest(range(1, len(ids))) AS i FROM l)
SELECT source, document_id, sentence_id, CAST(i AS INTEGER) AS idx, ids[i + 1] AS target, array_to_string(list_concat(list_transform(range(0, greatest(0, 8 - i)), lambda x: 0), list_transform(ids[greatest(1, i - 7) : i], lambda x: CAST(x AS BIGINT))), ' ') AS input FROM i""")
def padded_context(spark, sf_dir):
    return nextword.model_input(encoded(spark, sf_dir)).withColumn("input", F.array_join(F.col("input").cast("array<string>"), " "))


def S_RANKED(k: int = 16) -> str:
    out = []
    for o in (4, 3, 2, 1):
        ctx = ", ".join(f"c{i}" for i in range(1, o))
        out.append(f"t{o} AS (SELECT * FROM (SELECT *, row_number() OVER ({f'PARTITION BY {ctx}' if ctx else ''} ORDER BY count DESC, token_id) AS rank FROM n{o}) WHERE rank <= {k})")
        out.append(f"l{o} AS (SELECT {ctx + ', ' if ctx else ''}list(token_id ORDER BY rank) AS l, list(count ORDER BY rank) AS n FROM t{o} GROUP BY ALL)")
    return ",\n".join(out)


S_LOOKED = ",\n" + S_RANKED() + """,
ctx AS (SELECT DISTINCT c1, c2, c3 FROM pos),
look AS (SELECT ctx.*, coalesce(a.l, []) AS a4, coalesce(b.l, []) AS a3, coalesce(c.l, []) AS a2, d.l AS a1, coalesce(a.n, []) AS m4, coalesce(b.n, []) AS m3, coalesce(c.n, []) AS m2, d.n AS m1,
  CASE WHEN ctx.c1 IS NOT NULL THEN 3 WHEN ctx.c2 IS NOT NULL THEN 2 WHEN ctx.c3 IS NOT NULL THEN 1 ELSE 0 END AS len
  FROM ctx LEFT JOIN l4 a ON a.c1 = ctx.c1 AND a.c2 = ctx.c2 AND a.c3 = ctx.c3 LEFT JOIN l3 b ON b.c1 = ctx.c2 AND b.c2 = ctx.c3 LEFT JOIN l2 c ON c.c1 = ctx.c3 CROSS JOIN l1 d)"""


S_LOOK = S_ENC + S_POS + S_LOOKED
S_POS_HELD = S_POS.replace("FROM g WHERE", f"FROM g WHERE document_id % {FOLDS} = 0 AND")


def S_FILL(c4: str, c3: str, c2: str, name: str = "sug") -> str:
    return f"""f4 AS (SELECT *, a4[1:{c4}] AS o4 FROM look),
f3 AS (SELECT *, list_concat(o4, list_filter(a3, lambda x: NOT list_contains(o4, x))[1:greatest(0, {c3} - len(o4))]) AS o3 FROM f4),
f2 AS (SELECT *, list_concat(o3, list_filter(a2, lambda x: NOT list_contains(o3, x))[1:greatest(0, {c2} - len(o3))]) AS o2 FROM f3),
{name} AS (SELECT c1, c2, c3, list_concat(o2, list_filter(a1, lambda x: NOT list_contains(o2, x))[1:greatest(0, 10 - len(o2))]) AS ids FROM f2)"""


S_BACKOFF = S_LOOK + ",\n" + S_FILL("10", "10", "10")
IDS = "array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ' ') AS ids"


def _suggest(spark, sf_dir, policy):
    return packed.suggestions(encoded(spark, sf_dir), policy)


@query(f"WITH {S_BACKOFF} SELECT c1, c2, c3, {IDS} FROM sug")
def next_word_backoff(spark, sf_dir):
    return _suggest(spark, sf_dir, "backoff")


# limit 10: reserves 8, 4, 2 with three words of context, 8, 2 with two, 2 with one
@query(f"WITH {S_LOOK}, {S_FILL('1', 'CASE WHEN len = 3 THEN 4 ELSE 1 END', 'CASE WHEN len = 3 THEN 8 WHEN len = 2 THEN 8 ELSE 8 END')} SELECT c1, c2, c3, {IDS} FROM sug")
def reserved_caps(spark, sf_dir):
    return _suggest(spark, sf_dir, "reserved")


@query(f"""WITH {S_LOOK}, u AS (SELECT c1, c2, c3, len, unnest(list_concat(a4, a3, a2, a1)) AS t, unnest(list_concat(m4, m3, m2, m1)) AS n,
  unnest(list_concat(list_transform(a4, lambda x: 4), list_transform(a3, lambda x: 3), list_transform(a2, lambda x: 2), list_transform(a1, lambda x: 1))) AS o FROM look),
b AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3, t ORDER BY n DESC, o DESC) AS k FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY n DESC, o DESC, t) AS r FROM b WHERE k = 1)
SELECT c1, c2, c3, string_agg(t, ' ' ORDER BY r) AS ids FROM r WHERE r <= 10 GROUP BY ALL""")
def next_word_merge(spark, sf_dir):
    return _suggest(spark, sf_dir, "merge")


def _eval(spark, sf_dir):
    return packed.evaluated(*folds(spark, sf_dir))


S_RANK = S_HELD + S_POS_HELD + S_LOOKED + ",\n" + S_FILL("10", "10", "10") + """,
rk AS (SELECT p.*, CASE WHEN target > 2 AND list_position(ids, target) > 0 THEN list_position(ids, target) END AS rank FROM pos p JOIN sug s ON p.c1 IS NOT DISTINCT FROM s.c1 AND p.c2 IS NOT DISTINCT FROM s.c2 AND p.c3 IS NOT DISTINCT FROM s.c3)"""
S_METRICS = "count(*) AS all_targets, count(*) FILTER (target > 2) AS targets, count(*) FILTER (target <= 2) AS unknown_targets, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS hits{k}, round(count(*) FILTER (rank <= {k}) / count(*) FILTER (target > 2), 6) AS top{k}, round(count(*) FILTER (rank <= {k}) / count(*), 6) AS top{k}_all_targets" for k in (1, 3, 5, 10)) + ", round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*) FILTER (target > 2), 6) AS mrr"


@query(f"WITH {S_RANK} SELECT {S_METRICS} FROM rk")
def eval_hits_mrr(spark, sf_dir):
    return nextword.metrics(_eval(spark, sf_dir))


@query(f"WITH {S_RANK} SELECT source, {S_METRICS} FROM rk GROUP BY source")
def eval_by_source(spark, sf_dir):
    return nextword.metrics(_eval(spark, sf_dir), "source")


@query(f"WITH {S_RANK}, b AS (SELECT *, CASE WHEN c3 = 1 THEN 'sentence_start' WHEN c1 IS NOT NULL THEN 'context_3' WHEN c2 IS NOT NULL THEN 'context_2' WHEN c3 IS NOT NULL THEN 'context_1' ELSE 'context_0' END AS context_bucket FROM rk) SELECT context_bucket, {S_METRICS} FROM b GROUP BY 1")
def eval_by_context(spark, sf_dir):
    return nextword.metrics(nextword.with_bucket(_eval(spark, sf_dir)), "context_bucket")


@query(f"WITH {S_RANK} SELECT target AS token_id, count(*) AS misses FROM rk WHERE target > 2 AND rank IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_missed(spark, sf_dir):
    return nextword.top_missed(_eval(spark, sf_dir))


@query(f"""WITH {S_HELD}{S_POS_HELD}, {S_RANKED(10)}, ctx AS (SELECT DISTINCT c1, c2, c3 FROM pos), f AS (SELECT ctx.*, coalesce(c.l, []) AS a2, d.l AS a1 FROM ctx LEFT JOIN l2 c ON c.c1 = ctx.c3 CROSS JOIN l1 d),
sug AS (SELECT c1, c2, c3, list_concat(a2, list_filter(a1, lambda x: NOT list_contains(a2, x))[1:greatest(0, 10 - len(a2))]) AS ids FROM f), rk AS (SELECT p.*, CASE WHEN target > 2 AND list_position(ids, target) > 0 THEN list_position(ids, target) END AS rank FROM pos p JOIN sug s ON p.c1 IS NOT DISTINCT FROM s.c1 AND p.c2 IS NOT DISTINCT FROM s.c2 AND p.c3 IS NOT DISTINCT FROM s.c3)
SELECT {S_METRICS}, 1 AS context_order FROM rk""")
def context_order_probe(spark, sf_dir):
    return nextword.metrics(packed.evaluated(*folds(spark, sf_dir), 2, 10)).withColumn("context_order", F.lit(1))


@query("""WITH t AS (SELECT conv_id AS user_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token_id, turn, generate_subscripts(regexp_extract_all(lower(text), '\\p{L}+'), 1) AS i FROM conversations),
r AS (SELECT user_id, token_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, i) AS n FROM t),
l AS (SELECT *, lag(token_id) OVER w AS a, lag(token_id, 2) OVER w AS b, lag(token_id, 3) OVER w AS c FROM r WINDOW w AS (PARTITION BY user_id ORDER BY n)),
k AS (SELECT *, CASE WHEN b IS NOT NULL THEN lag(n) OVER (PARTITION BY user_id, b, a, token_id ORDER BY n) END AS n3, CASE WHEN c IS NOT NULL THEN lag(n) OVER (PARTITION BY user_id, c, b, a, token_id ORDER BY n) END AS n4 FROM l)
SELECT user_id, CAST(n AS INTEGER) AS tick, token_id, coalesce(n3 - 2 >= n - 256, FALSE) OR coalesce(n4 - 3 >= n - 256, FALSE) AS repeats FROM k""")
def repetition_guard(spark, sf_dir):
    return nextword.repetition_guard(commits(spark, sf_dir))


def commits(spark, sf_dir):
    """(user_id, tick, token_id): the words of conversations as a user's stream of committed tokens."""
    from ..operators import personal

    return personal.committed(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "user_id"))


@query(f"WITH {S_FREQ} SELECT word, CAST(round(ln(frequency + 1) * 1024) AS BIGINT) AS frequency_score, CAST(floor(log2(frequency)) * 6 AS BIGINT) AS heap_score, CAST(round_even(log10(frequency + 1) * 600, 0) - 1000 AS BIGINT) AS skeleton_score FROM freq")
def frequency_scores(spark, sf_dir):
    f = F.col("frequency")
    return lexicon.frequencies(table(spark, sf_dir, "documents")).select("word", S.frequency_score(f).alias("frequency_score"), S.heap_frequency_score(f).alias("heap_score"), S.skeleton_score(F.lit(1), f).alias("skeleton_score"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, dedup, bigrams, and the three likeliest next words of each word."""
    k = kept(spark, sf_dir)
    pairs = k.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.get("tokens", i - 1).alias("word"), F.get("tokens", i).alias("next")))).alias("p"))
    counts = pairs.groupBy("p.word", "p.next").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy("word").orderBy(F.desc("n"), "next")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


# Personal store, policies, transliteration, autocorrect.
S_COMMITS = r"""cm AS (SELECT conv_id AS user_id, w AS token_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS tick FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '\p{L}+'), 1) AS i FROM conversations)),
lg AS (SELECT *, lag(token_id) OVER w AS b1, lag(token_id, 2) OVER w AS b2, lag(token_id, 3) OVER w AS b3 FROM cm WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
ob AS (SELECT user_id, tick, 0 AS context_len, '' AS context, token_id FROM lg UNION ALL SELECT user_id, tick, 1, b1, token_id FROM lg WHERE b1 IS NOT NULL
  UNION ALL SELECT user_id, tick, 2, b2 || ' ' || b1, token_id FROM lg WHERE b2 IS NOT NULL UNION ALL SELECT user_id, tick, 3, b3 || ' ' || b2 || ' ' || b1, token_id FROM lg WHERE b3 IS NOT NULL),
store AS (SELECT user_id, CAST(context_len AS INTEGER) AS context_len, context, token_id, count(*) AS count, CAST(max(tick) AS INTEGER) AS last_seen FROM ob GROUP BY ALL),
look AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, context_len, context ORDER BY count DESC, last_seen DESC, token_id) AS INTEGER) AS rank FROM store WHERE count >= 2)"""


@query(f"WITH {S_COMMITS} SELECT * FROM store")
def personal_counts(spark, sf_dir):
    from ..operators import personal

    return personal.entries(commits(spark, sf_dir))


@query(f"WITH {S_COMMITS} SELECT * FROM look WHERE rank <= 3")
def personal_topk(spark, sf_dir):
    from ..operators import personal

    return personal.lookup(personal.entries(commits(spark, sf_dir)))


@query(f"WITH {S_COMMITS} SELECT user_id, context_len, context, token_id, CAST(count // 2 AS BIGINT) AS count, last_seen FROM store WHERE count >= 2")
def personal_decay(spark, sf_dir):
    from ..operators import personal

    return personal.decay(personal.entries(commits(spark, sf_dir)))


@query(f"WITH {S_COMMITS}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, last_seen DESC, context_len DESC, context, token_id) AS r FROM store) SELECT user_id, context_len, context, token_id, count, last_seen FROM e WHERE r <= 4096")
def personal_evicted(spark, sf_dir):
    from ..operators import personal

    return personal.evicted(personal.entries(commits(spark, sf_dir)), 4096)


@query(f"""WITH {S_COMMITS}, tl AS (SELECT user_id, token_id, row_number() OVER (PARTITION BY user_id ORDER BY tick DESC) AS r FROM cm),
l AS (SELECT user_id, list(token_id ORDER BY r DESC) AS ts FROM tl WHERE r <= 3 GROUP BY 1), cx AS (SELECT user_id, CAST(k AS INTEGER) AS context_len, array_to_string(ts[len(ts) - k + 1 :], ' ') AS context FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS k FROM l)),
model AS (SELECT token_id, row_number() OVER (ORDER BY count(*) DESC, token_id) AS rank FROM cm GROUP BY 1 QUALIFY rank <= 5),
al AS (SELECT user_id, token_id, CASE WHEN context_len > 0 THEN 0 ELSE 2 END AS tier, -context_len AS a, rank AS b FROM cx JOIN look USING (user_id, context_len, context) WHERE rank <= 5 UNION ALL SELECT user_id, token_id, 1, 0, rank FROM (SELECT DISTINCT user_id FROM cx) CROSS JOIN model),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, token_id ORDER BY tier, a, b) AS k FROM al)
SELECT user_id, CAST(rank AS INTEGER) AS rank, token_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, a, b, token_id) AS rank FROM f WHERE k = 1) WHERE rank <= 5""")
def personal_merge(spark, sf_dir):
    from ..operators import personal

    c = commits(spark, sf_dir)
    from pyspark.sql import Window

    model = lexicon.frequencies(table(spark, sf_dir, "conversations"), max_entries=5).withColumnRenamed("word", "token_id")
    model = model.select("token_id", F.row_number().over(Window.orderBy(F.desc("frequency"), "token_id")).alias("rank"))
    return personal.merged(personal.current_contexts(c), personal.entries(c), model)


S_POOL = S_ENC + ", " + S_RANKED(10) + """,
st AS (SELECT c1 AS query, token_id, CAST(rank - 1 AS INTEGER) AS static_rank, count, 1 AS source_order, (token_id * 37 % 101) / 16.0::DOUBLE AS model_score FROM t2 WHERE rank <= 10),
ge AS (SELECT query, CAST((query * 7 + j * 13) % 500 + 3 AS INTEGER) AS token_id, CAST(j AS INTEGER) AS model_rank, ((query * 5 + j * 11) % 97) / 16.0::DOUBLE AS model_score FROM (SELECT DISTINCT query FROM st), range(0, 8) AS r(j))"""


def _pools(spark, sf_dir):
    """Candidates of words after each word, with made-up model scores in sixteenths: sums are exact."""
    ranked = ngrams.top_candidates(ngrams.counts(encoded(spark, sf_dir), 2).withColumn("score", F.col("count")), 2, 10)
    static = ranked.select(F.col("c1").alias("query"), "token_id", (F.col("rank") - 1).alias("static_rank"), "count", F.lit(1).alias("source_order"), ((F.col("token_id") * 37 % 101) / 16).alias("model_score"))
    gen = static.select("query").distinct().select("query", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("model_rank"))
    gen = gen.select("query", ((F.col("query") * 7 + F.col("model_rank") * 13) % 500 + 3).cast("int").alias("token_id"), "model_rank", ((F.col("query") * 5 + F.col("model_rank") * 11) % 97 / 16).alias("model_score"))
    return static, gen


@query(f"WITH {S_POOL}, r AS (SELECT *, model_score - 0.0625::DOUBLE * static_rank AS s FROM st) SELECT query, token_id, rank, s AS rerank_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN static_rank < 1 THEN 1e9 ELSE s END DESC, static_rank, token_id) AS INTEGER) AS rank FROM r) WHERE rank <= 5")
def rerank_locked(spark, sf_dir):
    from ..operators import policies

    return policies.rerank(_pools(spark, sf_dir)[0], 0.0625, 1, 5).select("query", "token_id", "rank", "rerank_score")


@query(f"""WITH {S_POOL}, a AS (SELECT query, token_id, CASE WHEN static_rank < 1 THEN 0 ELSE 2 END AS tier, static_rank AS r FROM st UNION ALL SELECT query, token_id, 1, model_rank FROM ge), f AS (SELECT query, token_id, min({{'tier': tier, 'r': r}}) AS pos FROM a GROUP BY ALL)
SELECT query, token_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, token_id) AS rank FROM f) WHERE rank <= 6""")
def merge_locked(spark, sf_dir):
    from ..operators import policies

    return policies.merge_locked(*_pools(spark, sf_dir), 1, 6)


S_UNION = """u AS (SELECT query, token_id, static_rank, model_rank, greatest(s.model_score - 0.125::DOUBLE * static_rank + 0.25::DOUBLE + CASE WHEN static_rank < 1 THEN 1000000 ELSE 0 END, g.model_score - 0.5::DOUBLE - 0.0625::DOUBLE * model_rank) + CASE WHEN s.query IS NOT NULL AND g.query IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END AS union_score
  FROM st s FULL JOIN ge g USING (query, token_id))"""


@query(f"WITH {S_POOL}, {S_UNION} SELECT query, token_id, static_rank, model_rank, union_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY union_score DESC, static_rank NULLS LAST, model_rank NULLS LAST, token_id) AS rank FROM u) WHERE rank <= 8")
def scored_union(spark, sf_dir):
    from ..operators import policies

    return policies.scored_union(*_pools(spark, sf_dir), policies.UnionPolicy(0.0, 0.125, 0.0, 0.25, 1, 0.5, 0.0625, 0.5), 8)


@query(f"""WITH {S_POOL}, tx AS (SELECT query, 't' || ((query + j * 3) % 50 + 3) AS text, j AS text_rank, ((query + j) % 31) / 16.0::DOUBLE AS text_score FROM (SELECT DISTINCT query FROM st), range(0, 4) AS r(j)),
tt AS (SELECT query, text, min(text_rank) AS text_rank, max(text_score) AS text_score FROM tx GROUP BY ALL),
s AS (SELECT query, 't' || token_id AS text, static_rank, 0.25::DOUBLE - 0.125::DOUBLE * static_rank + CASE WHEN static_rank < 1 THEN 1000000 ELSE 0 END AS s FROM st), gg AS (SELECT query, 't' || token_id AS text, model_rank, model_score - 0.5::DOUBLE - 0.0625::DOUBLE * model_rank AS g FROM ge),
b AS (SELECT * FROM s FULL JOIN gg USING (query, text) FULL JOIN (SELECT *, text_score - 0.25::DOUBLE - 0.0625::DOUBLE * text_rank AS t FROM tt) USING (query, text)),
f AS (SELECT *, greatest(s, g, t) + 0.25::DOUBLE * ((s IS NOT NULL)::INT + (g IS NOT NULL)::INT + (t IS NOT NULL)::INT - 1) AS final_score FROM b)
SELECT query, text, final_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final_score DESC, static_rank NULLS LAST, model_rank NULLS LAST, text_rank NULLS LAST, text) AS rank FROM f) WHERE rank <= 8""")
def unified_merge(spark, sf_dir):
    from ..operators import policies

    static, gen = _pools(spark, sf_dir)
    named = lambda df: df.withColumn("text", F.concat(F.lit("t"), F.col("token_id").cast("string")))
    texts = static.select("query").distinct().select("query", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("text_rank"))
    texts = texts.select("query", F.concat(F.lit("t"), ((F.col("query") + F.col("text_rank") * 3) % 50 + 3).cast("string")).alias("text"), "text_rank", ((F.col("query") + F.col("text_rank")) % 31 / 16).alias("text_score"))
    return policies.unified(named(static), named(gen), texts, policies.UnionPolicy(0.0, 0.125, 0.0, 0.25, 1, 0.5, 0.0625, 0.5), 0.25, 0.0625, 0.25, 8)


@query(f"""WITH {S_POOL}, lb AS (SELECT query, arg_min(token_id, static_rank) FILTER (static_rank >= 1) AS label FROM st GROUP BY 1), p(policy, pen, lock) AS (VALUES (0, 0.0::DOUBLE, 0), (1, 0.25::DOUBLE, 0), (2, 0.25::DOUBLE, 1), (3, 1.0::DOUBLE, 2)),
r AS (SELECT policy, query, token_id, row_number() OVER (PARTITION BY policy, query ORDER BY model_score - pen * static_rank + CASE WHEN static_rank < lock THEN 1000000 ELSE 0 END DESC, static_rank, token_id) AS rank FROM st CROSS JOIN p)
SELECT CAST(policy AS INTEGER) AS policy, count(*) AS found, count(*) FILTER (rank <= 1) AS hits1, count(*) FILTER (rank <= 5) AS hits5, round(sum(1.0::DOUBLE / rank), 6) AS reciprocal_ranks FROM r JOIN lb USING (query) WHERE token_id = label GROUP BY 1""")
def policy_grid(spark, sf_dir):
    from ..operators import policies

    static, _ = _pools(spark, sf_dir)
    labels = static.where("static_rank >= 1").groupBy("query").agg(F.min_by("token_id", "static_rank").alias("label"))
    return policies.grid(static, labels, [policies.UnionPolicy(0.0, pen, 0.0, 0.0, lock) for pen, lock in ((0.0, 0), (0.25, 0), (0.25, 1), (1.0, 2))])


@query()
def transliterate_strict(spark, sf_dir):
    from ..operators import transliteration as X

    return table(spark, sf_dir, "documents").select("doc_id", X.strict(F.col("text")).alias("bangla"))


@query()
def transliterate_lenient(spark, sf_dir):
    from ..operators import transliteration as X

    return table(spark, sf_dir, "documents").select("doc_id", X.lenient(F.col("text")).alias("bangla"))


def _roman(spark, sf_dir):
    """All words of documents that are written in the letters a to z, as Roman input is."""
    return lexicon.frequencies(table(spark, sf_dir, "documents")).where(F.col("word").rlike("^[a-z]+$"))


@query()
def phonetic_units(spark, sf_dir):
    from ..operators import transliteration as X

    rows = _roman(spark, sf_dir).select("word", F.posexplode(X.word_units("word")).alias("idx", "u"))
    return rows.select("word", "idx", "u.text", "u.kind", "u.position")


def _bangla_lexicon(spark, sf_dir):
    from ..operators import transliteration as X

    rows = _roman(spark, sf_dir).select(X.rendered("word").alias("word"), "frequency")
    rows = written(rows, "rendered")  # else the test below is carried to each token, before words are counted, and renders there too
    return lexicon.merge_sum(rows.where(T.is_lexicon_word(F.col("word"))))


def _suggestions(spark, sf_dir):
    """(words, suggestions): part names' words, corrected against the lexicon of all documents and the words of parts as loanwords."""
    from ..operators import autocorrect
    from ..operators import transliteration as X

    words = written(_part_words(spark, sf_dir).select(F.col("word").alias("roman"), X.rendered("word").alias("query"), "frequency"), "words")
    lex = written(_bangla_lexicon(spark, sf_dir), "lexicon")
    loans = lexicon.loanword_table(words.where(F.length("roman") >= 5).select(F.col("roman").alias("english"), F.col("query").alias("bangla"), "frequency"))
    return words, autocorrect.suggest_roman(words, lex, loans, max_distance=2)


@query()
def autocorrect_suggest(spark, sf_dir):
    return _suggestions(spark, sf_dir)[1]


@query()
def autocorrect_compose(spark, sf_dir):
    from ..operators import autocorrect

    return autocorrect.composed(*_suggestions(spark, sf_dir))


@query(f"""WITH {S_PART}, l AS (SELECT word, {SKELETON} AS sk FROM pw), r AS (SELECT word, frequency, {SKELETON} AS sk FROM freq),
p AS (SELECT l.word AS left_word, r.word AS right_word, r.frequency, levenshtein({BYTES.format('l.sk')}, {BYTES.format('r.sk')}) AS d FROM l JOIN r ON abs(length(l.sk) - length(r.sk)) <= 1 AND l.word <> r.word WHERE l.sk <> '' AND r.sk <> '' AND levenshtein({BYTES.format('l.sk')}, {BYTES.format('r.sk')}) <= 1)
SELECT left_word, right_word, CAST(d AS INTEGER) AS distance, frequency, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_word ORDER BY d, frequency DESC, right_word) AS rank FROM p) WHERE rank <= 16""")
def skeleton_fuzzy_join(spark, sf_dir):
    return lexicon.fuzzy_skeleton_join(_part_words(spark, sf_dir), lexicon.frequencies(table(spark, sf_dir, "documents")))


@query(f"WITH {S_PART} SELECT word, coalesce(freq.frequency, 0) AS frequency FROM (SELECT word FROM pw) LEFT JOIN freq USING (word)")
def word_frequencies(spark, sf_dir):
    from ..operators import autocorrect

    return autocorrect.word_frequency(_part_words(spark, sf_dir), lexicon.frequencies(table(spark, sf_dir, "documents")))


@query(f"""WITH {S_ENC}, a AS (SELECT token_id, frequency FROM vocab UNION ALL VALUES (0, 0), (1, 0), (2, 0)), b AS (SELECT a.token_id, CASE WHEN a.token_id > 2 THEN greatest(coalesce(n1.count, 0.1)::DOUBLE, 0.1::DOUBLE) ELSE 0.1::DOUBLE END AS n FROM a LEFT JOIN n1 USING (token_id))
SELECT token_id, round(ln(n / (SELECT sum(n) FROM b)), 9) AS bias FROM b""")
def unigram_bias(spark, sf_dir):
    from ..operators import models

    own = written(kept(spark, sf_dir), "kept")
    vocab = written(corpus.vocabulary(own, VOCAB, MIN_COUNT), "vocab")
    bias = models.output_bias(vocab, ngrams.counts(corpus.encode(own, vocab), 1))
    return bias.withColumn("bias", F.round("bias", 9))


@query(f"""WITH {S_RANK}, top AS (SELECT token_id, rank FROM t1 WHERE rank <= 10), rb AS (SELECT pos.source, pos.target, top.rank FROM pos LEFT JOIN top ON target = top.token_id),
m AS (SELECT source, {S_METRICS} FROM rk GROUP BY 1), b AS (SELECT source, {S_METRICS} FROM rb GROUP BY 1)
SELECT m.source, m.targets, m.all_targets, {", ".join(f"m.top{k}_all_targets, round(m.top{k}_all_targets - b.top{k}_all_targets, 6) AS top{k}_gain" for k in (1, 3, 5, 10))} FROM m JOIN b USING (source)""")
def source_gains(spark, sf_dir):
    """What the four orders gain over unigrams alone on held-out sentences, by source."""
    from ..operators import models

    train, held = folds(spark, sf_dir)
    rows, top = written(packed.evaluated(train, held), "ranks"), F.array(*map(F.lit, packed.unigrams(train)[0][:10])).cast("array<int>")
    model = nextword.metrics(rows, "source")
    plain = nextword.metrics(rows.withColumn("rank", F.nullif(F.array_position(top, F.col("target")), F.lit(0))), "source")
    out = models.source_gains(model, plain).drop("mrr_all_targets", "mrr_gain")
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_gain") else F.col(c) for c in out.columns])


@query()
def stem_suffixes(spark, sf_dir):
    from ..operators import autocorrect

    return autocorrect.stem_completions(_bangla_lexicon(spark, sf_dir))


S_KEYS = "keys(ch, x, y) AS (VALUES " + ", ".join(f"('{c}', {i + s}::DOUBLE, {y}::DOUBLE)" for y, (r, s) in enumerate((("qwertyuiop", 0.0), ("asdfghjkl", 0.5), ("zxcvbnm", 1.0))) for i, c in enumerate(r)) + ")"


@query(rf"""WITH {S_FREQ}, {S_KEYS}, near AS (SELECT a.ch, b.ch AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM keys a JOIN keys b ON a.ch <> b.ch WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.2),
w AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM freq WHERE regexp_matches(word, '^[a-z]+$')),
v AS (SELECT word, left(word, i - 1) || near || substr(word, i + 1) AS variant, d2 FROM w JOIN near ON near.ch = substr(word, i, 1)), m AS (SELECT word, variant, min(d2) AS d2 FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d2, variant) AS rank FROM m) SELECT word, variant, CAST(greatest(1, round(2 * d2)) AS INTEGER) AS cost, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 64""")
def key_slips(spark, sf_dir):
    from ..operators import autocorrect

    return autocorrect.key_slips(_roman(spark, sf_dir).select("word"))


@query()
def roman_repairs(spark, sf_dir):
    from ..operators import autocorrect

    return autocorrect.roman_repairs(_roman(spark, sf_dir).select("word"))


OPEN_SQL = r"""CASE WHEN NOT isfinite(s) THEN 'non_finite_score' WHEN s < 0.5 THEN 'score_below_threshold' WHEN t = '' THEN 'empty' WHEN trim(t) <> t THEN 'outer_whitespace' WHEN length(t) > 24 THEN 'too_long' END"""


@query(f"""WITH {S_FREQ}, x AS (SELECT word AS t, CASE WHEN frequency % 11 = 0 THEN 'nan'::DOUBLE ELSE frequency % 7 / 4.0::DOUBLE END AS s FROM freq),
r AS (SELECT coalesce({OPEN_SQL}, 'non_bangla') AS reason FROM x)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def open_vocab_reasons(spark, sf_dir):
    """Why made-up Latin texts are refused as open-vocabulary suggestions."""
    from ..operators import openvocab

    rows = lexicon.frequencies(table(spark, sf_dir, "documents")).select(F.col("word").alias("text"), F.when(F.col("frequency") % 11 == 0, float("nan")).otherwise(F.col("frequency") % 7 / 4).alias("score"))
    return rows.groupBy(openvocab.reason(F.col("text"), F.col("score"), min_score=0.5, max_chars=24).alias("reason")).agg(F.count("*").alias("n"))
