"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_topk, line_dedup, mixing, multi_index, pitman_yor, quality, simhash, substring_dedup, token_store
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stored = token_store.store(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"), repeatable=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), repeatable=True).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_line_dedup, op3_token_store, op4_exact_topk, op5_byte_bpe, op6_mixing, op7_multi_index, op8_pitman_yor, op9_substring_dedup, op10_simhash]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


WORD_SQL = r"[^\x20\x09-\x0D]+"

OP9_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], chr(32)))) AS g FROM w WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least USING (g) WHERE d < doc_id),
lists AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: qs IS NULL OR NOT list_contains(qs, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id
"""


OP2_SQL = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, n, line, list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM raw),
f AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min({'d': doc_id, 'n': n}) AS pos FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT k, pos, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' '))) AS v FROM f WHERE len(w) >= 5),
gone AS (
  SELECT a.k FROM v a JOIN (SELECT v, i, min(pos) AS m FROM v GROUP BY ALL HAVING count(*) > 1) b ON a.v = b.v AND a.i = b.i WHERE b.m < a.pos
  UNION SELECT v.k FROM v JOIN f ON f.k = v.v WHERE len(f.w) >= 5 AND f.pos < v.pos
  UNION SELECT f.k FROM v JOIN f ON f.k = v.v WHERE len(f.w) >= 5 AND v.pos < f.pos),
stay AS (SELECT l.doc_id, l.n, l.line FROM l LEFT JOIN f ON f.k = array_to_string(l.w, ' ') AND f.pos = {'d': l.doc_id, 'n': l.n} WHERE len(l.w) = 0 OR (f.k IS NOT NULL AND f.k NOT IN (SELECT k FROM gone)))
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(len(s.x), 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(array_to_string(s.x, chr(10)), '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, list(line ORDER BY n) AS x FROM stay GROUP BY 1) s ON s.doc_id = d.doc_id
"""

OP6_SQL = f"""
WITH r AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS dg, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS BIGINT) AS size FROM documents),
q AS (SELECT *, greatest(0.05, CASE WHEN length(t) > 0 THEN 1 - length(regexp_replace(t, '[\\p{{L}}\\s]+', '', 'g')) / length(t) ELSE 0.05 END) AS quality,
  (CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), '17', dg)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM r),
k AS (SELECT *, -ln(u) / quality AS key FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
p AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
o AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS ratio FROM p),
c AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS i FROM o),
g AS (SELECT source, source_size, least(most, w * (SELECT arg_min(level, i) FROM c WHERE level <= ratio)) AS target FROM c),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
x AS (SELECT k.doc_id, k.size, h.source_size, h.target, h.epochs, CAST(round(h.target) AS BIGINT) - h.epochs * h.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_exact_topk": OP4_SQL, "op6_mixing": OP6_SQL, "op9_substring_dedup": OP9_SQL}
