import base64
import random
import struct

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_core import WORDS, awkward, brute_fingerprint, table


def brute_similar(s, t, n=5):
    grams = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in (WORDS.findall(x.lower()) for x in (s or "", t or ""))]
    return bool(grams[0] and grams[1]) and len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]) - 1e-9


def test_near_duplicates_against_brute_force(spark):
    rows = awkward(4)
    texts = sorted({t or "" for _, t in rows})
    fp = {t: brute_fingerprint(t) for t in texts}
    group = {t: k for k, t in enumerate(texts)}
    for _ in texts:
        for t in texts:
            group[t] = min(group[u] for u in texts if t == u or (fp[t] ^ fp[u]).bit_count() <= 3 or brute_similar(t, u))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table(spark, rows), "").collect()
    best: dict = {}
    for i, t in rows:
        best.setdefault(group[t or ""], set()).add((i is None, i))
    assert len(got) == len(best)
    for x in got:
        assert (x.doc_id, x.text) in rows and (x.doc_id is None, x.doc_id) == min(best[group[x.text or ""]], key=lambda k: (k[0], k[1] or 0))


def test_a_hot_group_of_copies_is_linked_through_its_smallest(spark):
    """A chain of edits: neighbours are similar, the ends are not, and all are one component."""
    from bornoflow.llm import shingle_sets
    from bornoflow.llm.components import connected

    r = random.Random(2)
    w, rows = [f"a{k}" for k in range(150)], []
    for k in range(60):
        w = list(w)
        w[r.randrange(150)] = f"n{k}"
        rows.append((k + 1, " ".join(w)))
    rows += [(100 + k, " ".join(f"z{r.randrange(10**6)}" for _ in range(150))) for k in range(20)] + [(200, None), (201, "")]
    links = shingle_sets.links(spark.createDataFrame(rows, "key long, text string")).collect()
    texts = dict(rows)
    assert all(x.a < x.b and brute_similar(texts[x.a], texts[x.b]) for x in links)
    got = {x.node: x.root for x in connected(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 61)}


def test_near_duplicates_of_similar_shingles(spark):
    """Texts of Jaccard similarity 0.8 to 0.95 over five-word shingles go, those below stay."""
    r = random.Random(8)
    rows, want = [], set()
    for k in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        edited = list(w)
        for at in range(20, 20 + 30 * (1 + k % 6), 30):  # each replaced word changes five shingles
            edited[at] = "Z"
        grams = [{tuple(x[i : i + 5]) for i in range(196)} for x in (w, edited)]
        similar = len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= 0.8
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(edited))]
        want |= {2 * k} if similar else {2 * k, 2 * k + 1}
    assert 40 < len(want) < 75
    assert {x.doc_id for x in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table(spark, rows), "").collect()} == want


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k * k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c)]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_mix_copies(spark):
    from bornoflow.llm import mixing

    docs = table(spark, awkward(6))
    want = {}
    for x in mixing.mix(docs, boundary="whole").collect():
        want[x.doc_id, x.digest] = want.get((x.doc_id, x.digest), 0) + x.epochs + (x.part > 0)
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    found = {(x.doc_id, x.m): x["count"] for x in got.groupBy("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m")).count().collect()}
    assert found == {k: n for k, n in want.items() if n}


def test_mix_keeps_rows_of_equal_id_and_text_apart(spark):
    docs = spark.createDataFrame([(1, "a b c", None, "s1", 5), (1, "a b c", None, "s2", 5), (1, "a b c", "x", "s1", 5), (1, "a b c", "x", "s1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    sources = [x.source for x in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    langs = [(x.source, x.lang) for x in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert {"s1", "s2"} == set(sources) and sources.count("s2") <= 2 and sources.count("s1") <= 6 and ("s1", "x") in langs


CLASHES = ("_d", "_t", "_kept", "_mask", "_new", "_md5", "_own", "_id", "_key", "_digest", "_copies", "_n", "n_lines", "n_removed", "key", "same", "row", "d", "t", "kept", "mask", "new", "source_size", "taken", "part", "epochs", "digest", "size")


@pytest.mark.parametrize("stage", ["lines", "near_duplicates", "mix"])
def test_columns_of_any_name_pass(spark, stage):
    docs = table(spark, awkward(5)).select("doc_id", "text", "lang", "source", "n_chars", *(F.concat_ws("-", F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES))
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(x[c] == (f"{c}-{x.doc_id}" if x.doc_id is not None else c) for x in rows for c in CLASHES)


def test_run_on_empty_and_null_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 0), (2, "", None, None, 0), (1, "x", "en", None, 1)])):
        d = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, str(d))
        assert got.columns == ["doc_id", "n_tokens", "ids_base64"] and (got.count() == 0 or rows)


def test_lines_drop_only_emptied_documents(spark):
    got = corpus_pipeline.dedup_lines(spark, table(spark, [(1, "a b c"), (2, "A b c\n"), (3, ""), (4, None), (5, "a b c\nnew"), (6, "\n")]), "").collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id != 4) == [(1, "a b c"), (3, ""), (5, "new"), (6, "\n")] and len(got) == 5


def test_run(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers as P
    import tiktoken

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < len(got) and {x.doc_id for x in got} <= set(docs)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in got:
        raw = base64.b64decode(x.ids_base64)
        text = plain.decode(struct.unpack(f"<{x.n_tokens}I", raw))
        assert set(text.split("\n")) <= set(docs[x.doc_id].split("\n")) and (WORDS.search(text) or not docs[x.doc_id].strip())
