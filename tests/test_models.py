"""Model tables, hand-overs, reports, Roman correction channels, and the rules of keys, pages and curation."""

import math

import pytest
from pyspark.sql import functions as F

from bornoflow.functions import text as T
from bornoflow.operators import autocorrect, corpus, lexicon, loanmining, models, ngrams, nextword, policies
from bornoflow.sources import readers, writers


@pytest.fixture(scope="module")
def trained(spark):
    text = ["a b c", "a b c", "a b d", "x b c", "a b c d", "d a b c"]
    sents = spark.createDataFrame([("s", i, 1, w.split()) for i, w in enumerate(text)], "source string, document_id long, sentence_id int, tokens array<string>")
    vocab = corpus.vocabulary(sents, 100, 1)
    encoded = corpus.encode(sents, vocab)
    tables = {o: ngrams.counts(encoded, o) for o in (1, 2, 3, 4)}
    ranked = {o: ngrams.top_candidates(t.withColumn("score", F.col("count")), o, 4) for o, t in tables.items()}
    return vocab, tables, ranked, encoded


def test_encode_of_awkward_rows(spark):
    sents = spark.createDataFrame([("s", 1, 1, ["a", "b", "q"]), ("s", 2, 1, []), (None, 3, 1, ["b"]), ("s", None, 2, ["é", "a"])], "source string, document_id long, sentence_id int, tokens array<string>")
    vocab = spark.createDataFrame([(0, "<pad>", 0), (1, "<bos>", 0), (2, "<unk>", 0), (3, "a", 5), (4, "é", 4)], "token_id int, token string, frequency long")
    got = {(x.source, x.document_id): x.ids for x in corpus.encode(sents, vocab).collect()}
    assert got == {("s", 1): [1, 3, 2, 2], ("s", 2): [1], (None, 3): [1, 2], ("s", None): [1, 4, 3]}
    assert corpus.encode(sents.limit(0), vocab).count() == 0
    assert [x.ids for x in corpus.encode(sents.where("document_id = 1"), vocab.where("token_id < 3")).collect()] == [[1, 2, 2, 2]]


def test_save_and_load(spark, trained, tmp_path):
    vocab, _, ranked, encoded = trained
    models.save(vocab, ranked, str(tmp_path / "m"))
    m = models.load(spark, str(tmp_path / "m"))
    assert m.mode == models.BACKOFF and m.fingerprint == models.vocabulary_fingerprint([x.token for x in vocab.orderBy("token_id").collect()])
    row = models.info(m).first()
    assert row.vocabulary == vocab.count() and row.rows1 == ranked[1].count() and row.fingerprint == m.fingerprint
    contexts = nextword.positions(encoded).select("c1", "c2", "c3").distinct()
    show = lambda df: sorted(map(str, df.collect()))
    assert show(m.suggest(contexts)) == show(nextword.suggest(contexts, ranked))
    other = vocab.where("token_id < 5")
    models.save(other, {}, str(tmp_path / "m2"))
    ranked[1].withColumn("vocabulary", F.lit(7).cast("long")).write.parquet(str(tmp_path / "m2" / "order=1"))
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / "m2"))
    for bad in (vocab.where("token_id <> 2"), vocab.unionByName(vocab.where("token_id = 4")), vocab.where("token_id <> 4")):
        with pytest.raises(ValueError):
            models.checked_vocabulary(bad)
    assert models.score_mode(ranked[1].withColumn("score", F.col("count") - 1)) == models.INTERPOLATED


def test_hashes():
    assert models.fingerprint64(b"") == 0xCBF29CE484222325 and models.fingerprint64(b"a") == 0xAF63DC4C8601EC8C
    assert models.stable_hash("a") == 0xAF63BD4C8601B7BE  # FNV-1, published value
    h = models.fingerprint64("বই".encode())
    assert models.text_context_id("বই") == 0x80000000 | ((h >> 31 ^ h) & 0x7FFFFFFF)


def test_hand_overs(spark, trained):
    vocab, tables, ranked, encoded = trained
    ids = {x.token: x.token_id for x in vocab.collect()}
    contexts = spark.createDataFrame([(None, ids["a"], ids["b"]), (None, None, 1), (None, None, None)], "c1 int, c2 int, c3 int")
    got = {(x.c2, x.c3): x for x in models.rerank_input(contexts, ranked, 2).collect()}
    assert got[ids["a"], ids["b"]].context == [0, ids["a"], ids["b"]] and got[ids["a"], ids["b"]].candidates[0] == ids["c"]
    assert got[None, None].context == [0, 0, 0] and len(got[None, None].candidates) == 2
    gen = spark.createDataFrame([(1, 4, 3, 0.5), (1, 4, 1, 0.1), (1, 2, 0, 9.0), (1, 5, 2, 0.2)], "query int, token_id int, model_rank int, model_score double")
    assert {(x.token_id, x.model_rank, x.model_score) for x in models.accepted_ids(gen, 8).collect()} == {(4, 1, 0.1), (5, 2, 0.2)}
    with pytest.raises(Exception, match="out of the vocabulary"):
        models.accepted_ids(gen, 5).collect()
    m = models.Model(vocab, ranked, models.BACKOFF, 1)
    texts = spark.createDataFrame([(1, 0, "c"), (1, 1, "nowhere"), (1, 2, "d")], "context_id int, candidate_index int, text string")
    priors = models.context_priors(texts, contexts.limit(1).withColumn("context_id", F.lit(1)), m).collect()
    assert {(x.candidate_index, x.prior_rank) for x in priors} == {(0, 1), (2, 2)}
    bias = {x.token_id: x.bias for x in models.output_bias(vocab, tables[1]).collect()}
    assert abs(sum(map(math.exp, bias.values())) - 1) < 1e-12 and bias[0] == bias[2] and bias[ids["b"]] > bias[ids["d"]]


def test_gains_and_balance(spark, trained):
    vocab, tables, ranked, encoded = trained
    at = nextword.positions(encoded)
    model, plain = (nextword.metrics(nextword.ranks(at, r), "source") for r in (ranked, {1: ranked[1]}))
    gains = models.source_gains(model, plain)
    row, b = gains.first(), models.source_balance(gains).first()
    assert row.top1_gain > 0 and b.source_count == 1 and b.all_sources_non_regressing and abs(b.min_top5_gain - row.top5_gain) < 1e-12
    none = models.source_balance(gains.limit(0)).first()
    assert none.source_count == 0 and not none.all_sources_non_regressing and none.min_mrr_gain == 0
    rows = [(q, c == 0, float(c == 0) + 0.1 * q, float(c)) for q in range(5) for c in range(4)]
    w = models.pairwise_weights(spark.createDataFrame(rows, "query int, is_label boolean, x double, y double"), columns=("x", "y"))
    assert w["x"] > 0 > w["y"]


def test_personal_snapshot(spark, tmp_path):
    store = spark.createDataFrame([(1, 0, "", "a", 3, 9), (1, 1, "a", "b", 2, 8), (2, 0, "", "a", 1, 1)], "user_id int, context_len int, context string, token_id string, count long, last_seen int")
    models.save_personal(store, str(tmp_path / "p"), 77)
    assert sorted(map(tuple, models.load_personal(spark, str(tmp_path / "p"), 77).collect())) == sorted(map(tuple, store.collect()))
    assert models.load_personal(spark, str(tmp_path / "p"), 77, 1).count() == 2
    with pytest.raises(ValueError):
        models.load_personal(spark, str(tmp_path / "p"), 78)
    models.save_personal(store.unionByName(store), str(tmp_path / "q"), 77)
    with pytest.raises(ValueError):
        models.load_personal(spark, str(tmp_path / "q"), 77)
    assert {(x.user_id, x.entries) for x in models.personal_size(store).collect()} == {(1, 2), (2, 1)}
    texts = spark.createDataFrame([("বই",), ("বই।",), ("৳১",), ("১২",), ("ab",), ("ক" * 24,), ("ক" * 25,)], "t string")
    assert [x[0] for x in texts.select(T.is_personal_text(F.col("t"))).collect()] == [True, False, False, False, False, True, False]


def test_roman_channels(spark):
    lex = spark.createDataFrame([("কাঁঠাল", 50), ("বাড়ি", 400), ("আমি", 900), ("লাইসেন্স", 70)], "word string, frequency long")
    loans = spark.createDataFrame([("license", "লাইসেন্স", 70)], "english string, bangla string, frequency long")
    words = spark.createDataFrame([("bari", "বারি"), ("ami", "আমি"), ("license", "লিচেন্সে"), ("lisense", "লিসেন্সে"), ("  ", " ")], "roman string, query string")
    got = autocorrect.suggest_roman(words, lex, loans, max_distance=1)
    best = {x.query: (x.text, x.channel) for x in got.where("rank = 1").collect()}
    assert best["বারি"] == ("বাড়ি", "roman_repair") and best["আমি"] == ("আমি", "exact") and best["লিচেন্সে"] == ("লাইসেন্স", "loanword_exact") and best["লিসেন্সে"] == ("লাইসেন্স", "loanword_fuzzy")
    row = autocorrect.roman_channels(words.where("roman = 'bari'"), lex).first()
    cost = autocorrect.unit_distance("বারি", "বাড়ি")
    assert row.score == round(1024 * math.log(401)) + 2048 - 1024 - 128 * cost
    exact = autocorrect.roman_channels(words.where("roman = 'license'"), lex, loans).where("channel = 'loanword_exact'").first()
    assert exact.score == round(1024 * math.log(71)) + 10_240 - 64 * autocorrect.unit_distance("লিচেন্সে", "লাইসেন্স")
    bar = {(x.roman, x.rank): x.text for x in autocorrect.composed(words, got).collect()}
    assert bar["bari", 1] == "বারি" and bar["bari", 2] == "বাড়ি" and ("ami", 2) not in bar and ("  ", 1) not in bar
    assert autocorrect.word_alternatives(words.where("roman = 'bari'"), lex).first().text == "বাড়ি"
    assert {(x.word, x.frequency) for x in autocorrect.word_frequency(spark.createDataFrame([("আমি",), ("নাই",)], "word string"), lex).collect()} == {("আমি", 900), ("নাই", 0)}
    v = spark.range(1).select(autocorrect.feature_vector(*map(F.lit, (8, 70_000, 2, 5, 1025, True, False, True))).alias("v")).first().v
    assert v == [8, 32767, 2, 5, 3, 10, 1, 0, 1]


def test_truncated_loanwords_are_punished(spark):
    loans = spark.createDataFrame([("school", "স্কুল", 10)], "english string, bangla string, frequency long")
    lex = spark.createDataFrame([("স্কুল", 10)], "word string, frequency long")
    words = spark.createDataFrame([("schoola", "ক"), ("schooll", "খ")], "roman string, query string")
    got = {x.query: x.score for x in autocorrect.roman_channels(words, lex, loans).where("channel = 'loanword_fuzzy'").collect()}
    assert got["খ"] - got["ক"] == 12_288


def test_pages(spark):
    cases = {
        "a &#65; &#x995; b": "a A ক b", "a & b": "a   b", "a & b; c": "a   c", "&#xD800;x": " x", "&copy;&amp;": " &", "x<b": "x", "a<script>if (a<b) x</script >b": "a  b", "a<STYLE>p{}": "a ",
        "<svg:script>q</svg:script>r": "  r", "&#1114112;": " ", "&" + "y" * 33 + ";": " " + "y" * 33 + ";", "<p>ক</p>": " ক ", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", T.html_to_text(F.col("h")).alias("t"))
    assert {x.h: x.t for x in df.collect() if not x.h.startswith("a<script>if")} == {k: v for k, v in cases.items() if not k.startswith("a<script>if")}


def test_keys_and_curation(spark):
    keys = {" X  ray. ": "x ray", "“Tea-time”": "tea-time", "O'Neil": "o'neil", "English": None, "old  english": None, "9x": None, "a" * 82: None, "": None}
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", loanmining.english_key(F.col("k")).alias("e")).collect()
    assert {x.k: x.e for x in got} == keys
    rows = [("epub", "আমরা", 1), ("wiki", "তোমরা", 1), ("wiki", "সকাল", 2), ("news", "বিকাল", 3), ("epub", "রাাত", 9), ("wiki", "ab", 9), ("wiki", "দুপুর", 1), ("news", "দুপুর", 1), ("wiki", "ডাক্তার", 1), ("wiki", "আআম", 9)]
    cur = lexicon.curation(spark.createDataFrame(rows, "source string, word string, frequency long"), spark.createDataFrame([("ডাক্তার",)], "word string")).collect()
    assert {(x.source, x.word): (x.decision, x.reason) for x in cur if x.reason} == {
        ("wiki", "তোমরা"): ("quarantine", "unsupported_low_frequency"), ("epub", "রাাত"): ("drop", "obvious_corruption_shape"),
        ("wiki", "ab"): ("drop", "invalid_bangla_token"), ("wiki", "আআম"): ("drop", "obvious_corruption_shape"),
    }


def test_writers_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", "low", "w", 2, "drop"), ("a", "low", "c", 5, "drop"), ("a", "low", "b", 1, "drop"), ("a", None, "x", 1, "keep")], "source string, reason string, word string, frequency long, decision string")
    writers.quarantine_tsv(rows.coalesce(1), str(tmp_path / "q"))
    lines = [x for p in sorted((tmp_path / "q").glob("*.csv")) for x in p.read_text().splitlines() if not x.startswith("word")]
    assert lines == ["b\t1\ta\tdrop\tlow", "c\t5\ta\tdrop\tlow", "w\t2\ts\tdrop\tlow"]
    writers.candidates_json(spark.createDataFrame([("q", 2, "y"), ("q", 1, "x")], "query string, rank int, text string"), str(tmp_path / "c"))
    assert [y["text"] for y in spark.read.json(str(tmp_path / "c")).first().candidates] == ["x", "y"]
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "b"), ("", "x")], "source string, expected string")
    row = lexicon.audit_pairs(pairs, F.lit(2)).first()
    assert (row.rows, row.accepted, row.identity, row.unique_pairs, row.total_cost, row.max_cost) == (4, 2, 1, 1, 4, 2)
    hits = autocorrect.evaluate(pairs.where("source = 'a'"), spark.createDataFrame([("a", "b", 2)], "query string, text string, rank int")).first()
    assert (hits.pairs, round(hits.top1, 6), round(hits.top3, 6), round(hits.mrr, 6)) == (3, 0.0, round(2 / 3, 6), round(1 / 3, 6))
    assert {x["variant"] for x in autocorrect.nasal_variants(spark.createDataFrame([("চাঁদ",)], "word string")).collect()} == {"চাদ", "চাঁদঁ"}
    ranks = spark.createDataFrame([(1, 1, 5, 0.5), (1, 1, 1, 0.4), (1, 1, 2, 0.9)], "query int, label int, token_id int, score double")
    assert nextword.competition_rank(ranks).first()["rank"] == 3


def test_mining_inputs(spark, tmp_path):
    import json

    news = [{"title": "আমি বই পড়ি", "content": ["বই ভালো", 5], "tag": {"a": "বই"}}, {"title": None, "content": "বই"}, {"content": "[বই"}]
    (tmp_path / "n.json").write_text(json.dumps(news, ensure_ascii=False))
    got = {x.word: x.frequency for x in readers.news_lexicon(spark, str(tmp_path / "n.json")).collect()}
    assert got["বই"] == 4 and got["আমি"] == 1
    items = [
        {"word": "টেবিল", "etymology_templates": [{"name": "bor", "args": {"1": "bn", "2": "en", "3": "table"}}, {"name": "bor", "args": {"1": "bn", "2": "fa", "3": "x"}}, {"name": "cog", "args": {"2": "en", "3": "y"}}], "etymology_text": "Borrowed from English table"},
        {"word": "বল", "etymology_text": "transliteration of English o’ball"}, {"word": "ক"},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in items))
    pairs = readers.dictionary_pairs(spark, str(tmp_path / "d.jsonl"))
    assert sorted(map(tuple, pairs.collect())) == [("o'ball", "বল", "text:translit"), ("table", "টেবিল", "template:bor"), ("table", "টেবিল", "text:borrowed")]
    (tmp_path / "b.csv").write_text("L2_orth,L2_etym\nবাস,bus\n")
    assert [tuple(x) for x in readers.loanword_bank(spark, str(tmp_path / "b.csv")).collect()] == [("bus", "বাস", "bank:etym")]
    (tmp_path / "c.dict").write_text(";;; x\nBUS  B AH1 S\nbus(2) B AH0 S\n'TIS T\nempty\n")
    assert sorted(map(tuple, readers.pronunciations(spark, str(tmp_path / "c.dict")).collect())) == [("bus", "B AH0 S"), ("bus", "B AH1 S")]
    lex = spark.createDataFrame([("টেবিল", 3)], "word string, frequency long")
    seeds = loanmining.direct(pairs.unionByName(readers.loanword_bank(spark, str(tmp_path / "b.csv"))), lex)
    writers.loanword_seed_tsv(seeds, str(tmp_path / "seed"))
    assert [x for p in (tmp_path / "seed").glob("*.csv") for x in p.read_text().splitlines()][1:] == ["table\tটেবিল\t3\ttemplate:bor,text:borrowed"]
    cover = spark.createDataFrame([("a", ["ক"], ["খ"]), ("b", None, ["গ"]), ("c", None, None)], "english string, listed array<string>, probed array<string>")
    writers.loanword_gaps_tsv(cover.coalesce(1), str(tmp_path / "gaps"))
    assert [x for p in (tmp_path / "gaps").glob("*.csv") for x in p.read_text().splitlines() if not x.startswith("english")] == ['b\t["গ"]', "c\t[]"]


def test_tables_are_checked(spark, tmp_path):
    lex = spark.createDataFrame([("ক", 3), ("খ", 1)], "word string, frequency long")
    writers.lexicon_table(lex, str(tmp_path / "l"))
    assert readers.lexicon_table(spark, str(tmp_path / "l")).count() == 2
    for k, bad in enumerate((lex.unionByName(lex), lex.withColumn("frequency", F.lit(-1)), lex.withColumn("word", F.lit("")).limit(1))):
        writers.lexicon_table(bad, str(tmp_path / f"l{k}"))
        with pytest.raises(ValueError):
            readers.lexicon_table(spark, str(tmp_path / f"l{k}"))
    loans = spark.createDataFrame([("bus", "বাস", 1), ("bus", "বাসা", 1)], "english string, bangla string, frequency long")
    loans.write.parquet(str(tmp_path / "w"))
    assert readers.loanword_table(spark, str(tmp_path / "w")).count() == 2
    loans.withColumn("english", F.lit("a b")).write.parquet(str(tmp_path / "w2"))
    with pytest.raises(ValueError):
        readers.loanword_table(spark, str(tmp_path / "w2"))
    sents = spark.createDataFrame([("s", d, 1, ["a"]) for d in range(9)] + [("t", 1, 1, ["b"])], "source string, document_id long, sentence_id int, tokens array<string>")
    writers.sentence_corpus(sents, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("source").count().orderBy("source").collect()[0]["count"] == 9


def test_policies_on_held_out_labels(spark):
    static = spark.createDataFrame([(q, t, t, 1.0 if t == q % 3 else 0.5) for q in range(12) for t in range(3)], "query int, token_id int, static_rank int, model_score double").withColumns({"count": F.lit(1), "source_order": F.lit(1)})
    labels = spark.createDataFrame([(q, q % 3, "ab"[q % 2]) for q in range(12)], "query int, label int, source string")
    grid = [policies.UnionPolicy(0.0, pen, 0.0, 0.0, lock) for pen, lock in ((9.0, 0), (0.01, 0), (0.01, 2))]
    row = policies.held_out_choice(static, labels, grid, F.col("query") >= 8).first()
    assert (row.policy, row.found, row.hits1) == (1, 4, 4)
    by = {(x.source, x.policy): (x.found, x.hits1) for x in policies.grid_by(static, labels, grid, "source").collect()}
    assert by["a", 1] == (6, 6) and by["b", 0] == (6, 2)
    ctx = spark.createDataFrame([(1, [1.0, 2.0])], "query int, hidden array<double>")
    tok = spark.createDataFrame([(5, [3.0, 4.0], 0.5), (6, [0.0, 1.0], 0.0)], "token_id int, embedding array<double>, bias double")
    assert {(x.token_id, x.score) for x in policies.pool_scores(ctx, spark.createDataFrame([(1, 5), (1, 6)], "query int, token_id int"), tok).collect()} == {(5, 11.5), (6, 2.0)}
