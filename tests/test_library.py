"""The library beside its registered queries: grammars, sources, sinks, channels, sessions. Small fixtures with known answers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from bornoflow.functions import repairs, scores
from bornoflow.functions import text as T
from bornoflow.operators import autocorrect, corpus, lexicon, openvocab, policies
from bornoflow.operators import transliteration as X
from bornoflow.sources import readers, writers
from bornoflow.streaming import sessions


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("word", "corpus_word", "lexicon_word"), [("আমি", True, True), ("বিজ্ঞান", True, True), ("হঠাত্", True, False), ("ক্", False, False), ("্ক", False, False), ("ক্া", False, False), ("অসম‌", False, False), ("র‌্যাব", True, True), ("ৰক", False, False), ("abc", False, False), ("", False, False)])
def test_grammars(spark, word, corpus_word, lexicon_word):
    assert one(spark, word, T.is_corpus_word) == corpus_word and one(spark, word, T.is_lexicon_word) == lexicon_word


def test_bangla_tokens(spark):
    assert one(spark, "আমি, বিদ্যুত্ ৰ x ক্ খ১", T.bangla_tokens) == ["আমি", "বিদ্যুৎ", "খ"]
    assert one(spark, "ক", T.bangla_units) == ["ক"] and one(spark, "বিজ্ঞান", T.bangla_units) == ["বি", "জ্ঞা", "ন"]


def test_strict_and_lenient(spark):
    df = spark.createDataFrame([("ké",), ("ki ~ 1.5",), ("ami.",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.strict(F.col("t")), X.lenient(F.col("t"))).collect()]
    assert got[0] == ("ké", "ক") and got[2] == ("আমি।", "আমি।") and got[3] == (None, None) and got[1][0] == "ki ~ 1.5"
    assert one(spark, "a~b€", T.invalid_chars) == "~€" and one(spark, "a~b", lambda c: T.sanitize(c)["error"]) == "~"


def test_scores(spark):
    r = spark.range(1).select(scores.log_probability(F.lit(0.5)), scores.log_probability(F.lit(0.0)), scores.frequency_score(F.lit(9)), scores.heap_frequency_score(F.lit(9)), scores.finite(F.lit(float("nan")))).first()
    assert tuple(r) == (-693147, -27631021, 2358, 18, float("-inf"))


def test_sentences(spark):
    assert one(spark, "a b. c 3.5 d! e।\n 5. f", T.sentences) == ["a b", "c 3.5 d", "e", "5. f"]
    docs = spark.createDataFrame([(1, "s", "a b c d e. x. a b c d e")], "doc_id long, source string, text string")
    rows = corpus.sentence_rows(docs, max_tokens=3)
    assert [(r.sentence_id, r.tokens) for r in rows.orderBy("sentence_id").collect()] == [(1, list("abc")), (2, list("de")), (3, list("abc")), (4, list("de"))]
    assert sorted(r.sentence_id for r in corpus.dedup_sentences(rows).collect()) == [1, 2]


def test_repairs():
    assert repairs.repairs("kk")[:2] == [("kk", 0, "original"), ("kok", 1, "inserted_separator_o")]
    assert ("tohaka", 1, "split_aspirated_consonant") in repairs.repairs("thaka") and ("paRa", 1, "lowercase_r_to_flap") in repairs.repairs("para")
    assert ("banji", 2, "palatal_nasal_ja_from_ng") in repairs.repairs("bangi") and repairs.repairs("") == [] and len(repairs.repairs("krrtrmngi")) <= 8


def test_autocorrect_channels(spark):
    lex = spark.createDataFrame([("কটা", 1), ("কতা", 1_000_000), ("কাঠা", 500_000), ("সুশীল", 550), ("সুনীল", 1220), ("আমি", 100), ("আমিও", 5)], "word string, frequency long")
    got = autocorrect.suggest(spark.createDataFrame([("কটা",), ("সুশিল",), ("আমি",)], "query string"), lex).collect()
    first = {r.query: (r.text, r.channel) for r in got if r["rank"] == 1}
    assert first["কটা"] == ("কটা", "exact") and first["সুশিল"] == ("সুশীল", "vowel_length_edit") and first["আমি"] == ("আমি", "exact")
    assert {r.channel for r in got if r.text == "আমিও"} <= {"stem_suffix", "prefix_completion", "edit_distance"}
    assert autocorrect.unit_distance("আমি", "আমী") == 1 and autocorrect.osa("ab", "ba") == 1 and len(autocorrect.SUFFIXES) == 40
    loans = spark.createDataFrame([("license", "লাইসেন্স", 100), ("table", "টেবিল", 9)], "english string, bangla string, frequency long")
    found = autocorrect.loanwords(spark.createDataFrame([("License",), ("tabel",), ("lisense",)], "query string"), loans).collect()
    assert {(r.query, r.bangla, r.channel) for r in found} == {("License", "লাইসেন্স", "loanword_exact"), ("tabel", "টেবিল", "loanword_fuzzy"), ("lisense", "লাইসেন্স", "loanword_fuzzy")}


@pytest.mark.parametrize(("text", "why"), [("আমি", None), ("", "empty"), (" আমি", "outer_whitespace"), ("আ মি", "whitespace"), ("আমি।", "punctuation"), ("আ৯", "digit"), ("abc", "non_bangla"), ("িক", "starts_with_mark"), ("ক্্ক", "consecutive_hasant"), ("ক্ি", "mark_after_hasant"), ("ক্", "ends_with_hasant"), ("ক‌‌ক", "invalid_zwnj"), ("কককককক", "repeated_run"), ("ক" * 40, "too_long")])
def test_open_vocabulary(spark, text, why):
    df = spark.createDataFrame([(text, 1.0)], "t string, s double")
    assert df.select(openvocab.reason(F.col("t"), F.col("s"))).first()[0] == why


def test_lexicon_files(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("# words\nআমি\t100\nআমি\t50\nতুমি\nabc\t3\nবই\tx\nবই\t1\t2\n")
    reasons = {(r.word, r.reason) for r in readers.lexicon(spark, str(p)).collect()}
    assert ("abc", "not_a_word") in reasons and ("বই", "frequency") in reasons and ("বই", "extra_column") in reasons
    assert {(r.word, r.frequency) for r in readers.lexicon_lenient(spark, str(p)).collect()} == {("আমি", 150), ("তুমি", 1)}
    with pytest.raises(Exception, match="bad lexicon line"):
        readers.lexicon_strict(spark, str(p)).collect()
    writers.lexicon_tsv(readers.lexicon_lenient(spark, str(p)), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["আমি\t150", "তুমি\t1"]


def test_prose_and_markup(spark):
    assert one(spark, '{"url": "u", "content": ["b", {"x": "c"}], "title": "a"}', readers.json_prose) == "a\nb\nc"
    assert one(spark, '[{"k": "v", "n": 3}]', readers.json_prose) == "v" and one(spark, "{", readers.json_prose) is None
    assert one(spark, "<p>a&nbsp;&lt;b&gt;</p><script>x</script>&copy;&amp;lt;", T.html_to_text) == " a <b>    &lt;"
    assert one(spark, "<b>&eacute;&#65;</b>", readers.markup_text).strip() == "éA"


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></c>')
        z.writestr("o/c.opf", '<p><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="t%20a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/><itemref idref="a" linear="no"/></spine></p>')
        z.writestr("o/t a.xhtml", "<p>two</p>")
        z.writestr("o/b.xhtml", "<p>one</p>")
        z.writestr("o/nav.xhtml", "<p>no</p>")
    spark.dataSource.register(readers.EpubSource)
    rows = spark.read.format("epub").load(str(tmp_path)).orderBy("idx").collect()
    assert [(r.member, r.markup) for r in rows] == [("o/b.xhtml", "<p>one</p>"), ("o/t a.xhtml", "<p>two</p>")]
    (tmp_path / "x.json").write_text('{"title": "t", "body": "b"}')
    (tmp_path / "y.txt").write_text("বড়")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert got["x.json"] == "t\nb" and got["b.epub"].split() == ["one", "two"] and got["y.txt"] == "বড়"


def test_policies(spark):
    static = spark.createDataFrame([(1, 10, 0, 5, 1, 0.0), (1, 11, 1, 4, 1, 9.0), (1, 12, 2, 3, 1, float("nan"))], "query long, token_id int, static_rank int, count long, source_order int, model_score double")
    gen = spark.createDataFrame([(1, 12, 0, 20.0), (1, 13, 1, 1.0)], "query long, token_id int, model_rank int, model_score double")
    order = lambda df: [r.token_id for r in df.orderBy("rank").collect()]
    assert order(policies.rerank(static, 0.1, 1)) == [10, 11, 12] and order(policies.merge_locked(static, gen)) == [10, 12, 13, 11]
    assert order(policies.scored_union(static, gen)) == [10, 12, 11, 13]
    assert tuple(policies.pool_recall(static, gen, spark.createDataFrame([(1, 13), (1, 10), (1, 99)], "query long, label int")).first()) == (3, 1, 1, 2)


def test_personal_matches_sessions(spark, tmp_path):
    """Without evictions the batch store and the stream suggest alike."""
    import random

    r = random.Random(3)
    rows = [(u, t, "token", r.choice("abcd")) for u in (1, 2) for t in range(1, 61)]
    df = spark.createDataFrame(rows, "user_id long, tick long, kind string, token string")
    for k, cut in enumerate(("tick <= 20", "tick > 20 and tick <= 45", "tick > 45")):
        df.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.run(stream).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.user_id, x.tick): list(x.suggestions) for x in spark.table("shown").collect()}
    assert len(got) == 120
    for u in (1, 2):
        store = sessions.Store()
        for _, t, kind, token in (x for x in rows if x[0] == u):
            store.commit(kind, token, t)
            assert got[u, t] == store.suggest()


def test_batch_entries_are_the_sessions(spark):
    import random

    from bornoflow.operators import personal

    r, store, rows = random.Random(5), sessions.Store(), []
    for t in range(200):
        starts = t == 0 or r.random() < 0.2
        if starts:
            store.commit("boundary", None, t)
        token = r.choice("abc")
        store.commit("token", token, t)
        rows.append((1, t, token, starts))
    got = personal.entries(spark.createDataFrame(rows, "user_id long, tick long, token_id string, starts boolean")).collect()
    assert {(x.context, x.token_id): [x["count"], x.last_seen] for x in got} == store.entries


def test_session_kinds_and_repeats():
    s = sessions.Store()
    for t, w in enumerate("x y z x y z x y".split()):
        s.commit("token", w, t)
    assert s.repeated() == ["z"] and "z" not in s.suggest(9)
    kept = s.snapshot()
    s.commit("unknown", None, 9)
    assert s.context == [] and not s.start and s.keys() == [""]
    other = sessions.Store(limit=3)
    other.commit("replace", kept, 0)
    assert len(other.entries) == 3 and all(s.entries[k] == v for k, v in other.entries.items())
    again = sessions.Store(s.dump())
    assert again.dump() == s.dump()


def test_session_list_with_the_model(spark, tmp_path):
    rows = [(1, t, "token", w) for t, w in enumerate("a b a b a".split())] + [(1, 9, "boundary", None)]
    df = spark.createDataFrame(rows, "user_id long, tick long, kind string, token string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    model = spark.createDataFrame([("", ["m0", "b"]), ("a", ["m1"]), ("b a", ["m2", "b"]), ("\n", ["start"])], "context string, words array<string>")
    shown = sessions.run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = sessions.with_model(shown, model).writeStream.format("memory").queryName("session").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {x.tick: list(x.session) for x in spark.table("session").collect()}
    assert got[0] == ["m1"] and got[4][:1] == ["m2"] and "b" not in got[4] and got[9][0] == "start"
    assert got[1] == ["m0", "b"]


def test_bounded_store():
    store = sessions.Store(limit=3)
    for t, w in enumerate("aabbc", 1):
        store.commit("token", w, t)
    assert len(store.entries) == 3
    store.commit("decay", None, 9)
    store.commit("boundary", None, 10)
    assert store.context == [] and store.start and all(n >= 1 for n, _ in store.entries.values())


def test_phonemes_and_confusions(spark):
    from bornoflow.functions import phonemes

    assert len(phonemes.PLAIN) == 32 and phonemes.distance("শ", "ষ") == 0 and phonemes.distance("ত", "থ") == 1 and phonemes.distance("ত", "ট") == 4 and phonemes.distance("চ", "শ") == 5
    assert phonemes.distance("ক", "ঙ") == 14 and phonemes.distance("ক", "a") is None
    lex = spark.createDataFrame([("মানুষ", 90_000), ("মানুষের", 100)], "word string, frequency long")
    got = autocorrect.suggest(spark.createDataFrame([("মানুশ",)], "query string"), lex).collect()
    assert (got[0].text, got[0].channel) == ("মানুষ", "edit_distance") and got[0].score == 11681 + 12_288


def test_fuzzy_and_prefix(spark):
    words = spark.createDataFrame([("abc", 3), ("abd", 2), ("ab", 9), ("xabc", 1), ("zzz", 1)], "word string, frequency long")
    got = {(r.left_word, r.right_word, r.distance) for r in lexicon.fuzzy_join(words.where("word = 'abc'"), words, 1).collect()}
    assert got == {("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("abc", "xabc", 1)}
    assert [r.word for r in lexicon.complete(spark.createDataFrame([("ab",)], "query string"), words, 2).orderBy("rank").collect()] == ["ab", "abc"]
