from bornoflow import engine
from bornoflow.operators import loanmining


def test_next_words(spark):
    e = engine.Engine(spark)
    text = [("s", i, 1, w.split()) for i, w in enumerate(["a b c", "a b c", "a b d", "x b c"])]
    vocab, ranked = e.model(spark.createDataFrame(text, "source string, document_id long, sentence_id int, tokens array<string>"), 20, 1, 4, "count")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["zzz"])], "context_id long, tokens array<string>")
    got = {(r.context_id, r["rank"]): r.token for r in e.next_words(asked, vocab, ranked, 2, "backoff").collect()}
    assert got[1, 1] == "c" and got[1, 2] == "d" and got[2, 1] == "a" and got[3, 1] == "b"


def test_sql_functions_and_commands(spark, capsys):
    engine.Engine(spark).register()
    assert spark.sql("SELECT bn_render('ami')").first()[0] == "আমি"
    assert engine.main(["strict", "biggan"]) == 0 and capsys.readouterr().out == "বিজ্ঞান\n"
    assert engine.main(["nothing"]) == 2
    good = {"vocabulary": 9, "bytes": 10, "eval": {"top5": 0.4}, "eval_per_source": {"a": {"gain": 0.0}}}
    assert engine.check_manifest(good, 9, 10, 0.3) == [] and len(engine.check_manifest({}, 9, 10, 0.3)) == 4


def test_loanword_mining(spark):
    lex = spark.createDataFrame([("টেবিল", 50), ("লাইসেন্স", 100), ("আমি", 9)], "word string, frequency long")
    pairs = spark.createDataFrame([("Table", "টেবিল", "a"), ("table", "টেবিল", "b"), ("!", "আমি", "a"), ("x ray", "abc", "a"), ("pen", "পেন", "b")], "english string, bangla string, evidence string")
    assert [tuple(r) for r in loanmining.direct(pairs, lex).collect()] == [("table", "টেবিল", 50, ["a", "b"])]
    assert {(r.reason, r.n) for r in loanmining.rejects(pairs, lex).collect()} == {("english_key", 1), ("not_bangla", 1), ("not_in_lexicon", 1)}
    probes = loanmining.probe(spark.createDataFrame([("table",), ("license",)], "english string"), lex)
    assert {(r.english, r.word) for r in probes.where("rank = 1").collect()} == {("table", "টেবিল"), ("license", "লাইসেন্স")}
