"""Plans whose work and memory follow the input: what tasks hold, what is compared, what is worked out once."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bornoflow.functions import text as T
from bornoflow.operators import personal


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_committed_words(spark):
    rows = [(1, 0, "One two."), (1, 1, None), (1, 2, "..."), (1, 5, "three Four"), (1, 3, "five"), (2, 1, "b"), (2, 0, "a"), (None, 0, "n m"), (3, 0, "x y"), (3, 0, "p q r")]
    turns = spark.createDataFrame(rows, "user_id long, turn int, text string")
    got = sorted(map(tuple, personal.committed(turns).collect()), key=str)
    of = lambda u: [t for _, t in sorted((n, t) for v, n, t in got if v == u)]
    assert of(1) == ["one", "two", "five", "three", "four"] and of(2) == ["a", "b"] and of(None) == ["n", "m"]
    assert [n for v, n, _ in got if v == 1] == [1, 2, 3, 4, 5]
    assert of(3) in (["x", "p", "y", "q", "r"], ["p", "x", "q", "y", "r"])  # turns of one number, word by word
    assert personal.committed(turns.limit(0)).count() == 0


def test_users_stay_in_partitions_that_follow_the_text(spark):
    turns = spark.range(4000).select((F.col("id") % 500).alias("user_id"), (F.col("id") / 500).cast("int").alias("turn"), F.lit("a b c " * 20).alias("text"))
    words = personal.committed(turns, task_bytes=10_000)
    store = personal.evicted(personal.entries(words), 50)
    assert store.rdd.getNumPartitions() == 48  # 480,000 bytes of text; not coalesced by what is shuffled
    assert exchanges(store) == 1  # texts, once; no words
    old = turns.select("user_id", "turn", F.posexplode(T.latin_tokens(F.col("text"))).alias("i", "token_id"))
    old = old.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("turn", "i")).alias("tick"), "token_id")
    assert words.schema == old.schema and words.exceptAll(old).count() == 0 and words.count() == old.count()


def test_fuzzy_join_of_a_few_words(spark):
    from bornoflow.operators import lexicon

    words = ["", "a", "ab", "abc", "bac", "abcd", "abcdefgh", "abcdxfgh", "bcdefgh", "ক", "কখ", "কখগ", None, "abc"]
    right = spark.createDataFrame([(w,) for w in words], "word string")
    for left in (right, right.where("word in ('abc', 'abcdefgh', 'ক')"), right.where("word is null")):
        for d in (1, 2):
            show = lambda few: sorted(map(tuple, lexicon.fuzzy_join(left, right, d, few).collect()))
            assert show(256) == show(0)
    few = lexicon.fuzzy_join(right.limit(3), spark.range(1000).select(F.repeat(F.lit("ab"), 200).alias("word")), 2)
    assert "Generate explode(array_distinct" not in few._jdf.queryExecution().optimizedPlan().toString()  # right words of 400 letters have 80,000 deletions each


def test_lexicon_words_are_rendered_once(spark, tmp_path):
    from bornoflow.plans import catalog

    docs = spark.createDataFrame([(1, "ami tumi ami ami bhalo"), (2, "tumi ami x")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lex = catalog._bangla_lexicon(spark, str(tmp_path))
    assert "rendered(" not in lex._jdf.queryExecution().optimizedPlan().toString()  # neither per token nor twice per word
    assert {x.word: x.frequency for x in lex.collect()}["আমি"] == 4


def test_merge_counts_words_without_users(spark, tmp_path):
    from bornoflow.plans import catalog

    rows = [(1, 0, "a b c d e f"), (1, 1, "a b a b"), (2, 0, "b c b"), (3, 0, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.personal_merge(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3  # the users' last words, the users, and their stores; the model takes words as they are read
    assert [x.token_id for x in got.where("user_id = 2").orderBy("rank").collect()] == ["b", "a", "c", "d", "e"]


def test_texts_are_rendered_slice_by_slice(spark):
    import tracemalloc

    import pyarrow as pa

    from bornoflow.operators import transliteration as X

    texts = pa.array(["ami banglay gan gai. " * 2000, None, ""] * 300)
    X.rendered_array(texts.slice(0, 3))
    tracemalloc.start()
    got = X.rendered_array(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6 and got.nbytes > 30e6  # Python's own memory; Arrow's is not traced
    assert got.to_pylist()[:3] == [X.render_text(texts[0].as_py()), None, ""] and len(got) == 900
    assert X.rendered_array(pa.array([], pa.string())).to_pylist() == []


def test_skeletons_are_made_of_words_not_of_their_occurrences(spark):
    from bornoflow.operators import lexicon

    docs = spark.createDataFrame([("Phone fone phone schachck quick zoo cycle accept xylo",), ("fon bb",)], "text string")
    words = lexicon.frequencies(docs)
    for join in (lexicon.skeleton_join, lexicon.fuzzy_skeleton_join):
        plan = join(words, words)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            assert "sch|sh|ch" not in line or "Generate explode(array(" in line and line.count("sch|sh|ch") == 1, line
    got = {(r.left_word, r.right_word) for r in lexicon.skeleton_join(words, words).collect()}
    assert got == {(a, b) for a in ("phone", "fone", "fon") for b in ("phone", "fone", "fon") if a != b}
    sk = spark.createDataFrame([(w,) for w in ("schhx", "accent", "ckphgh", "qucey", "tthh", "")], "w string").select(T.english_skeleton(F.col("w"))).collect()
    assert [r[0] for r in sk] == ["sks", "ksnt", "kfg", "ks", "t", ""]
