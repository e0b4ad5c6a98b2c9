"""Packed grams against the general operators: small pieces, so that words go on from one to the next."""

import random

import pytest
from pyspark.sql import functions as F

from bornoflow.operators import ngrams, nextword, packed
from bornoflow.plans.tables import written


@pytest.fixture(scope="module")
def encoded(spark):
    r = random.Random(7)
    ids = lambda: [1] + [r.choice([2, 3, 3, 3, 4, 4, 5, 6, 7, r.randrange(2, 40), 32767]) for _ in range(r.choice([1, 2, 3, 5, 30]))]
    rows = [(r.choice(["a", "b", None]), d, 1, ids()) for d in range(400)] + [("a", 900, 1, []), ("a", 901, 1, [1]), ("b", 902, 1, [1, 0, 3, 4, 1, 5])]
    own = written(spark.createDataFrame(rows, "source string, document_id long, sentence_id int, ids array<int>").repartition(3), "test")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    yield own
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def show(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


def ranked(own, k=16):
    return {o: ngrams.top_candidates(ngrams.counts(own, o).withColumn("score", F.col("count")), o, k) for o in (1, 2, 3, 4)}


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("mode", ["kneser-ney", "modified-kneser-ney"])
def test_kneser_ney(encoded, order, mode):
    want = ngrams.scored({o: ngrams.counts(encoded, o) for o in range(1, order + 1)}, order, mode)
    got = packed.kneser_ney(encoded, order, mode[0] == "m", write=written, piece_rows=10)
    assert got.schema.simpleString() == want.schema.simpleString() and show(got) == show(want)


@pytest.mark.parametrize("policy", ["backoff", "reserved", "merge"])
def test_suggestions(encoded, policy):
    contexts = nextword.positions(encoded).select("c1", "c2", "c3").distinct()
    want = nextword.suggest(contexts, ranked(encoded), 10, policy).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))
    got = packed.suggestions(encoded, policy, piece_rows=10)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # one shuffle for all orders and contexts
    assert show(got) == show(want, "c1", "c2", "c3", "ids")


@pytest.mark.parametrize("highest", [2, 4])
def test_evaluated(encoded, highest):
    train, held = encoded.where("document_id % 3 > 0"), encoded.where("document_id % 3 = 0")
    names = ["source", "c1", "c2", "c3", "target", "rank"]
    want = nextword.ranks(nextword.positions(held), {o: t for o, t in ranked(train).items() if o <= highest})
    got = packed.evaluated(train, held, highest, piece_rows=10)
    assert show(got.groupBy(*names).agg(F.sum("weight"))) == show(want.groupBy(*names).count())
    assert show(nextword.metrics(got, "source")) == show(nextword.metrics(want, "source"))
    assert show(nextword.top_missed(got)) == show(nextword.top_missed(want))
    assert show(nextword.metrics(packed.evaluated(train, held.limit(0)))) == show(nextword.metrics(want.limit(0)))


def test_ids_beyond_the_bits_are_an_error(spark):
    own = spark.createDataFrame([("a", 1, 1, [1, 32768])], "source string, document_id long, sentence_id int, ids array<int>")
    with pytest.raises(Exception, match="ids beyond 15 bits"):
        packed.unigrams(own)
