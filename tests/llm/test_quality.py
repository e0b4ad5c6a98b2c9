import random
import zlib

from bornoflow.llm import quality

from .test_core import awkward, table


def docs_and_labels(spark):
    r = random.Random(8)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "Etiam", "sed"]
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = " ".join(r.choice(words) for _ in range(r.randrange(20, 80)))
        rows.append((i, text + "." if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    rows += [(j + 10_000, t) for j, (_, t) in enumerate(awkward())] + [(None, "x y")]
    labels += [(None, 1, 0), (3, None, 0), (4, 7, None), (5, 0, 0), (5, 1, 0), (999_999, 1, 0)]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, dict((i, q) for i, q, _ in labels[:600])


def test_held_out_accuracy(spark):
    docs, labels, rows, truth = docs_and_labels(spark)
    got = quality.classify(docs.repartition(3), labels).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
    held = [(x.predicted, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) > 0.97 * len(held)
    again = {x.doc_id: x.score for x in quality.classify(docs.repartition(2), labels).collect() if x.doc_id is not None}
    assert all(abs(again[x.doc_id] - x.score) < 1e-12 for x in got if x.doc_id is not None and x.doc_id < 600)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in got)


def test_no_labels_and_no_rows(spark):
    docs, labels, _, _ = docs_and_labels(spark)
    assert {x.score for x in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert len({x.score for x in quality.classify(docs, labels.where("quality = 1")).collect()}) == 1
    assert quality.classify(table(spark, []), labels).count() == 0
