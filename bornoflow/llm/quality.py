"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Features are counts and ratios of a whole text, each text in one vectorised look at its bytes and words. Training works
on bins of a bounded sample of labelled documents (SAMPLE_ROWS, those of smallest hash): in turn, feature after feature
and round after round, a shallow tree over one feature's bins takes a small step against the logistic loss, and adds to
that feature's lookup table. Then the pairs of features with the largest gain left get tables over coarser bins, boosted
in turn by the same trees on two features. A score is the sum of the tables at the document's bins, through the logistic
function: additions of table entries and nothing else. Tables have a fixed size and go to the executors as such.

Defined results: null texts count as empty; empty texts have a score like any other; labels other than 0 and 1, null
labels or ids take no part, and contradictory labels of one document count by their mean, halves dropped; without
labels, or with labels of one kind, scores are the smoothed share of label 1; repeated rows have equal scores; a null
doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_ROWS, BINS, COARSE = 16_384, 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 250, 80, 8, 0.1
FOLDS, HELD, THRESHOLD = 5, 0, 0.3
NAMES = (
    "words", "bytes_per_word", "upper", "digits", "signs", "exclaim", "bars", "brackets", "distinct_words", "top_word", "short_words", "long_words",
    "words_per_line", "copied_lines", "line_ends", "capital_words", "shouted_words", "squeezed", "non_ascii", "lower_start",
)


def features(text: str) -> list[float]:
    import zlib
    from collections import Counter

    import numpy as np

    b = text.encode("utf-8", "surrogatepass")
    size = max(1, len(b))
    n = np.bincount(np.frombuffer(b, "u1"), minlength=256)
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    upper, digits, lower = n[65:91].sum(), n[48:58].sum(), n[97:123].sum()
    signs = n[33:127].sum() - upper - digits - lower
    lengths = np.fromiter(map(len, counts), "i8", len(counts))
    times = np.fromiter(counts.values(), "i8", len(counts))
    capital = sum(c for w, c in counts.items() if w[:1].isupper())
    shouted = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
    return [
        np.log1p(len(words)), len(b) / k, upper / size, digits / size, signs / size, n[33] / size, n[124] / size, (n[60] + n[62] + n[123] + n[125] + n[91] + n[93]) / size,
        len(counts) / k, (times.max() if len(times) else 0) / k, times[lengths <= 3].sum() / k, times[lengths >= 14].sum() / k,
        len(words) / m, 1 - len(set(lines)) / m, sum(x.rstrip().endswith((".", "!", "?", ":", '"')) for x in lines) / m, capital / k, shouted / k,
        len(zlib.compress(b, 1)) / size, n[128:].sum() / size, sum(x[:1].islower() for x in lines) / m,
    ]


class Model:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, x, y):
        import numpy as np

        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, COARSE + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list = []
        if len(y) == 0 or y.min() == y.max():
            return
        bins, f = self.bins(x), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                step = RATE * _tree(*_sums(bins[j], f, y, len(table)))
                table += step
                f += step[bins[j]]
        rough = self.bins(x, True)
        gains = []
        for i in range(len(rough)):
            for j in range(i):
                shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                gains.append((_tree2(*(s.reshape(shape) for s in _sums(rough[i] * shape[1] + rough[j], f, y, shape[0] * shape[1])))[1], i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                at = rough[i] * table.shape[1] + rough[j]
                step = RATE * _tree2(*(s.reshape(table.shape) for s in _sums(at, f, y, table.size)))[0]
                table += step
                f += step.reshape(-1)[at]

    def bins(self, x, coarse: bool = False):
        import numpy as np

        return [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse if coarse else self.edges, x.T)]

    def score(self, x):
        """Scores from 0 to 1 of rows of features."""
        import numpy as np

        f = np.full(len(x), self.base)
        for b, table in zip(self.bins(x), self.tables):
            f += table[b]
        rough = self.bins(x, True)
        for i, j, table in self.pairs:
            f += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _sums(bins, f, y, size: int):
    """Gradient and curvature of the logistic loss, summed by bin."""
    import numpy as np

    p = 1 / (1 + np.exp(-f))
    return np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size)


def _split(g, h):
    """(gain, cut): the best cut of bins into two runs."""
    import numpy as np

    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g, h):
    """Leaf values of a tree of depth two over successive bins."""
    import numpy as np

    _, a = _split(g, h)
    cuts = sorted({0, a, a + _split(g[a:], h[a:])[1], _split(g[:a], h[:a])[1], len(g)})
    out = np.zeros(len(g))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _tree2(g, h):
    """(leaf values, gain) of a tree over two features: one cut of the first, and in each part one of the second, or the other way round."""
    import numpy as np

    best = (np.zeros(g.shape), 0.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, cut = _split(a.sum(1), b.sum(1))
        out, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + 1)
        for rows in (slice(0, cut), slice(cut, None)):
            _, c = _split(a[rows].sum(0), b[rows].sum(0))
            for cols in (slice(0, c), slice(c, None)):
                s, t = a[rows, cols].sum(), b[rows, cols].sum()
                out[rows, cols] = s / (t + 1)
                gain += s * s / (t + 1)
        if gain > best[1]:
            best = (out.T if turned else out, float(gain))
    return best


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _features(docs: DataFrame, *more: str) -> DataFrame:
    """(*more, x): x the features of text."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, b_text):
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b_text)), pa.array([features(t or "") for t in b.column(b_text).to_pylist()], pa.list_(pa.float64()))], [*more, "x"])

    b_text = len(more)
    rows = docs.select(*more, "text")
    return rows.mapInArrow(run, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more] + ["x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled documents that are not held out, those whose id has the smallest hash."""
    import numpy as np

    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    sample = known.where("label <> 0.5").select("doc_id", F.round("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows narrow rows
    rows = _features(chosen, "label").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES))
    y = np.array([r.label for r in rows])
    order = np.lexsort(x.T)  # the sums of training don't depend on the order in which rows arrive
    return Model(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id and score. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        for whole in batches:
            for b in slices(whole, 1):
                x = np.array([features(t or "") for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 where score >= threshold)."""
    scored = score(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least threshold, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    place = docs.columns.index("text")

    def run(batches):
        import numpy as np

        for whole in batches:
            for b in slices(whole, place):
                x = np.array([features(t or "") for t in b.column(place).to_pylist()]).reshape(b.num_rows, len(NAMES))
                yield b.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
