"""Exact top-k search by distributed histogram selection.

Queries go in groups of a bounded size; a group's matrix is broadcast and all rows are scored against it in blocks.
Each pass narrows, for every query, the bin of scores that holds the k-th highest: tasks count scores per bin, combine
the counts, and the running sum from the top names the bin. A task sends only the bins from its own top down to where
its counts reach k, since the k-th value of all is no lower than that of a part; so a task sends at most k rows a query
and pass. When the bin holds one value, or few enough rows lie in it or above, a last pass keeps the rows at or above
it, each task at most k a query by (score, smaller id), and these are ranked.

Defined results: vectors null, or holding null or non-finite components, and rows with a null id take no part; shorter
vectors count as padded with zeros; rows that share the query's id are not its candidates; of queries that share an id
the smallest vector is one; scores outside 64 bits saturate; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, query_groups, usable

SCALE, BINS, GROUP, BLOCK = 1024.0, 1024, 2048, 2048
EXACT = float(1 << 53)


def scores(queries, rows):
    """Integer inner products (len(rows), len(queries)) of the quantised components."""
    import numpy as np

    width = max(queries.shape[1], rows.shape[1])
    q, r = (np.pad(np.floor(SCALE * m), ((0, 0), (0, width - m.shape[1]))) for m in (queries, rows))
    top = np.abs(q).sum(1).max(initial=0.0) * np.abs(r).max(initial=0.0)
    if top < EXACT:
        return np.rint(r @ q.T).astype("i8")
    exact = r.astype(object) if top < 1e300 else np.vectorize(int, otypes=[object])(r)
    exact = np.vectorize(int, otypes=[object])(exact) @ np.vectorize(int, otypes=[object])(q).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype("i8")


def search(vectors: DataFrame, is_query: Column, k: int = 10, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest scores, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    found = None
    for ids, q in query_groups(rows.where(is_query), group):
        part = _group(spark, rows, ids, q, k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _group(spark, rows: DataFrame, ids, q, k: int) -> DataFrame:
    import numpy as np

    sent = spark.sparkContext.broadcast((ids, q))
    low = np.full(len(ids), -(2**63), dtype=object)  # the k-th highest score lies at or above low and below high
    high = np.full(len(ids), 2**63, dtype=object)
    above = np.zeros(len(ids), "i8")  # scores at or above high
    width = max(1, -(-(2**64) // BINS))
    bound = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0]
    if bound is not None:
        most = [int(x) + 1 if x < 2.0**62 else 2**63 for x in np.abs(np.floor(SCALE * q)).sum(1) * (SCALE * bound + 1)]
        low, high = np.array([-m for m in most], dtype=object), np.array([min(m + 1, 2**63) for m in most], dtype=object)
    done = np.zeros(len(ids), bool)
    while not done.all():
        width = np.array([max(1, -(-(h - lo) // BINS)) for lo, h in zip(low, high)], dtype=object)
        counted = _histogram(rows, sent, low.astype("i8"), np.minimum(high - 1, 2**63 - 1).astype("i8"), np.minimum(width, 2**62).astype("i8"), k)
        order = Window.partitionBy("q").orderBy(F.desc("bin"))
        sums = counted.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
        hit = {}
        for x in sums.join(F.broadcast(spark.createDataFrame([(i, int(k - a)) for i, a in enumerate(above)], "q int, need long")), "q").where("upto >= need").groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("x")).collect():
            hit[x.q] = x.x
        for i in range(len(ids)):
            if done[i]:
                continue
            if i not in hit:  # fewer than k candidates: all of them
                done[i] = True
                continue
            b, n, upto = hit[i].bin, hit[i].n, hit[i].upto
            top = low[i] + (b + 1) * width[i]
            low[i], high[i] = low[i] + b * width[i], min(high[i], top)
            done[i] = width[i] == 1 or above[i] + upto <= 4 * k
            above[i] += upto - n
    return _collect(rows, sent, low.astype("i8"), k)


def _blocks(batches, width: int):
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            ids, m = matrix(b.slice(k, BLOCK), width)
            if len(ids):
                yield ids, m


def _histogram(rows: DataFrame, sent, low, high, width, k: int) -> DataFrame:
    """(q, bin, n): counts of scores in [low, high] by bin, from the top down to where a task's counts reach k."""

    def run(batches):
        import numpy as np

        ids, q = sent.value
        total = np.zeros((len(ids), BINS), "i8")
        for own, m in _blocks(batches, q.shape[1]):
            s = scores(q, m)
            inside = (s >= low) & (s <= high) & (own[:, None] != ids)
            r, c = np.nonzero(inside)
            total += np.bincount(c * BINS + np.minimum((s[r, c].view("u8") - low[c].view("u8")) // width[c].view("u8"), BINS - 1).astype("i8"), minlength=total.size).reshape(total.shape)
        down = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        i, b = np.nonzero((total > 0) & (down - total < k))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(total[i, b])], ["q", "bin", "n"])

    return rows.mapInArrow(run, "q int, bin int, n long")


def _collect(rows: DataFrame, sent, low, k: int) -> DataFrame:
    def run(batches):
        import numpy as np

        ids, q = sent.value
        kept = [np.zeros(0, "i8")] * 3

        def best(i, v, s):
            order = np.lexsort((v, np.invert(s), i))
            i, v, s = i[order], v[order], s[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1]) if len(i) else np.zeros(0, "i8")
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            return [x[place < k] for x in (i, v, s)]

        for own, m in _blocks(batches, q.shape[1]):
            s = scores(q, m)
            r, c = np.nonzero((s >= low) & (own[:, None] != ids))
            kept = best(*(np.concatenate(x) for x in zip(kept, (c, own[r], s[r, c]))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0].astype("i8")]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "vec_id", "score"])

    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
