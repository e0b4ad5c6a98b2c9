"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit: principal axes and iterative quantisation (ITQ) on a bounded sample of FIT_ROWS unit vectors give ROTATIONS
rotations; the signs of the rotated components are a row's code. The radius is the RECALL quantile of the Hamming
distances between sample queries and their exact neighbours within the sample. Neighbours within all rows are nearer
than those within a sample, so the radius errs on the safe side.

Index: every row's code, vector and id, in blocks, as a table in the shared folder. A block's code is cut into
substrings of 16 bits, each with its own directory from value to rows.

Search: codes within radius r of a query agree with it to r // m bits in one of m substrings at least (pigeonhole).
Per substring and query the directory values within that distance are probed, which retrieves every code within the
radius; full codes are checked, and what is left is ranked by cosine on the original vectors in double precision. A
query with fewer than k found is searched again with twice the radius, at last over all rows.

Queries are broadcast in groups of a bounded size and probed against one block after the other.

Defined results: vectors null, zero, or holding null or non-finite components, and rows with a null id take no part;
shorter vectors count as padded with zeros; rows that share the query's id are not its candidates; of queries that
share an id the smallest vector is one; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, query_groups, usable

FIT_ROWS, FIT_QUERIES, ROTATIONS, ROUNDS, RECALL = 16_384, 512, 4, 25, 0.985
GROUP, BLOCK = 2048, 4096
SUB = 16


def unit(m):
    import numpy as np

    top = np.abs(m).max(axis=1, keepdims=True)
    scaled = m / np.where(top > 0, top, 1)
    return scaled / np.where(top > 0, np.linalg.norm(scaled, axis=1, keepdims=True), 1)


class Codes:
    """Learned rotations, and the radius that reaches the wanted recall."""

    def __init__(self, sample, k: int, recall: float = RECALL, rotations: int = ROTATIONS, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        x = unit(sample)
        d = x.shape[1]
        self.width, self.mean = d, x.mean(axis=0) if len(x) else np.zeros(d)
        z = x - self.mean
        axes = np.linalg.svd(z, full_matrices=False)[2].T if len(x) >= d else np.eye(d)
        turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
            v = z @ axes
            for _ in range(ROUNDS if len(x) else 0):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            turns.append(axes @ r)
        self.turn = np.hstack(turns)
        self.bits = -(-self.turn.shape[1] // 64) * 64
        self.radius = self.bits
        if len(x) > k + 1:
            at = rng.choice(len(x), min(FIT_QUERIES, len(x)), replace=False)
            s = x[at] @ x.T
            s[np.arange(len(at)), at] = -2
            near = np.argpartition(-s, k, axis=1)[:, :k]
            codes = self.encode(x)
            far = np.bitwise_count(codes[at][:, None] ^ codes[near]).sum(axis=2, dtype="i8")
            self.radius = int(np.quantile(far, recall, method="higher"))

    def encode(self, units):
        """Codes of unit vectors as rows of uint64."""
        import numpy as np

        if units.shape[1] < self.width:
            units = np.pad(units, ((0, 0), (0, self.width - units.shape[1])))
        side = (units[:, : self.width] - self.mean) @ self.turn > 0
        out = np.zeros((len(units), self.bits), bool)
        out[:, : side.shape[1]] = side
        return np.packbits(out, axis=1, bitorder="little").view("u8")


def index(rows: DataFrame, codes: Codes) -> DataFrame:
    """(n, ids, codes, vectors): every usable row, in blocks."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                ids, m = matrix(b.slice(k, BLOCK), codes.width)
                some = (m != 0).any(axis=1)
                ids, m = ids[some], m[some]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, codes.encode(unit(m)), m))], ["n", "ids", "codes", "vectors"])

    return written(rows.mapInArrow(run, "n int, ids binary, codes binary, vectors binary"), "index")


def probe(queries, codes, radius: int):
    """(query, row) pairs of all codes within the radius: substring directories first, then whole codes."""
    import numpy as np

    q16, c16 = queries.view("u2").reshape(len(queries), -1), codes.view("u2").reshape(len(codes), -1)
    m = c16.shape[1]
    near = np.zeros((len(queries), len(codes)), bool)
    for j in range(m):
        values, rows = np.unique(c16[:, j], return_inverse=True)  # the directory of substring j
        hit = np.bitwise_count(q16[:, j, None] ^ values) <= radius // m
        near |= hit[:, rows]
    a, b = np.nonzero(near)
    ok = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 20):
        cut = slice(s, s + (1 << 20))
        ok[cut] = np.bitwise_count(queries[a[cut]] ^ codes[b[cut]]).sum(axis=1, dtype="i8") <= radius
    return a[ok], b[ok]


def search(vectors: DataFrame, is_query: Column, k: int = 5, group: int = GROUP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found, ties to the smaller vec_id. recall 1 makes the radius reach all rows: exact."""
    import numpy as np

    spark = vectors.sparkSession
    rows = usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3))).limit(FIT_ROWS).select("embedding").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    width = max(len(x[0]) for x in sample)
    fit = np.zeros((len(sample), width))
    for i, x in enumerate(sample):
        fit[i, : len(x[0])] = x[0]
    codes = Codes(fit, k, min(recall, 1.0))
    if recall >= 1:
        codes.radius = codes.bits
    blocks = index(rows, codes)
    found = empty
    for ids, q in query_groups(rows.where(is_query), group):
        radius, left = codes.radius, np.arange(len(ids))
        while len(left):
            part = _ranked(spark, blocks, codes, ids[left], q[left], radius, k).checkpoint()
            full = np.array(sorted(x[0] for x in part.groupBy("query_id").count().where(F.col("count") >= k).collect()), "i8")
            short = left[~np.isin(ids[left], full)] if radius < codes.bits else left[:0]
            if len(short):  # what they found is found again
                part = part.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids[short]], "query_id long")), "query_id", "left_anti")
            found = found.unionByName(part.select("query_id", "rank", "vec_id", "score"))
            left, radius = short, min(codes.bits, 2 * radius + 1)
    return found


def _ranked(spark, blocks: DataFrame, codes: Codes, ids, q, radius: int, k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((ids, q, codes.encode(unit(q)), radius))

    def run(batches):
        import numpy as np

        ids, q, own, radius = sent.value
        kept = [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        for b in batches:
            for n, i, c, v in zip(*(b.column(x).to_pylist() for x in range(4))):
                rid, code, vec = np.frombuffer(i, "i8"), np.frombuffer(c, "u8").reshape(n, -1), np.frombuffer(v, "f8").reshape(n, -1)
                x, y = probe(own, code, radius)
                other = ids[x] != rid[y]
                x, y = x[other], y[other]
                w = max(q.shape[1], vec.shape[1])
                qs, vs = np.pad(q, ((0, 0), (0, w - q.shape[1]))), np.pad(vec, ((0, 0), (0, w - vec.shape[1])))
                qn, vn = np.sqrt((qs * qs).sum(1)), np.sqrt((vs * vs).sum(1))
                bad_q, bad_v = ~np.isfinite(qn) | (qn == 0), ~np.isfinite(vn) | (vn == 0)
                if bad_q.any() or bad_v.any():  # squares over- or underflow: rescale those rows, which leaves the cosine as it is
                    qs, vs = np.where(bad_q[:, None], unit(qs), qs), np.where(bad_v[:, None], unit(vs), vs)
                    qn, vn = np.where(bad_q, 1.0, qn), np.where(bad_v, 1.0, vn)
                s = np.concatenate([np.einsum("ij,ij->i", qs[x[p : p + 65536]], vs[y[p : p + 65536]]) for p in range(0, len(x), 65536)] or [np.zeros(0)]) / (qn[x] * vn[y])
                a, v_, s = (np.concatenate(z) for z in zip(kept, (x, rid[y], s)))
                order = np.lexsort((v_, -s, a))
                a, v_, s = a[order], v_[order], s[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1]) if len(a) else np.zeros(0, "i8")
                top = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
                kept = [a[top], v_[top], s[top]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0].astype("i8")]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "vec_id", "score"])

    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return blocks.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", ranked).where(F.col("rank") <= k)
