"""Vectors in Arrow batches, and query groups of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch, least: int = 0):
    """(ids, rows as float64) of a batch (id, list of numbers), without rows that are null or hold null or non-finite components.

    Shorter vectors are padded with zeros to the longest of the batch, or to `least` components.
    """
    import numpy as np

    ids, lists = batch.column(0), batch.column(1)
    there = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    size = np.where(there, np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))), 0).astype("i8")
    flat = np.asarray(lists.flatten().cast("float64").to_numpy(zero_copy_only=False), dtype="f8")  # nulls become NaN
    width = max(least, int(size.max(initial=0)))
    row = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    out = np.zeros((len(size), width))
    out[row, np.arange(len(row)) - start[row]] = flat
    good = there & np.isfinite(out).all(axis=1)
    return np.asarray(ids.fill_null(0))[good].astype("i8"), out[good]


def query_groups(queries: DataFrame, size: int):
    """(ids, rows) of at most `size` queries (vec_id, embedding) each, in order of vec_id: what one pass over all rows broadcasts.

    Of rows that share a vec_id one is a query. Rows come to the driver a partition at a time.
    """
    import numpy as np

    one = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id")
    ids, rows = [], []

    def close():
        width = max(map(len, rows))
        out = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return np.array(ids, "i8"), out

    for x in one.toLocalIterator():
        ids.append(x[0])
        rows.append(x[1])
        if len(ids) == size:
            yield close()
            ids, rows = [], []
    if ids:
        yield close()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without the rows that take no part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False)))
