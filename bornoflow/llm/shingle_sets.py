"""Links between texts whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

Each text's distinct shingles are hashed; BANDS bands of ROWS minimum hashes each are its keys. A pair of similarity 0.8
shares none of its keys with probability (1 - 0.8^ROWS)^BANDS, 2.6e-5. Texts that share a key are compared on the shingles
themselves, in two rounds: first each with the smallest text of its key, then, where a key's texts are not all connected by
what was found, each of those that the smallest's component leaves out with all of the key that it isn't connected with. So a
group of thousands of similar copies costs as many comparisons as it has texts, and no component is lost; texts of one
key that are unlike are compared with all others of it. A text of fewer words than a shingle has one shingle, the whole
sequence; one without words, a null or empty text has no link. Repeated rows of a key are one; an empty table has no links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_hash
from .common import slices, written
from .components import connected

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
SLICE = 1_500_000  #: bytes of text whose words, hashes and shingles are held in arrays at once
CACHED = 65_536  #: shingles that are worked on at once, so that they stay in the processor's cache


def shingles(texts, shingle: int = SHINGLE):
    """(hashes of the shingles of all texts of an Arrow array, A-Z lower-cased and repeats included; how many each text has)."""
    import numpy as np

    data, bounds = word_hash.texts([texts])
    data = np.frombuffer(word_hash.LOWER, "u1")[data]
    starts, lengths, words = word_hash.split(data, bounds)
    h = word_hash.hashes(data, starts, lengths)
    size = np.where(words > 0, np.maximum(1, words - shingle + 1), 0)
    ends = np.cumsum(words)
    at = np.repeat(ends - words - (np.cumsum(size) - size), size) + np.arange(size.sum())
    last = np.repeat(ends, size)
    out = np.zeros(len(at), "u8")
    padded = np.append(h, np.zeros(shingle, "u8"))
    for k in range(shingle):
        out = out * np.uint64(word_hash.K1) + np.where(at + k < last, padded[at + k], 0)
    return word_hash._mixed(out), size


def bands(hashes, size):
    """The keys of texts that have some shingles each: an array of int64, texts by BANDS."""
    import numpy as np

    r = np.random.default_rng(5)
    odd, add = (r.integers(0, 2**64, BANDS * ROWS, "u8", endpoint=False) for _ in range(2))
    ends = np.cumsum(size)
    least = np.full((BANDS * ROWS, len(size)), ~np.uint64(0))
    for a in range(0, len(hashes), CACHED):
        part = hashes[a : a + CACHED]
        i, j = np.searchsorted(ends, [a, a + len(part) - 1], side="right")
        cuts = np.maximum(ends[i : j + 1] - size[i : j + 1], a) - a
        for k in range(BANDS * ROWS):
            least[k, i : j + 1] = np.minimum(least[k, i : j + 1], np.minimum.reduceat(part * (odd[k] | np.uint64(1)) + add[k], cuts))
    keys = np.zeros((BANDS, len(size)), "u8")
    for k in range(BANDS * ROWS):
        keys[k // ROWS] = word_hash._mixed((keys[k // ROWS] ^ least[k]) * np.uint64(word_hash.K1) + np.uint64(k // ROWS + 1))
    return keys.T.copy().view("i8")


def _freed(batches):
    """The batches, with what Arrow keeps of earlier ones given back to the system: workers live on beside others."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets (key, own) are similar."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("t")), "b")
    both = both.where(F.least(F.size("s"), F.size("t")) >= SIMILARITY * F.greatest(F.size("s"), F.size("t")) - 1e-9).withColumn("both", F.size(F.array_intersect("s", "t")))
    return both.where(F.col("both") >= SIMILARITY * (F.size("s") + F.size("t") - F.col("both")) - 1e-9).select("a", "b")


def links(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of keys of those texts (key long, a function of the text; text) that are similar; they connect all that similar pairs connect."""
    rows = texts.select("key", "text")

    def send(batches):
        import numpy as np

        for whole in _freed(batches):
            for x in slices(whole, 1, SLICE):
                h, size = shingles(x.column(1))
                some = np.flatnonzero(size)
                if len(some):
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(some)), pa.FixedSizeListArray.from_arrays(pa.array(bands(h, size[some]).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))], ["key", "bands"])

    def sets_of(batches):
        import numpy as np

        for whole in _freed(batches):
            for x in slices(whole, 1, SLICE):
                h, size = shingles(x.column(1))
                own = [np.unique(p).view("i8") for p in np.split(h, np.cumsum(size)[:-1])]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(own, pa.list_(pa.int64()))], ["key", "own"])

    keyed = written(rows.mapInArrow(send, "key long, bands array<long>").select("key", F.explode("bands").alias("band")).distinct(), "bands")
    hubs = keyed.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    shared = written(keyed.join(hubs, "band"), "shared")  # the texts of keys that others have too
    wanted = shared.select("key").distinct()
    once = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = written(once.mapInArrow(sets_of, "key long, own array<long>"), "sets")
    first = written(_similar(shared.where("hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), sets), "similar")
    roots = connected(first)
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "hub", F.coalesce("root", "key").alias("root"))
    own = placed.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("main")), "hub", "left").withColumn("main", F.coalesce("main", "hub"))
    rest = own.where("root <> main").select("band", F.col("key").alias("x"), F.col("root").alias("of"))
    cross = rest.join(placed.where("key <> hub"), "band").where("of <> root").select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct()
    return first.unionByName(_similar(cross, sets))
