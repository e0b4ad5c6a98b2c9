"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: each text's word shingles are hashed with XXH64 (seed 42), repeats included; a bit is set where it is
set in over half of the hashes. Distinct fingerprints are then compared, each standing for all its documents.

Candidates: the 64 bits are cut into 5 parts. Fingerprints that differ in at most 3 bits agree in 2 parts or more, so
each fingerprint is sent under its 10 pairs of parts (25 or 26 equal bits), and any link meets under one of these keys.
Within a task the rows are sorted by key and their bits stored vertically: plane b holds bit b of 64 successive
rows in one word. The sequence is compared with itself shifted by 1, 2, ... rows; for each shift, carry-save counters
(ones, twos, four or more) take up one plane after the other, and words in which every pair has passed the radius are
abandoned. One word operation thus advances 64 comparisons. Only links between roots leave the task, never all pairs.

A key that more than CHUNK fingerprints share is cut into chunks, and each pair of chunks is its own group, so that no
task holds an unbounded group and no link is lost.

Defined results: a null or wordless text has fingerprint zero and links like any other; texts of fewer words than a
shingle have one shingle, the whole sequence; repeated rows fall into one component; a null doc_id takes no part in
the choice of the smallest doc_id, and a component of none but null ids has a null component_id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, slices, written
from .components import connected

SHINGLE, RADIUS = 3, 3
PARTS = (13, 13, 13, 13, 12)
CHUNK = 8192


def fingerprint(texts: list[str], shingle: int = SHINGLE):
    """The 64-bit fingerprints of lower-cased texts, as a numpy array of uint64."""
    import re

    import numpy as np
    import xxhash

    split, h = re.compile(WORD).findall, xxhash.xxh64_intdigest
    out = np.zeros(len(texts), "u8")
    for i, text in enumerate(texts):
        w = split(text)
        if len(w) > shingle:
            grams = zip(*[w[k:] for k in range(shingle)])
            hashes = [h(g, 42) for g in map(" ".join, grams)]
        elif w:
            hashes = [h(" ".join(w), 42)]
        else:
            continue
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        out[i] = np.packbits(2 * bits.sum(0, dtype="i8") > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row per row of docs; fp holds the unsigned fingerprint's bits."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint(b.column(1).to_pylist(), shingle).view("i8"), pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def sliced_links(fp, group, radius: int = RADIUS):
    """Yield arrays (i, j), i < j, of the rows of one group (equal successive values of `group`) that differ in at most `radius` bits, 3 or fewer."""
    import numpy as np

    n = len(fp)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    last = np.repeat(starts + sizes, sizes)  # the end of each row's group
    words = (n + 63) // 64 + 2
    planes = np.zeros((64, words), "u8")
    for b in range(64):
        packed = np.packbits(((fp >> np.uint64(b)) & np.uint64(1)).astype("u1"), bitorder="little")
        planes[b].view("u1")[: len(packed)] = packed
    full = ~np.uint64(0)
    for shift in range(1, int(sizes.max())):
        pairs = np.zeros(words * 64, "u1")
        pairs[: n - shift] = last[: n - shift] > np.arange(shift, n)
        done = ~np.packbits(pairs, bitorder="little").view("u8")  # pairs that aren't in one group, or have passed the radius
        at = np.flatnonzero(done != full)
        if not len(at):
            continue
        past, q, s = done[at], shift // 64, np.uint64(shift % 64)
        ones, twos = np.zeros(len(at), "u8"), np.zeros(len(at), "u8")
        lo, hi = np.minimum(at + q, words - 1), np.minimum(at + q + 1, words - 1)
        for b in range(64):
            p = planes[b]
            d = p[at] ^ ((p[lo] >> s) | (p[hi] << (np.uint64(64) - s)) if s else p[lo])
            carry = ones & d
            ones ^= d
            past |= twos & carry
            twos ^= carry
            if b % 8 == 7:
                left = past != full
                if not left.all():
                    at, past, ones, twos, lo, hi = at[left], past[left], ones[left], twos[left], lo[left], hi[left]
                    if not len(at):
                        break
        if len(at):
            if radius < 3:
                past |= {2: ones & twos, 1: twos, 0: ones | twos}[radius]
            w, bit = np.nonzero(np.unpackbits((~past).view("u1").reshape(-1, 8), axis=1, bitorder="little"))
            i = at[w] * 64 + bit
            yield i, i + shift


def stars(fp, group, radius: int = RADIUS):
    """Each row's representative: rows linked within their group, directly or not, share one."""
    import numpy as np

    root = np.arange(len(fp))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in sliced_links(fp, group, radius):
        new = root[i] != root[j]
        if new.any():
            for a, b in zip(i[new].tolist(), j[new].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            while (root != root[root]).any():
                root = root[root]
    return root


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join all those fingerprints of `distinct` (fp; no repeats) that differ in at most `radius` bits."""
    import itertools

    offsets = list(itertools.accumulate((0, *PARTS)))
    keys = []
    for t, (x, y) in enumerate(itertools.combinations(range(len(PARTS)), 2)):
        part = [F.shiftrightunsigned("fp", offsets[k]).bitwiseAND((1 << PARTS[k]) - 1) for k in (x, y)]
        keys.append(F.lit(t << 26).cast("long").bitwiseOR(F.shiftleft(part[0], 13)).bitwiseOR(part[1]))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, mine) * 65536 + F.greatest(k, mine))
    cut = rows.join(large, "key", "left").select("fp", F.col("key"), F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(every)).alias("pair"))
    cut = cut.select("fp", F.shiftleft("key", 32).bitwiseOR(F.col("pair").cast("long")).alias("g"))
    sorted_ = cut.repartition("g").sortWithinPartitions("g")

    def run(batches):
        import numpy as np

        fp, g = np.zeros(0, "u8"), np.zeros(0, "i8")

        def emit(fp, g):
            root = stars(fp, g, radius)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at].view("i8")), pa.array(fp[root[at]].view("i8"))], ["a", "b"])

        for b in batches:
            fp = np.concatenate([fp, b.column(0).to_numpy().view("u8")])
            g = np.concatenate([g, b.column(1).to_numpy()])
            if len(g) > 200_000 and g[0] != g[-1]:
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield emit(fp[:cut], g[:cut])
                fp, g = fp[cut:], g[cut:]
        if len(g):
            yield emit(fp, g)

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable by links)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected(links(distinct.select("fp"), radius, chunk))
    owner = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    each = owner.select("fp", "root").join(best, "root").select("fp", "component_id")
    return prints.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
