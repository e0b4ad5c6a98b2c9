"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, repeated windows merged into removal intervals.

Plan, over all windows of all documents:

1. Each input partition is cut into blocks of about BLOCK_WORDS words. A block hashes all its windows with a rolling
   polynomial over 64-bit word hashes and sends each distinct hash once, with the smallest document id that has it in
   the block, packed with delta coding into one binary row per hash bucket. So a passage that a third of all documents
   share arrives at its reducer once per block and not once per document.
2. A bucket's reducer finds the smallest document id of each hash over all blocks and answers each block with one bit
   per hash sent: does it also start in a smaller document elsewhere? A block's answers become one small file in the
   shared folder.
3. The blocks are formed again. A window goes if the block itself has a smaller document with it, or if the answer says
   so of the block's smallest. Removed windows merge into maximal intervals, and the other words stay.

Texts are never shuffled. Step 3 needs the blocks of step 1 again: a scan of files gives them; any other input is first
written to a table (repeatable=False). Blocks are named by a digest of their documents in order, so that blocks which
differ would be missed with an error and not answered wrongly.

Equality is that of 64-bit hashes of whole windows: among n distinct windows some two collide with a probability of
about n * n / 2**65.

Defined results: a null text has no words; a text shorter than a window loses nothing; rows that share a doc_id are
no smaller than one another, so neither makes the other lose words; a null doc_id counts as larger than every other;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, partitions, settle, shared_uri, slices, written

WINDOW = 13
BLOCK_WORDS = 1_500_000
CACHE_WORDS = 500_000
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9
NULL_ID = 2**63 - 1


def _pack(values) -> bytes:
    """Ascending unsigned integers as deltas of one width, which costs least, with the wider ones listed apart."""
    import numpy as np

    if not len(values):
        return b""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    widths = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    need = np.searchsorted(np.array([1 << 8 * int(w) for w in widths[:-1]], dtype="u8"), d, side="right")  # index of the width that holds each
    cost = [(w + 1) * len(d) + int((need > w).sum()) * 12 for w in range(8)]
    base = int(np.argmin(cost))
    over = np.flatnonzero(need > base).astype("<u4")
    body = d.view("u1").reshape(-1, 8)[:, : base + 1].tobytes()
    return bytes([base]) + len(d).to_bytes(4, "little") + len(over).to_bytes(4, "little") + over.tobytes() + d[over].tobytes() + body


def _unpack(data: bytes):
    import numpy as np

    if not data:
        return np.zeros(0, "u8")
    base, n, k = data[0], int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:9], "little")
    over = np.frombuffer(data, "<u4", k, 9)
    wide = np.frombuffer(data, "<u8", k, 9 + 4 * k)
    raw = np.zeros((n, 8), "u1")
    raw[:, : base + 1] = np.frombuffer(data, "u1", n * (base + 1), 9 + 12 * k).reshape(n, base + 1)
    d = raw.reshape(-1).view("<u8").copy()
    d[over] = wide
    return np.cumsum(d, dtype="u8")


def window_hashes(words, length: int):
    """Rabin-Karp hashes of all windows of `length` in a row of 64-bit word hashes."""
    import numpy as np

    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = words[:n].copy()
    for i in range(1, length):
        h *= np.uint64(BASE)
        h += words[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    return h


def _blocks(block_words: int):
    """A function that cuts Arrow batches (doc_id, text, digest of the text) into blocks: (doc_ids, ids, digests, rows of word hashes, texts if asked for)."""

    def cut(batches, keep: bool):
        import re

        import numpy as np
        import xxhash

        split, known, digest = re.compile(WORD).findall, {}, xxhash.xxh64_intdigest

        def word(w):
            if len(known) >= CACHE_WORDS:
                known.clear()
            return known.setdefault(w, digest(w.encode("utf-8", "surrogatepass")))

        get, block, total = known.get, ([], [], [], [], []), 0
        for whole in batches:
            for b in slices(whole, 1):
                for i, text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    row = np.array([get(w) or word(w) for w in split(text or "")], "u8")
                    for part, x in zip(block, (i, NULL_ID if i is None else i, key, row, text)):
                        part.append(x if keep or x is not text else None)
                    total += len(row)
                    if total >= block_words:
                        yield block
                        block, total = ([], [], [], [], []), 0
        if block[0]:
            yield block

    return cut


class _Windows:
    """A block's windows: which repeat one of a smaller document of the block, and the distinct ones by bucket."""

    def __init__(self, ids, digests, rows, length: int, buckets: int):
        import numpy as np
        import xxhash

        self.name = xxhash.xxh3_128_hexdigest(np.array([ids, digests], "i8").tobytes())
        ids = np.array(ids, "i8")
        hashes = [window_hashes(r, length) for r in rows]
        self.count = np.array([len(h) for h in hashes], "i8")
        h = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(ids)), self.count)
        rank = np.argsort(ids, kind="stable")  # documents from the smallest id
        place = np.empty(len(ids), "i8")
        place[rank] = np.arange(len(ids))
        by_doc = np.argsort(place[doc], kind="stable") if (np.diff(ids) < 0).any() else np.arange(len(h))
        order = by_doc[np.argsort(h[by_doc], kind="stable")]  # equal hashes from the smallest document
        hs, ds = h[order], ids[doc[order]]
        new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.settled = np.zeros(len(h), bool)
        self.settled[order[ds[heads][group] < ds]] = True
        self.entry = np.empty(len(h), "i4")  # of each window, its place among the distinct hashes
        self.entry[order] = group
        self.keys, self.owner = hs[heads], ds[heads]
        part = (self.keys % np.uint64(buckets)).astype("i4")
        self.where = np.argsort(part, kind="stable")  # distinct hashes by bucket, ascending within
        self.cuts = np.searchsorted(part[self.where], np.arange(buckets + 1))

    def payload(self, p: int, buckets: int) -> bytes:
        import numpy as np

        x = self.where[self.cuts[p] : self.cuts[p + 1]]
        packed = _pack(self.keys[x] // np.uint64(buckets))
        own, inv = np.unique(self.owner[x], return_inverse=True)
        wide = "<u1" if len(own) <= 256 else "<u2" if len(own) <= 65536 else "<u4"
        return b"".join([len(packed).to_bytes(4, "little"), packed, len(own).to_bytes(4, "little"), own.astype("<i8").tobytes(), inv.astype(wide).tobytes()])

    def flags(self, answer: bytes):
        """Of each window, whether it goes; answer: a bit per distinct hash, in the order sent."""
        import numpy as np

        bits = np.empty(len(self.keys), bool)
        bits[self.where] = np.unpackbits(np.frombuffer(answer, "u1"), count=len(self.keys)).astype(bool)
        return self.settled | bits[self.entry]


def _answer(pdf):
    """Step 2, for one bucket: per block a bit for each hash, whether another block has it in a smaller document."""
    import numpy as np
    import pandas as pd

    keys, owners, sizes = [], [], []
    for payload in pdf["payload"]:
        k = int.from_bytes(payload[:4], "little")
        h = _unpack(payload[4 : 4 + k])
        m = int.from_bytes(payload[4 + k : 8 + k], "little")
        own = np.frombuffer(payload, "<i8", m, 8 + k)
        owners.append(own[np.frombuffer(payload, "<u1" if m <= 256 else "<u2" if m <= 65536 else "<u4", len(h), 8 + k + 8 * m)])
        keys.append(h)
        sizes.append(len(h))
    h, doc = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    least = np.repeat(np.minimum.reduceat(ds, starts), np.diff(np.append(starts, len(hs))))
    flag = np.zeros(len(h), bool)
    flag[order[least < ds]] = True
    ends = np.cumsum(sizes)
    return pd.DataFrame({"part": pdf["part"].to_numpy(), "block": pdf["block"].to_numpy(), "n": sizes, "bits": [np.packbits(flag[e - k : e]).tobytes() for e, k in zip(ends, sizes)]})


def _file(folder: str):
    """Write one block's answers, in the order of buckets, to the shared folder."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        pdf = pdf.sort_values("part")
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, "u1"), count=n) for b, n in zip(pdf["bits"], pdf["n"])])
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        own = f"{base}/{key[0]}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(np.packbits(bits).tobytes())
        settle(system, own, f"{base}/{key[0]}")
        return pd.DataFrame({"n": [len(bits)]})

    return run


def spans(flag, length: int):
    """The maximal removal intervals (begin, end) of a document's windows."""
    import numpy as np

    at = np.flatnonzero(flag)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    begin, end = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist()))


def dedup(docs: DataFrame, length: int = WINDOW, block_words: int = BLOCK_WORDS, repeatable: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (the removal intervals of word positions, flat) and kept, the words
    that stay, joined by one space. repeatable: docs is a scan of files, which gives the same rows in the same order again."""
    spark = docs.sparkSession
    buckets, folder = partitions(spark), f"{shared_uri(spark)}/answers-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"))
    rows = rows if repeatable else written(rows, "texts")
    cut = _blocks(block_words)

    def send(batches):
        for _, ids, digests, words, _ in cut(batches, False):
            w = _Windows(ids, digests, words, length, buckets)
            full = [p for p in range(buckets) if w.cuts[p] < w.cuts[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([w.name] * len(full), pa.string()), pa.array([w.payload(p, buckets) for p in full], pa.binary())], ["part", "block", "payload"])

    def finish(batches):
        import re

        from pyarrow import fs

        split, (system, base) = re.compile(WORD).findall, fs.FileSystem.from_uri(folder)
        for doc_ids, ids, digests, words, texts in cut(batches, True):
            w = _Windows(ids, digests, words, length, buckets)
            answer = b""
            if len(w.keys):
                with system.open_input_file(f"{base}/{w.name}") as f:
                    answer = f.read()
            flag, at, out = w.flags(answer), 0, ([], [], [], [])
            for text, row, n in zip(texts, words, w.count.tolist()):
                gone = spans(flag[at : at + n], length)
                at += n
                kept = split(text or "")
                for begin, end in reversed(gone):
                    del kept[begin:end]
                for part, x in zip(out, (len(row), len(row) - len(kept), [p for s in gone for p in s], " ".join(kept))):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    sent = rows.mapInArrow(send, "part int, block string, payload binary")
    answers = sent.groupBy("part").applyInPandas(_answer, "part int, block string, n long, bits binary")
    answers.groupBy("block").applyInPandas(_file(folder), "n long").agg(F.sum("n")).collect()
    return rows.mapInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<int>, kept string")
