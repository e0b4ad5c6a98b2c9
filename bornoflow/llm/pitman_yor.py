"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants: a word is drawn from the restaurant of its context, the word before (the start of a text has its own);
that one's parent is the restaurant of the class of the word before, its last two characters hashed to 1024; the
parent of that is the one of its last character (64 classes), and theirs the root restaurant over words, whose base is
uniform over the V training words and one unknown. Words, contexts and counts are all unbounded. A word is known by a
64-bit hash, as a context by its class and 37 more bits.

Plan:
1. Blocks of documents, formed once, send per bucket of word hashes their distinct (word, context) pairs with training
   counts, packed into one binary row. Which pair stands at which token stays in one file per block in the shared folder.
2. A bucket's reducer adds the pairs up and keeps them, with each block's pairs as places among them, in one file.
3. Sweeps of Gibbs sampling: each bucket reseats, dish by dish, all customers of a restaurant by the Chinese restaurant
   process given everything else. With weight a for a new table, t tables for n customers have the probability
   a^t S(n, t), S being the generalized Stirling numbers of the restaurant's discount: up to SMALL customers worked out
   customer by customer, up to ROWS from a table of log S, above that from their saddlepoint approximation. Tables of a
   restaurant are customers of its parent. Buckets meet once a sweep through the totals of restaurants; within a sweep
   those stay as they were (as in approximate distributed sampling). Those of classes and the root are arrays of fixed
   size. Word contexts meet in spans of context hashes: each bucket names its contexts once, later it sends only how
   many tables beyond one per pair it has in each, and a span answers every bucket with the totals in the same order.
4. Kept samples' predictive probabilities are averaged, once for every pair of a bucket. Each block gets those of its
   pairs (log10 to 2^-34) and the training counts of its words, and adds them up per document with the help of its file.

Texts are never shuffled and only read once. Blocks are named by partition and number, so a lost task must form the same
ones again: a scan of files does; any other input is written to a table first (repeatable=False). A file that a first
attempt of a task has left is kept. Discounts come from the counts of ones and twos of each level; all random draws have
fixed seeds. A bucket holds all contexts of its words, so the most frequent word's contexts are one task's.

Defined results: a null text is empty; every text ends with one end token; only A-Z are lower-cased; a null doc_id
trains and is not held out; repeated rows train as often as they occur; an empty table gives an empty result, and a
table without training documents uniform probabilities; extra columns are ignored.
"""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_hash
from .common import discard, freed, partitions, settle, shared_uri, slices, written
from .substring_dedup import _pack, _unpack as _unpack_hashes

BLOCK_WORDS = 2_000_000
COARSE, FINE = 64, 1024  #: context classes by the last character, and by the last two; one more for the start of a text
HASH_BITS = 37  #: a context is the class of the word before, over so many bits of its hash
START, END = FINE << HASH_BITS, 0x5851F42D4C957F2D  #: the context at the start of a text; the end token's hash
BURN_IN, SAMPLES, DRAWS, SMALL, ROWS, STRENGTH = 2, 2, 24, 16, 512, 1.0
FOLDS, HELD = 7, 2
POINT = 34  #: bits after the point of the log10 probabilities that buckets send to blocks, in five bytes


def _held(doc_id) -> bool:
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def _narrow(x, width: int) -> bytes:
    """The low bytes of unsigned integers."""
    import numpy as np

    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, n: int, at: int, width: int):
    import numpy as np

    raw = np.zeros((n, 8), "u1")
    raw[:, :width] = np.frombuffer(data, "u1", n * width, at).reshape(n, width)
    return raw.reshape(-1).view("<i8")


def _small(x) -> bytes:
    """Counts that are mostly small: bytes, with those of 255 and more listed apart."""
    import numpy as np

    big = np.flatnonzero(x >= 255)
    return b"".join([len(big).to_bytes(4, "little"), big.astype("<u4").tobytes(), x[big].astype("<u8").tobytes(), np.minimum(x, 255).astype("u1").tobytes()])


def _big(data: bytes, n: int, at: int = 0):
    """(the n counts of _small() at a place, the place after them)"""
    import numpy as np

    k = int.from_bytes(data[at : at + 4], "little")
    x = np.frombuffer(data, "u1", n, at + 4 + 12 * k).astype("i8")
    x[np.frombuffer(data, "<u4", k, at + 4)] = np.frombuffer(data, "<u8", k, at + 4 + 4 * k).astype("i8")
    return x, at + 4 + 12 * k + n


def _runs(sorted_keys):
    """(the distinct keys of an ascending array, for each element the place of its key among them)"""
    import numpy as np

    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, bool)
    return sorted_keys[new], np.cumsum(new) - 1


def _distinct(keys):
    """(distinct keys, ascending; where each occurs; the place of each element's key among them)"""
    import numpy as np

    order = np.argsort(keys)
    found, run = _runs(keys[order])
    place = np.empty(len(keys), "i8")
    place[order] = run
    at = np.empty(len(found), "i8")
    at[place] = np.arange(len(keys))
    return found, at, place


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder, packed, that any attempt of a task would write alike."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True))
    settle(system, own, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        data = f.read()
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _arrays(**named) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    np.savez(out, **named)
    return out.getvalue()


def _named(data: bytes, *names: str) -> list:
    import io

    import numpy as np

    with np.load(io.BytesIO(data), allow_pickle=False) as x:
        return [x[n] for n in names]


class Block:
    """A block of documents: its distinct words and (word, context) pairs, ascending, and which pair stands at each token."""

    def __init__(self, doc_ids: list, texts: list, buckets: int):
        import numpy as np

        data, bounds = word_hash.texts(texts)
        data = np.frombuffer(word_hash.LOWER, "u1")[data]
        starts, lengths, per_text = word_hash.split(data, bounds)
        self.ids, self.size = doc_ids, per_text + 1
        ends = np.cumsum(self.size) - 1
        here = np.ones(ends[-1] + 1, bool)
        here[ends] = False
        token = np.full(len(here), END, "u8")
        token[here] = word_hash.hashes(data, starts, lengths)
        self.hash, first, word = _distinct(token)
        at = np.cumsum(here)[first] - 1  # the word that stands there; at the end token any
        context = np.zeros(len(first), "i8")
        if len(starts):
            one, two = word_hash.endings(data, starts[at], lengths[at])
            context = ((one % np.uint64(COARSE) * np.uint64(FINE // COARSE) + two % np.uint64(FINE // COARSE)) << np.uint64(HASH_BITS) | self.hash >> np.uint64(64 - HASH_BITS)).astype("i8")
        contexts, rank = np.unique(np.append(context, START), return_inverse=True)
        before = np.empty(len(word), "i8")
        before[1:] = rank[word[:-1]]
        before[0] = before[ends[:-1] + 1] = rank[-1]
        key, _, self.pair = _distinct(word * len(contexts) + before)
        train = np.repeat(np.array([not _held(i) for i in doc_ids]), self.size)
        self.count = np.bincount(self.pair[train], minlength=len(key))
        self.word, self.context = key // len(contexts), contexts[key % len(contexts)]
        self.cuts = np.searchsorted(bucket(self.hash, buckets), np.arange(buckets + 1))
        self.pair_cuts = np.searchsorted(self.word, self.cuts)

    def payload(self, p: int) -> bytes:
        import numpy as np

        a, b, c, d = self.cuts[p], self.cuts[p + 1], self.pair_cuts[p], self.pair_cuts[p + 1]
        h = _pack(self.hash[a:b])
        return b"".join([(b - a).astype("<u4").tobytes(), len(h).to_bytes(4, "little"), h, _small(np.bincount(self.word[c:d] - a, minlength=b - a)), _narrow(self.context[c:d], 6), _small(self.count[c:d])])

    def kept(self) -> bytes:
        import numpy as np

        planes = {f"plane{k}": (self.pair >> 8 * k).astype("u1") for k in range(4)}
        return _arrays(
            ids=np.array([0 if i is None else i for i in self.ids], "i8"), none=np.array([i is None for i in self.ids]), size=self.size.astype("u4"),
            per_word=np.frombuffer(_small(np.bincount(self.word, minlength=len(self.hash))), "u1"), words=np.array([len(self.hash)]), **planes,
        )


def bucket(hashes, buckets: int):
    """Of ascending hashes ascending buckets."""
    import numpy as np

    return (hashes >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)


def _unpack(data: bytes):
    """(hashes, word index of each pair, contexts, counts)"""
    import numpy as np

    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    h = _unpack_hashes(data[8 : 8 + size])
    per_word, at = _big(data, n, 8 + size)
    m = int(per_word.sum())
    return h, np.repeat(np.arange(n), per_word), _wide(data, m, at, 6), _big(data, m, at + 6 * m)[0]


def merge(blocks, payloads):
    """All pairs of one bucket, by word and context: the words' hashes; each pair's word, context and training count; each block's pairs as places among them."""
    import numpy as np

    parts = [_unpack(p) for p in payloads]
    words = np.unique(np.concatenate([h for h, _, _, _ in parts]))
    contexts = np.unique(np.concatenate([c for _, _, c, _ in parts]))
    keys = [np.searchsorted(words, h)[w] * len(contexts) + np.searchsorted(contexts, c) for h, w, c, _ in parts]
    key = np.unique(np.concatenate(keys))
    n, asked = np.zeros(len(key), "i8"), []
    for k, (_, _, _, count) in zip(keys, parts):
        place = np.searchsorted(key, k)
        n[place] += count
        asked.append(_pack(place.astype("u8")))
    return words, key // len(contexts), contexts[key % len(contexts)], n, dict(zip(blocks, asked))


def fine(c):
    """The parent of a context: its class; that of the start of a text is a class of its own."""
    return c >> HASH_BITS


def coarse(f):
    """The parent of a class: its coarse class."""
    return f // (FINE // COARSE)


def turned(c):
    """A context with its class below its hash, so that equal ranges hold about equally many contexts."""
    return (c & ((1 << HASH_BITS) - 1)) << 11 | c >> HASH_BITS


def spans(c, buckets: int):
    """The span that each turned() context falls into: a quarter as many as there are buckets."""
    return (c >> (HASH_BITS + 11 - 30)) * max(1, buckets // 4) >> 30


@functools.cache
def stirling(discount: float):
    """log S(n, t) of the generalized Stirling numbers at [n, t], n and t up to ROWS: S(n + 1, t) = S(n, t - 1) + (n - discount t) S(n, t)."""
    import numpy as np

    out = np.full((ROWS + 1, ROWS + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, ROWS):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - discount * t)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n + 1, 1 : n + 2], out[n, : n + 1])
    return out


def log_gamma(x):
    """log Gamma of positive numbers, by Stirling's series from 10 on."""
    import numpy as np

    x = np.asarray(x, "f8")
    y = x + 10
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + k) for k in range(10))


def _few_tables(n, t, discount: float):
    """log S(n, t) for t of up to half of n^discount, or 6: the alternating sum of rising factorials."""
    import math

    import numpy as np

    total, term = np.zeros(np.broadcast(n, t).shape), 1.0
    for j in range(1, 41):
        term = term * (np.maximum(t - j + 1, 0) / j) * (np.exp(log_gamma(n - j * discount) - log_gamma(n - (j - 1) * discount)) if j > 1 else 1.0)
        total += (-1) ** (j + 1) * term * (math.gamma(1 + j * discount) * math.sin(math.pi * j * discount) / math.pi)
    return np.log(np.maximum(total, 1e-300)) + log_gamma(n - discount) - t * math.log(discount) - log_gamma(t + 1.0)


def _saddle(n, t, discount: float):
    """log S(n, t), about: by the saddlepoint of n! / t! [z^n] ((1 - (1 - z)^d) / d)^t."""
    import numpy as np

    d, m = discount, n / t
    lo, hi = np.full(m.shape, -700.0), np.zeros(m.shape)  # 1 - z = e^u
    for _ in range(42):
        u = (lo + hi) / 2
        more = -np.expm1(u) * d * np.exp((d - 1) * u) > -m * np.expm1(d * u)
        lo, hi = np.where(more, u, lo), np.where(more, hi, u)
    u = np.minimum((lo + hi) / 2, -1e-9)
    z, f, g = -np.expm1(u), -np.expm1(d * u), d * np.exp((d - 1) * u)
    spread = z * g / f + z * z * d * (1 - d) * np.exp((d - 2) * u) / f - (z * g / f) ** 2  # the variance of a table's size
    out = t * (np.log(f) - np.log(d)) - n * np.log(z) - 0.5 * np.log(2 * np.pi * t * np.maximum(spread, 1e-300)) + log_gamma(n + 1) - log_gamma(t + 1)
    return np.where(t < n, out, 0.0)


def log_stirling(n, t, discount: float):
    """log S(n, t) + a term of n alone, for n above ROWS: exact for few tables, from there on by the saddlepoint."""
    import numpy as np

    n, t = np.asarray(n, "f8"), np.asarray(t, "f8")
    last = np.maximum(6, np.floor(0.5 * n**discount))
    out, more = _few_tables(n, np.minimum(t, last), discount), t > last
    n, last = np.broadcast_to(n, out.shape), np.broadcast_to(last, out.shape)
    out[more] += _saddle(n[more], t[more], discount) - _saddle(n[more], last[more], discount)
    return out


def _many(n, new, discount: float, rng, points: int):
    """seat() of dishes of more than ROWS customers: the mode by bisection, then a draw from a grid of 2 points + 1 steps around it, evenly within a step."""
    import numpy as np

    la = np.log(new)
    rise = lambda t: log_stirling(n, t + 1, discount) - log_stirling(n, t, discount) + la  # noqa: E731  falls in t
    lo, hi = np.ones(len(n)), n - 1.0
    while (lo < hi).any():
        mid = np.floor((lo + hi) / 2)
        up = rise(mid) > 0
        lo, hi = np.where(up & (lo < hi), mid + 1, lo), np.where(up, hi, np.minimum(mid, hi))
    bend = np.maximum(rise(np.maximum(lo - 1, 1)) - rise(np.maximum(lo - 1, 1) + 1), 1e-12)  # of the logarithm, at the mode
    step = np.maximum(1, np.ceil((5 / np.sqrt(bend) + 8) / points))[:, None]
    grid = lo[:, None] + step * np.arange(-points, points + 1)
    inside = (grid >= 1) & (grid <= n[:, None])
    at = np.clip(grid, 1, n[:, None])
    weight = np.where(inside, log_stirling(n[:, None], at, discount) + la[:, None] * at, -np.inf)
    pick = (weight + rng.gumbel(size=weight.shape)).argmax(1)
    drawn = grid[np.arange(len(n)), pick] + np.floor((rng.random(len(n)) - 0.5) * step[:, 0] + 0.5)
    return np.clip(drawn, 1, n)


def seat(n, new, discount: float, rng, draws: int = DRAWS, small: int = SMALL):
    """Numbers of tables of dishes with n customers each, from their conditional distribution; `new` weighs a new table.

    Dishes of up to `small` customers are worked out customer by customer, of up to ROWS by the table of Stirling
    numbers, both exactly; larger ones by `draws` points of a grid on either side of the mode.
    """
    import numpy as np

    tables = np.minimum(n, 1).astype("f8")
    few = np.flatnonzero((n > 1) & (n <= small))
    if len(few):
        few = few[np.argsort(-n[few], kind="stable")]
        ways = np.zeros((small + 1, len(few)))
        ways[1] = 1
        for s in range(1, small):
            live = int(np.searchsorted(-n[few], -s, side="left"))
            if not live:
                break
            w, a = ways[:, :live], new[few[:live]]
            grown = w * np.maximum(s - discount * np.arange(small + 1), 0)[:, None]
            grown[1:] += w[:-1] * a
            ways[:, :live] = grown / grown.sum(0)
        upto = np.cumsum(ways, 0)
        tables[few] = (upto < rng.random(len(few)) * upto[-1]).sum(0)
    rest = np.flatnonzero((n > max(1, small)) & (n <= ROWS))
    rest = rest[np.argsort(n[rest], kind="stable")]
    for own in np.split(rest, np.flatnonzero(np.diff(n[rest])) + 1) if len(rest) else []:
        size = int(n[own[0]])
        for some in np.array_split(own, -(-len(own) * size // 2_000_000)):
            w = stirling(discount)[size, 1 : size + 1] + np.log(new[some])[:, None] * np.arange(1, size + 1)
            upto = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            tables[some] = 1 + (upto < (rng.random(len(some)) * upto[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(n > max(1, small, ROWS))
    for some in np.array_split(many, -(-len(many) // 5_000)) if len(many) else []:
        tables[some] = _many(n[some], new[some], discount, rng, draws)
    return tables.astype("i8")


class Restaurants:
    """Customers and tables of classes, coarse classes and the root; discounts; V."""

    def __init__(self, totals: dict, vocabulary: int, discounts):
        import numpy as np

        self.vocabulary, self.discounts = vocabulary, discounts
        self.n2, self.t2, self.n1, self.t1, self.n0, self.t0 = (np.asarray(totals[k], "f8") for k in ("n2", "t2", "n1", "t1", "n0", "t0"))

    def root(self, c0, t0):
        d = self.discounts[0]
        return (c0 - d * t0 + (STRENGTH + d * self.t0[0]) / (self.vocabulary + 1)) / (STRENGTH + self.n0[0])

    def coarse(self, k, c1, t1, p0):
        d = self.discounts[1]
        return (c1 - d * t1 + (STRENGTH + d * self.t1[k]) * p0) / (STRENGTH + self.n1[k])

    def fine(self, k, c2, t2, p1):
        d = self.discounts[2]
        return (c2 - d * t2 + (STRENGTH + d * self.t2[k]) * p1) / (STRENGTH + self.n2[k])

    def word(self, n, t, c3, t3, p2):
        """n, t: the context's totals."""
        d = self.discounts[3]
        return (c3 - d * t3 + (STRENGTH + d * t) * p2) / (STRENGTH + n)


class Seating:
    """One bucket's seating: tables t3 of each (word, context), t2 of each (word, class), t1 of each (word, coarse class), t0 of each word."""

    def __init__(self, words: int, word, context, n, tables=None):
        import numpy as np

        self.words, self.word, self.context, self.n = words, word, context, n
        key, self.up3 = _runs(word * (FINE + 1) + fine(context))
        self.word2, self.class2 = key // (FINE + 1), key % (FINE + 1)
        key, self.up2 = _runs(self.word2 * (COARSE + 1) + coarse(self.class2))
        self.word1, self.class1 = key // (COARSE + 1), key % (COARSE + 1)
        if tables is None:
            self.t3 = np.minimum(n, 1)
            self._add()
            self.t2 = np.minimum(self.c2, 1)
            self._add()
            self.t1 = np.minimum(self.c1, 1)
            self._add()
            self.t0 = np.minimum(self.c0, 1)
        else:
            at = 0
            for name, m in (("t3", len(word)), ("t2", len(self.word2)), ("t1", len(self.word1)), ("t0", words)):
                x, at = _big(tables, m, at)
                setattr(self, name, x)
            self._add()

    def _add(self) -> None:
        """Customers of each level: the tables of the one below."""
        import numpy as np

        for c, t, up, at, m in (("c2", "t3", None, self.up3, len(self.word2)), ("c1", "t2", None, self.up2, len(self.word1)), ("c0", "t1", None, self.word1, self.words)):
            if hasattr(self, t):
                setattr(self, c, np.bincount(at, getattr(self, t), m).astype("i8"))

    def chances(self, r: Restaurants):
        """The predictive probabilities of each word at the root, each (word, coarse class) and each (word, class)."""
        p0 = r.root(self.c0, self.t0)
        p1 = r.coarse(self.class1, self.c1, self.t1, p0[self.word1])
        return p0, p1, r.fine(self.class2, self.c2, self.t2, p1[self.up2])

    def sweep(self, r: Restaurants, tables, seed: int) -> None:
        """tables: those of each pair's context, all buckets' together."""
        import numpy as np

        rng, d = np.random.default_rng(seed), r.discounts
        p0, p1, p2 = self.chances(r)
        some = np.flatnonzero(self.n > 1)  # one customer has one table
        self.t3 = np.minimum(self.n, 1)
        self.t3[some] = seat(self.n[some], (STRENGTH + d[3] * tables[some]) * p2[self.up3[some]], d[3], rng)
        self._add()
        self.t2 = seat(self.c2, (STRENGTH + d[2] * r.t2[self.class2]) * p1[self.up2], d[2], rng)
        self._add()
        self.t1 = seat(self.c1, (STRENGTH + d[1] * r.t1[self.class1]) * p0[self.word1], d[1], rng)
        self._add()
        self.t0 = seat(self.c0, np.full(self.words, (STRENGTH + d[0] * r.t0[0]) / (r.vocabulary + 1)), d[0], rng)

    def totals(self) -> dict:
        import numpy as np

        count = lambda at, x, size: np.bincount(at, x, size).tolist()
        ones = [[float((x == 1).sum()), float((x == 2).sum())] for x in (self.c0, self.c1, self.c2, self.n)]
        return {
            "n2": count(self.class2, self.c2, FINE + 1), "t2": count(self.class2, self.t2, FINE + 1), "n1": count(self.class1, self.c1, COARSE + 1), "t1": count(self.class1, self.t1, COARSE + 1),
            "n0": [float(self.c0.sum())], "t0": [float(self.t0.sum())], "ones": sum(ones, []), "words": [float((self.c0 > 0).sum())], "tokens": [float(self.n.sum())],
        }

    def pack(self) -> bytes:
        return b"".join(map(_small, (self.t3, self.t2, self.t1, self.t0)))


class Bucket:
    """What one bucket's file holds: its words, pairs, contexts by span, each block's pairs."""

    def __init__(self, data: bytes):
        import numpy as np

        words, per_word, self.contexts, at, n, self.cuts, self.blocks, self.asked, self.ends = _named(data, "words", "per_word", "contexts", "at", "n", "cuts", "blocks", "asked", "ends")
        self.words, self.at = len(words), at.astype("i8")
        self.word = np.repeat(np.arange(self.words), _big(per_word.tobytes(), self.words)[0])
        self.n = _big(n.tobytes(), len(self.at))[0]
        back = (self.contexts & 0x7FF) << HASH_BITS | self.contexts >> 11
        self.pair = back[self.at]

    @staticmethod
    def file(words, word, context, n, asked: dict, buckets: int) -> bytes:
        import numpy as np

        contexts, place = np.unique(turned(context), return_inverse=True)
        cuts = np.searchsorted(spans(contexts, buckets), np.arange(max(1, buckets // 4) + 1))
        u1 = lambda b: np.frombuffer(b, "u1")
        return _arrays(
            words=words, per_word=u1(_small(np.bincount(word, minlength=len(words)))), contexts=contexts, at=place.astype("u4"), n=u1(_small(n)), cuts=cuts,
            blocks=np.array(list(asked)), asked=u1(b"".join(asked.values())), ends=np.cumsum([0, *map(len, asked.values())]),
        )

    def seating(self, tables=None) -> Seating:
        return Seating(self.words, self.word, self.pair, self.n, tables)

    def named(self) -> list:
        """To each span the bucket's contexts in it, with the customers and the pairs of each."""
        import numpy as np

        n, pairs = (np.bincount(self.at, x, len(self.contexts)).astype("i8") for x in (self.n, self.n > 0))
        return [_narrow(self.contexts[a:b], 6) + _small(n[a:b]) + _small(pairs[a:b]) + (b - a).astype("<u4").tobytes() if a < b else b"" for a, b in zip(self.cuts, self.cuts[1:])]

    def more(self, s: Seating) -> list:
        """To each span the tables beyond one per pair that each of the bucket's contexts in it has here."""
        import numpy as np

        x = np.bincount(self.at, s.t3 - np.minimum(self.n, 1), len(self.contexts)).astype("i8")
        return [_small(x[a:b]) + (b - a).astype("<u4").tobytes() if a < b else b"" for a, b in zip(self.cuts, self.cuts[1:])]


STEP = "part int, totals map<string, array<double>>, sent array<binary>"
ANSWER = "part int, block string, n long, logs binary, counts binary"


def _rows(docs: DataFrame, repeatable: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows if repeatable else written(rows, "texts")


def _cut(batches, block_words: int, buckets: int):
    """(name, Block) of batches (doc_id, text): about block_words words each, judged by bytes."""
    from pyspark import TaskContext

    part, limit, number = TaskContext.get().partitionId(), 6 * block_words, 0
    ids, texts, total = [], [], 0
    for whole in batches:
        for b in slices(whole, 1, limit):
            ids += b.column(0).to_pylist()
            texts.append(b.column(1))
            total += b.column(1).nbytes + 6 * len(b)
            if total >= limit:
                yield f"{part}-{number}", Block(ids, texts, buckets)
                ids, texts, total, number = [], [], 0, number + 1
    if ids:
        yield f"{part}-{number}", Block(ids, texts, buckets)


def _sum_totals(steps: DataFrame) -> dict:
    """The totals of all buckets, added up place by place: arrays of a fixed size."""
    flat = steps.select(F.explode("totals").alias("k", "v")).select("k", F.posexplode("v").alias("i", "x"))
    out: dict = {}
    for k, i, x in flat.groupBy("k", "i").agg(F.sum("x").alias("x")).orderBy("k", "i").collect():
        out.setdefault(k, []).append(x)
    return out


def _meet(steps: DataFrame, folder: str, first: bool) -> DataFrame:
    """(part, span, payload): to each bucket the tables of its contexts in each span, the first time with their customers."""

    def add(key, pdf):
        import numpy as np
        import pandas as pd

        size = [int.from_bytes(x[-4:], "little") for x in pdf["payload"]]
        if first:
            named = [_wide(x, m, 0, 6) for x, m in zip(pdf["payload"], size)]
            contexts = np.unique(np.concatenate(named))
            place = {int(p): np.searchsorted(contexts, c) for p, c in zip(pdf["part"], named)}
            n, t = np.zeros(len(contexts), "i8"), np.zeros(len(contexts), "i8")
            for p, x, m in zip(pdf["part"], pdf["payload"], size):
                own, at = _big(x, m, 6 * m)
                n[place[p]] += own
                t[place[p]] += _big(x, m, at)[0]
            _put(folder, f"span-{key[0]}", _arrays(t=t, parts=np.array([*place]), ends=np.cumsum([0, *map(len, place.values())]), place=np.concatenate([*place.values()]).astype("u4")))
            out = [_small(t[c]) + _small(n[c]) for c in place.values()]
        else:
            t, parts, ends, flat = _named(_get(folder, f"span-{key[0]}"), "t", "parts", "ends", "place")
            place = {int(p): flat[a:b] for p, a, b in zip(parts, ends, ends[1:])}
            for p, x, m in zip(pdf["part"], pdf["payload"], size):
                t[place[p]] += _big(x, m)[0]
            out = [_small(t[c]) for c in place.values()]
        return pd.DataFrame({"part": np.array([*place], "i4"), "span": np.int32(key[0]), "payload": out})

    rows = steps.select("part", F.posexplode("sent").alias("span", "payload")).where(F.length("payload") > 0)
    return rows.groupBy("span").applyInPandas(add, "part int, span int, payload binary")


def _met(b: Bucket, pdf, first: bool):
    """(tables, customers or None) of the bucket's contexts, from all spans' answers."""
    import numpy as np

    t, n = np.zeros(len(b.contexts)), np.zeros(len(b.contexts)) if first else None
    for span, x in zip(pdf["span"], pdf["payload"]):
        c, d = b.cuts[span], b.cuts[span + 1]
        t[c:d], at = _big(x, d - c)
        if first:
            n[c:d] = _big(x, d - c, at)[0]
    return t, n


class Trained:
    """The folder of the buckets' files and kept seatings; the restaurants' totals of each kept sample; what the spans answer after the last sweep."""

    def __init__(self, folder: str, restaurants: list, tokens: int, vocabulary: int, met: DataFrame, steps: DataFrame):
        self.folder, self.restaurants, self.tokens, self.vocabulary, self.met, self.steps = folder, restaurants, tokens, vocabulary, met, steps


def train(rows: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1) -> Trained:
    """rows: as _rows gives them."""
    spark = rows.sparkSession
    buckets, folder = partitions(spark), f"{shared_uri(spark)}/lm-{uuid.uuid4().hex}"

    def send(batches):
        for name, b in _cut(batches, block_words, buckets):
            _put(folder, f"block-{name}", b.kept())
            full = [p for p in range(buckets) if b.cuts[p] < b.cuts[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([name] * len(full), pa.string()), pa.array([b.payload(p) for p in full], pa.binary())], ["part", "block", "payload"])

    def gather(key, pdf):
        import pandas as pd

        data = Bucket.file(*merge(pdf["block"], pdf["payload"]), buckets)
        _put(folder, f"bucket-{key[0]}", data)
        b = Bucket(data)
        s = b.seating()
        _put(folder, f"seats-0-{key[0]}", s.pack())
        return pd.DataFrame({"part": [key[0]], "totals": [s.totals()], "sent": [b.named()]})

    def sweeper(sent, step: int):
        def sweep(key, pdf):
            import pandas as pd

            b, part = Bucket(_get(folder, f"bucket-{key[0]}")), key[0]
            tables, customers = _met(b, pdf, step == 1)
            if step == 1:
                _put(folder, f"customers-{part}", _small(customers.astype("i8")))
            if step - 1 > BURN_IN:
                _put(folder, f"tables-{step - 1}-{part}", _small(tables.astype("i8")))
            s = b.seating(_get(folder, f"seats-{step - 1}-{part}"))
            s.sweep(sent.value, tables[b.at], seed * 1_000_003 + step * 65_537 + part)
            _put(folder, f"seats-{step}-{part}", s.pack())
            return pd.DataFrame({"part": [part], "totals": [s.totals()], "sent": [b.more(s)]})

        return sweep

    steps = written(rows.mapInArrow(send, "part int, block string, payload binary").groupBy("part").applyInPandas(gather, STEP), "step")
    freed(spark)
    totals = _sum_totals(steps)
    if not totals or not totals["tokens"][0]:
        return Trained(folder, [], 0, 0, _meet(steps, folder, True), steps)
    tokens, vocabulary = int(totals["tokens"][0]), int(totals["words"][0])
    ones = totals["ones"]
    discounts = [min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5 for a, b in zip(ones[::2], ones[1::2])]
    kept = []
    for step in range(1, BURN_IN + SAMPLES + 1):
        sent = spark.sparkContext.broadcast(Restaurants(totals, vocabulary, discounts))

        before, steps = steps, written(_meet(steps, folder, step == 1).groupBy("part").applyInPandas(sweeper(sent, step), STEP), "step")
        discard(before)
        freed(spark)
        totals = _sum_totals(steps)
        if step > BURN_IN:
            kept.append(Restaurants(totals, vocabulary, discounts))
    return Trained(folder, kept, tokens, vocabulary, _meet(steps, folder, False), steps)


def predicted(b: Bucket, part: int, folder: str, restaurants: list, vocabulary: int, tables):
    """The probability of each pair of a bucket, the mean of the kept samples'; tables: of its contexts, after the last sweep."""
    import numpy as np

    p = np.zeros(len(b.n))
    if not restaurants:
        return p + 1.0 / (vocabulary + 1)
    customers = _big(_get(folder, f"customers-{part}"), len(b.contexts))[0]
    for step, r in enumerate(restaurants, BURN_IN + 1):
        t = tables if step == BURN_IN + SAMPLES else _big(_get(folder, f"tables-{step}-{part}"), len(b.contexts))[0]
        s = b.seating(_get(folder, f"seats-{step}-{part}"))
        p += r.word(customers[b.at], t[b.at], s.n, s.t3, s.chances(r)[2][s.up3])
    return p / len(restaurants)


def score(docs: DataFrame, block_words: int = BLOCK_WORDS, repeatable: bool = False, seed: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    spark = docs.sparkSession
    model = train(_rows(docs, repeatable), block_words, seed)
    folder, tokens, vocabulary = model.folder, model.tokens, model.vocabulary
    sent = spark.sparkContext.broadcast(model.restaurants)

    def answer(key, pdf):
        import numpy as np
        import pandas as pd

        part, b = key[0], Bucket(_get(folder, f"bucket-{key[0]}"))
        p = predicted(b, part, folder, sent.value, vocabulary, _met(b, pdf, not sent.value)[0])
        logs = np.maximum(0, np.rint(-np.log10(p) * 2**POINT)).astype("u8")
        total = np.bincount(b.word, b.n, b.words).astype("i8")
        out = []
        for name, a, e in zip(b.blocks, b.ends, b.ends[1:]):
            at = _unpack_hashes(b.asked[a:e].tobytes()).astype("i8")
            words = _runs(b.word[at])[0]
            out.append((part, str(name), len(words), _narrow(logs[at], 5), _small(total[words])))
        return pd.DataFrame(out, columns=["part", "block", "n", "logs", "counts"]).astype({"part": np.int32})

    def finish(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("part")
        ids, none, size, per_word, words, *planes = _named(_get(folder, f"block-{key[0]}"), "ids", "none", "size", "per_word", "words", *(f"plane{k}" for k in range(4)))
        first = np.cumsum(size, dtype="i8") - size
        pair = sum(x.astype("i8") << 8 * k for k, x in enumerate(planes))
        counts = np.concatenate([_big(c, n)[0] for c, n in zip(pdf["counts"], pdf["n"])])
        logs = np.concatenate([_wide(x, len(x) // 5, 0, 5) for x in pdf["logs"]]) / -(2.0**POINT)
        word = np.repeat(np.arange(words[0]), _big(per_word.tobytes(), words[0])[0])[pair]
        plain = np.log10((counts + 1) / (tokens + 1.0 * (vocabulary + 1)))
        held = [not gone and _held(i) for i, gone in zip(ids.tolist(), none)]
        found = {"held_out": held, "n_tokens": size.astype("i8"), "n_known": np.add.reduceat((counts > 0).astype("i8")[word], first), "train_tokens": tokens, "base_score": np.add.reduceat(plain[word], first), "score": np.add.reduceat(logs[pair], first)}
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **found}).assign(doc_id=lambda x: x["doc_id"].mask(none))

    answers = model.met.groupBy("part").applyInPandas(answer, ANSWER)
    return answers.groupBy("block").applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
