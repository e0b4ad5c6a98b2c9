"""N-grams of small ids as longs: counts, Kneser-Ney scores, next-word lists and their evaluation in sorted streams.

Ids of 15 bits, as of a vocabulary of at most 32,768, make four words one long: the word before the target, the one before that, the
third, the target; 0 where a word is absent. In this order all of a context and of its shorter forms lie together, and what is known of
the last word alone comes first. So grams are shuffled once, by the word before the target, sorted, and read in pieces of bounded size
that end where the last two words change. Names: a3, a2, a1 are the words from the nearest to the farthest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import log_probability
from .ngrams import context_columns
from .nextword import reserved_caps

BITS, MASK = 15, (1 << 15) - 1
#: Keys that a task gathers before it counts and hands them on; rows of a piece; words of text to a partition.
GATHER, PIECE, PART_WORDS = 1 << 20, 1 << 18, 1 << 21


def _words(batch):
    """Ids of a batch's sentences in one array, and each one's place in its sentence."""
    import numpy as np

    lists = batch.column(batch.schema.get_field_index("ids"))
    v = np.asarray(lists.flatten(), "i8")
    if len(v) and (v.max() > MASK or v.min() < 0):
        raise ValueError(f"ids beyond {BITS} bits")
    sizes = np.diff(np.asarray(lists.offsets, "i8"))
    return v, np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _before(v, at, k: int, first: int):
    """The id k places before, 0 where that lies before place `first`."""
    import numpy as np

    out = np.zeros_like(v)
    out[k:] = v[: max(0, len(v) - k)]
    out[at < k + first] = 0
    return out


def _key(a3, a2, a1, t):
    return a3 << 3 * BITS | a2 << 2 * BITS | a1 << BITS | t


def _gram_keys(v, at, highest: int):
    """Keys of ngrams.counts()' occurrences: each one's pair, and its longest gram of up to `highest` words beyond that."""
    import numpy as np

    word = lambda k: (lambda x: np.where(x == 2, 0, x))(_before(v, at, k, 0))  # noqa: E731  (BOS is a context, unknown is none)
    a3 = word(1)
    a2 = word(2) * (a3 > 0) if highest > 2 else np.zeros_like(v)
    a1 = word(3) * (a2 > 0) if highest > 3 else np.zeros_like(v)
    ok = (at >= 1) & (v > 2) & (a3 > 0)
    long = ok & (a2 > 0)
    return np.concatenate([(a3 << 3 * BITS | v)[ok], _key(a3, a2, a1, v)[long]])


def _context_keys(v, at, highest: int = 4):
    """Keys, without a target, of nextword.positions()' contexts: BOS stands for a start alone."""
    import numpy as np

    word = lambda k: (lambda x: np.where(x > 2, x, 0))(_before(v, at, k, 1))
    a3 = np.where(at == 1, 1, word(1))
    a2 = word(2) * (a3 > 0)
    a1 = word(3) * (a2 > 0)
    return _key(a3, a2, a1, 0)[at >= 1]


def _counted(encoded: DataFrame, *makers) -> DataFrame:
    """(key, n): keys that makers give for a batch's words, counted as far as a task gathers them."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(held):
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)].astype("i8"))], ["key", "n"])

        held, size = [], 0
        for b in batches:
            v, at, _ = _words(b)
            for m in makers:
                held.append(m(v, at))
                size += len(held[-1])
            if size >= GATHER:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return encoded.select("ids").mapInArrow(run, "key long, n long")


def unigrams(encoded: DataFrame) -> tuple[list[int], list[int]]:
    """Ids and counts, most frequent first, ties by id: at most a vocabulary of 15 bits."""
    rows = _counted(encoded, lambda v, at: v[(at >= 1) & (v > 2)]).groupBy("key").agg(F.sum("n").alias("n")).collect()
    rows = sorted((-r.n, r.key) for r in rows)
    return [k for _, k in rows], [-n for n, _ in rows]


def _streams(rows: DataFrame, words: int) -> DataFrame:
    """rows by the word before the target, sorted by key; partitions follow the number of words."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, ceil(words / PART_WORDS))
    return rows.repartition(parts, F.shiftright("key", 3 * BITS)).sortWithinPartitions("key")


def _pieces(batches, rows: int) -> Iterator:
    """Sorted batches in pieces of about `rows` rows that end where the last two words change."""
    import numpy as np
    import pyarrow as pa

    held, size, enough = [], 0, rows
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held)
        top = np.asarray(table.column("key").combine_chunks()) >> 2 * BITS
        cut = int(np.searchsorted(top, top[-1]))
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), size - cut
        enough = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def _column(table, name: str):
    import numpy as np

    return np.asarray(table.column(name).combine_chunks(), "i8")


def _starts(x):
    """Where runs of a sorted array start."""
    import numpy as np

    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, "i8")


def _summed(keys, n):
    """Sorted keys once each, with their sums."""
    import numpy as np

    at = _starts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _by_order(keys, n):
    """Of a piece's keys, sorted and distinct: (pairs as a3 t, n), (triples as a3 a2 t, n), longer grams' (keys, n, place of each one's triple)."""
    import numpy as np

    pair = keys >> 2 * BITS & MASK == 0
    p2 = (keys[pair] >> 3 * BITS << BITS | keys[pair] & MASK, n[pair])
    k, m = keys[~pair], n[~pair]
    u, place = np.unique(k >> 2 * BITS << BITS | k & MASK, return_inverse=True)
    n3 = np.zeros(len(u), "i8")
    np.add.at(n3, place, m)
    four = k >> BITS & MASK > 0
    return p2, (u, n3), (k[four], m[four], place[four])


def kneser_ney(encoded: DataFrame, order: int, modified: bool = True, discount: float = 0.75, *, write, piece_rows: int = PIECE) -> DataFrame:
    """What ngrams.scored() gives for (modified) Kneser-Ney and an order of 2 to 4, from sentences in ids of at most 15 bits.

    Grams are counted in sorted streams and written by `write`; discounts and continuations come from the same pass. A second one,
    over distinct grams, works out all orders' probabilities together.
    """
    ids, uni = unigrams(encoded)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen, buckets = np.zeros(MASK + 1, "i8"), np.zeros((5, 5), "i8")
        rows = lambda kind, keys, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, "i4")), pa.array(keys), pa.array(n)], ["kind", "key", "n"])
        for piece in _pieces(batches, piece_rows):
            keys, n = _summed(_column(piece, "key"), _column(piece, "n"))
            (p, n2), (_, n3), (_, n4, _) = _by_order(keys, n)
            seen += np.bincount(p & MASK, minlength=MASK + 1)
            for o, x in ((2, n2), (3, n3), (4, n4)):
                buckets[o] += np.bincount(np.minimum(x, 4), minlength=5)
            for i in range(0, len(keys), 1 << 16):
                yield rows(0, keys[i : i + (1 << 16)], n[i : i + (1 << 16)])
        t = np.flatnonzero(seen)
        yield rows(1, t, seen[t])
        yield rows(2, np.arange(25), buckets.ravel())

    streams = _streams(_counted(encoded, lambda v, at: _gram_keys(v, at, order)), sum(uni))
    table = write(streams.mapInArrow(count, "kind int, key long, n long"), "grams")
    known = table.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()  # at most a vocabulary
    follows = {r.key: r.n for r in known if r.kind == 1}
    buckets = {divmod(r.key, 5): float(r.n) for r in known if r.kind == 2}
    pairs, total = sum(follows.values()), sum(uni)
    first = {t: follows[t] / pairs if t in follows else c / total for t, c in zip(ids, uni)}
    fixed = max(0.0, min(1.0, discount))

    def discounts(o):
        if not modified:
            return [discount] * 3
        n1, n2, n3, n4 = (buckets.get((o, k), 0.0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 > 0 and n2 > 0 else None
        raw = (None if y is None else 1 - 2 * y * n2 / n1, None if y is None or not n3 else 2 - 3 * y * n3 / n2, None if y is None or not n3 or not n4 else 3 - 4 * y * n4 / n3)
        return [d if d is not None and 0 < d < k else fixed for k, d in enumerate(raw, 1)]

    sent = encoded.sparkSession.sparkContext.broadcast((first, {o: discounts(o) for o in (2, 3, 4)}))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        low, off = sent.value
        p1 = np.zeros(MASK + 1)
        p1[list(low)] = list(low.values())

        def probability(o, context, n, lower):
            at = _starts(context)
            if not len(at):
                return np.zeros(0)
            size = np.diff(np.append(at, len(n)))
            per = lambda x: np.repeat(np.add.reduceat(x, at), size)
            d1, d2, d3 = off[o]
            mass = d1 * per((n == 1).astype("i8")) + d2 * per((n == 2).astype("i8")) + d3 * per((n >= 3).astype("i8")) if modified else discount * np.repeat(size, size)
            cut = np.where(n == 1, d1, np.where(n == 2, d2, d3)) if modified else discount
            sums = per(n)
            return np.maximum(n - cut, 0.0) / sums + mass / sums * lower

        open_ = (np.zeros(0, "i8"), np.zeros(0))  # pairs of the last piece's last word: that word may go on
        for piece in _pieces(batches, piece_rows):
            keys, n = _column(piece, "key"), _column(piece, "n")
            (k2, n2), (k3, n3), (k4, n4, place) = _by_order(keys, n)
            p2 = probability(2, k2 >> BITS, n2, p1[k2 & MASK])
            known, p = (np.concatenate(x) for x in zip(open_, (k2, p2)))
            last = int(np.searchsorted(known, keys[-1] >> 3 * BITS << BITS))
            open_ = known[last:], p[last:]
            own, words = (k2, n2, p2), [k2 >> BITS]
            if order > 2:
                p3 = probability(3, k3 >> BITS, n3, p[np.searchsorted(known, k3 >> 2 * BITS << BITS | k3 & MASK)] if len(k3) else np.zeros(0))
                own, words = (k3, n3, p3), [k3 >> BITS & MASK, k3 >> 2 * BITS]
            if order > 3:
                own, words = (k4, n4, probability(4, k4 >> BITS, n4, p3[place])), [k4 >> BITS & MASK, k4 >> 2 * BITS & MASK, k4 >> 3 * BITS]
            k, m, p = own
            columns = [*[w.astype("i4") for w in words], (k & MASK).astype("i4"), m, p]
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], [*context_columns(order), "token_id", "count", "p"])

    schema = "".join(f"{c} int, " for c in context_columns(order)) + "token_id int, count long, p double"
    return _streams(table.where("kind = 0").select("key", "n"), sum(uni)).mapInArrow(score, schema).withColumn("score", log_probability(F.col("p"))).drop("p")


class Lists:
    """The k best targets of sorted contexts: by count, ties by smaller id."""

    def __init__(self, keys, n, k: int):
        import numpy as np

        context = keys >> BITS
        order = np.lexsort((-n, context))  # stable: ids stay in order
        at = _starts(context)
        size = np.diff(np.append(at, len(keys)))
        kept = np.arange(len(keys)) - np.repeat(at, size) < k
        self.k, self.contexts, self.sizes = k, context[at], np.minimum(size, k)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.t, self.n = (keys[order] & MASK)[kept], n[order][kept]

    def of(self, context, absent):
        """Matrices (t, n) of k columns, t -1 where a list ends."""
        import numpy as np

        t, n = np.full((len(context), self.k), -1, "i4"), np.zeros((len(context), self.k), "i8")
        if len(self.contexts):
            i = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            size = np.where((self.contexts[i] == context) & ~absent, self.sizes[i], 0)
            row = np.repeat(np.arange(len(context)), size)
            col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            src = np.repeat(self.starts[i], size) + col
            t[row, col], n[row, col] = self.t[src], self.n[src]
        return t, n


def _filled(lists: list, limit: int, caps: list):
    """Lists one after the other, each without what is there already, up to its cap: ids, -1 where they end."""
    import numpy as np

    rows = len(lists[0][0])
    out, size = np.full((rows, limit), -1, "i4"), np.zeros(rows, "i8")
    for (t, _), cap in zip(lists, caps):
        new = t >= 0
        for j in range(limit):
            new &= t != out[:, j : j + 1]
        place = np.cumsum(new, axis=1)
        r, c = np.nonzero(new & (place <= np.maximum(0, cap - size)[:, None]))
        out[r, size[r] + place[r, c] - 1] = t[r, c]
        size = size + np.bincount(r, minlength=rows)
    return out


def _merged(lists: list, limit: int):
    """All lists by count, longer contexts first, smaller id; a token's first place is its best."""
    import numpy as np

    both = np.concatenate([np.where(t >= 0, n << 18 | (len(lists) - o) << BITS | MASK - t, -1) for o, (t, n) in enumerate(lists)], axis=1)
    both = -np.sort(-both, axis=1)
    rows = len(both)
    out, size = np.full((rows, limit), -1, "i4"), np.zeros(rows, "i8")
    for j in range(both.shape[1]):
        t = (MASK - (both[:, j] & MASK)).astype("i4")
        r = np.flatnonzero((both[:, j] >= 0) & (size < limit) & ~(out == t[:, None]).any(1))
        if not len(r) and (size >= limit).all():
            break
        out[r, size[r]] = t[r]
        size[r] += 1
    return out


def _answers(batches, best, highest: int, k: int, limit: int, policy: str, piece_rows: int) -> Iterator:
    """Of each piece: its rows that ask, their distinct contexts' keys, the place of each row's context among them, and the contexts' ids."""
    import numpy as np

    top = np.array(best[0][:k], "i4"), np.array(best[1][:k], "i8")
    open_ = np.zeros(0, "i8"), np.zeros(0, "i8")
    for piece in _pieces(batches, piece_rows):
        keys, n = _column(piece, "key"), _column(piece, "n")
        asks = keys & MASK == 0
        (k2, n2), (k3, n3), (k4, n4, _) = _by_order(*_summed(keys[~asks], n[~asks]))
        k2, n2 = (np.concatenate(x) for x in zip(open_, (k2, n2)))
        last = int(np.searchsorted(k2, keys[-1] >> 3 * BITS << BITS))
        open_ = k2[last:], n2[last:]
        if not asks.any():
            continue
        lists = {4: Lists(k4, n4, k), 3: Lists(k3, n3, k), 2: Lists(k2, n2, k)}
        contexts, place = np.unique(keys[asks], return_inverse=True)
        found = np.empty((len(contexts), limit), "i4")
        for i in range(0, len(contexts), 1 << 15):
            c = contexts[i : i + (1 << 15)]
            a2, a1 = c >> 2 * BITS & MASK, c >> BITS & MASK
            own = [lists[o].of(c >> (5 - o) * BITS if o < 4 else c >> BITS, none) for o, none in ((4, a1 == 0), (3, a2 == 0), (2, c == 0)) if o <= highest]
            own.append(tuple(np.broadcast_to(x, (len(c), len(x))) for x in top))
            if policy == "merge":
                found[i : i + len(c)] = _merged(own, limit)
            else:
                length = np.where(a1 > 0, 3, np.where(a2 > 0, 2, np.where(c > 0, 1, 0)))
                caps = {o: np.full(len(c), limit) for o in (4, 3, 2, 1)} if policy != "reserved" else {o: np.array(x)[length] for o, x in reserved_caps(limit).items()}
                found[i : i + len(c)] = _filled(own, limit, [caps[o] for o in (*range(highest, 1, -1), 1)])
        yield piece, asks, contexts, place, found


def _context(keys):
    """Columns c1, c2, c3 of contexts, null where absent."""
    import pyarrow as pa

    return [pa.array((w := (keys >> s * BITS & MASK).astype("i4")), mask=w == 0) for s in (1, 2, 3)]


def suggestions(encoded: DataFrame, policy: str = "backoff", limit: int = 10, k: int = 16, piece_rows: int = PIECE) -> DataFrame:
    """(c1, c2, c3, ids): what nextword.suggest() gives for each distinct context of the sentences, from their own grams; ids are joined by spaces."""
    best = unigrams(encoded)
    words, best = sum(best[1]), [x[:k] for x in best]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for _, _, contexts, _, found in _answers(batches, best, 4, k, limit, policy, piece_rows):
            for i in range(0, len(contexts), 1 << 15):
                f = found[i : i + (1 << 15)]
                ends = np.append(0, np.cumsum((f >= 0).sum(1)))
                ids = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f[f >= 0]).cast(pa.string())), " ")
                yield pa.RecordBatch.from_arrays([*_context(contexts[i : i + (1 << 15)]), ids], ["c1", "c2", "c3", "ids"])

    rows = _counted(encoded, lambda v, at: _gram_keys(v, at, 4), _context_keys)
    return _streams(rows, words).mapInArrow(run, "c1 int, c2 int, c3 int, ids string")


def evaluated(train: DataFrame, held: DataFrame, highest: int = 4, k: int = 16, limit: int = 10, piece_rows: int = PIECE) -> DataFrame:
    """(source, c1, c2, c3, target, rank, weight): nextword.ranks() of the held-out sentences' positions by the grams of those to train
    on, equal ones of a batch together; weight counts them."""
    best = unigrams(train)
    words, best = sum(best[1]), [x[:k] for x in best]

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            v, at, sizes = _words(b)
            if not (at >= 1).any():
                continue
            source = b.column(b.schema.get_field_index("source")).dictionary_encode()
            code = np.repeat(np.asarray(source.indices.fill_null(len(source.dictionary)), "i8"), sizes)[at >= 1]
            key = _context_keys(v, at) | v[at >= 1]
            order = np.lexsort((key, code))
            key, code = key[order], code[order]
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (code[1:] != code[:-1])))
            n = np.diff(np.append(at, len(key)))
            key, code = key[at], code[at]
            named = source.dictionary.take(pa.array(code, mask=code == len(source.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array(key >> BITS << BITS), pa.array(n.astype("i8")), pa.array((key & MASK).astype("i4")), named.cast(pa.string())], ["key", "n", "target", "source"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for piece, asks, contexts, place, found in _answers(batches, best, highest, k, limit, "backoff", piece_rows):
            rows = piece.filter(pa.array(asks))
            target, n, source = _column(rows, "target"), _column(rows, "n"), rows.column("source").combine_chunks()
            for i in range(0, len(target), 1 << 15):
                t, c = target[i : i + (1 << 15)], place[i : i + (1 << 15)]
                same = (found[c] == t[:, None]) & (t > 2)[:, None]
                rank = pa.array(same.argmax(1).astype("i8") + 1, mask=~same.any(1))
                yield pa.RecordBatch.from_arrays([source.slice(i, len(t)), *_context(contexts[c]), pa.array(t.astype("i4")), rank, pa.array(n[i : i + (1 << 15)])], ["source", "c1", "c2", "c3", "target", "rank", "weight"])

    grams = _counted(train, lambda v, at: _gram_keys(v, at, highest)).select("key", "n", F.lit(0).alias("target"), F.lit(None).cast("string").alias("source"))
    rows = grams.unionByName(held.select("source", "ids").mapInArrow(ask, "key long, n long, target int, source string"))
    return _streams(rows, words).mapInArrow(run, "source string, c1 int, c2 int, c3 int, target int, rank long, weight long")
