"""Simple-8b word-aligned coding of unsigned 64-bit integers, vectorised, with escapes and per-block offsets.

A 64-bit word holds a selector in its top 4 bits and as many values as fit in the other 60, all of one width. Selector
0 is an escape: the next word is one raw value of over 60 bits. Values are coded in blocks of BLOCK, each starting on
a word of its own, so that blocks decode independently; the last word of a block is padded with zeros.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: (values per word, bits per value) by selector, from 1; the narrowest first.
PACKS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
LIMITS = np.array([1 << b for _, b in PACKS], "u8")
COUNTS = np.array([1, *(n for n, _ in PACKS)], "i8")


def encode(values, block: int = BLOCK):
    """(words, offsets): the coded words, and the index of each block's first word."""
    v = np.ascontiguousarray(values, "u8")
    n = len(v)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, "u8"), np.zeros(0, "u8")
    stride = block + PACKS[0][0]  # each block is followed by zeros, so that its last words can run over
    rows = np.zeros((blocks, stride), "u8")
    rows[: n // block, :block] = v[: n // block * block].reshape(-1, block)
    rows[-1, : n - (blocks - 1) * block] = v[(blocks - 1) * block :]
    flat = rows.reshape(-1)
    kind = np.searchsorted(LIMITS, flat, side="right").astype("u1")  # the narrowest pack that holds the value; len(PACKS): an escape
    selector = np.zeros(len(flat), "u1")
    widest, length = kind, 1  # the largest kind among the next `length` values
    for k in range(len(PACKS) - 1, -1, -1):
        while length < PACKS[k][0]:
            more = min(length, PACKS[k][0] - length)
            grown = np.zeros_like(widest)
            np.maximum(widest[: len(flat) - more], widest[more:], out=grown[: len(flat) - more])
            grown[len(flat) - more :] = widest[len(flat) - more :]
            widest, length = grown, length + more
        np.copyto(selector, k + 1, where=widest <= k)
    step = COUNTS[selector]
    here, begin = np.zeros(len(flat), bool), np.arange(blocks) * stride
    stop = begin + block
    stop[-1] = begin[-1] + n - (blocks - 1) * block
    while len(begin):
        here[begin] = True
        begin = begin + step[begin]
        inside = begin < stop
        begin, stop = begin[inside], stop[inside]
    starts = np.flatnonzero(here)
    chosen = selector[starts]
    width = 1 + (chosen == 0)
    place = np.concatenate([[0], np.cumsum(width)])
    words = np.zeros(place[-1], "u8")
    for s in np.unique(chosen).tolist():
        m = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[m] + 1] = flat[starts[m]]
            continue
        count, bits = PACKS[s - 1]
        word = np.full(len(m), np.uint64(s) << np.uint64(60))
        if bits:
            for j in range(count):
                word |= flat[starts[m] + j] << np.uint64(bits * j)
        words[place[m]] = word
    return words, place[np.searchsorted(starts, np.arange(blocks) * stride)].astype("u8")


def decode(words, n: int, block: int = BLOCK):
    """The first n values of coded words that begin with a block."""
    w = np.ascontiguousarray(words, "u8")
    selector = (w >> np.uint64(60)).astype("i8")
    raw, skip = np.zeros(len(w), bool), -1
    for i in np.flatnonzero(selector == 0).tolist():  # escapes, in order: the word after one is no word with a selector
        if i != skip:
            raw[i], skip = True, i + 1
    body = np.ones(len(w), bool)
    body[np.flatnonzero(raw) + 1] = False
    # a raw word whose top bits are not zero isn't among those looked at above, so drop it by its escape
    at = np.flatnonzero(body)
    counts = COUNTS[selector[at]]
    # where each word's values begin: within a block the counts add up, and a block's overhang is cut
    begin, out = np.zeros(len(at), "i8"), np.zeros(n, "u8")
    total = np.concatenate([[0], np.cumsum(counts)])
    pos, base, k = 0, 0, 0
    while k < len(at) and pos < n:
        size = min(block, n - pos)
        stop = int(np.searchsorted(total, base + size))
        begin[k:stop] = pos + total[k:stop] - base
        pos, base, k = pos + size, int(total[stop]), stop
    at, begin = at[:k], begin[:k]  # words of further blocks are not asked for
    limit = np.minimum((begin // block + 1) * block, n)
    for s in np.unique(selector[at]).tolist():
        m = np.flatnonzero(selector[at] == s)
        if s == 0:
            out[begin[m]] = w[at[m] + 1]
            continue
        count, bits = PACKS[s - 1]
        if not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        whole = begin[m] + count <= limit[m]
        for part, cut in ((m[whole], False), (m[~whole], True)):
            x, p = w[at[part]], begin[part].copy()
            for j in range(count):
                if cut:
                    inside = p < limit[part]
                    out[p[inside]] = (x[inside] >> np.uint64(bits * j)) & mask
                else:
                    out[p] = (x >> np.uint64(bits * j)) & mask
                p += 1
    return out
