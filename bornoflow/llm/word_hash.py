"""Words of whole Arrow batches as arrays: where they stand, and 64-bit hashes of them, without a Python object per word."""

from __future__ import annotations

#: 1 for the bytes of WORD's separators; all are ASCII, so no byte of a longer UTF-8 sequence is one.
SPACES = bytes(1 if b in b" \t\n\v\f\r" else 0 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
K0, K1, K2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def texts(arrays):
    """(bytes, offsets) of Arrow string arrays one after the other; a null is empty. Eight bytes of padding follow."""
    import numpy as np
    import pyarrow as pa

    parts, ends, base = [], [np.zeros(1, "i8")], 0
    for a in arrays:
        a = a.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(a.buffers()[1], "<i8", len(a) + 1, 8 * a.offset) if len(a) else np.zeros(1, "i8")
        if a.buffers()[2] is not None:
            parts.append(np.frombuffer(a.buffers()[2], "u1")[off[0] : off[-1]])
        ends.append(off[1:] - off[0] + base)
        base += int(off[-1] - off[0])
    return np.concatenate([*parts, np.zeros(8, "u1")]), np.concatenate(ends)


def split(data, bounds):
    """(starts, lengths, words per text) of the words of texts at `bounds` in data, as texts() gives them."""
    import numpy as np

    n = int(bounds[-1])
    space = np.frombuffer(SPACES, "u1")[data[:n]].view(bool)
    edge = np.ones(n + 1, bool)  # a word can start where a space or another text ended
    edge[1:n] = space[: n - 1] if n else False
    edge[bounds] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    last = np.ones(n, bool)
    last[: n - 1] = space[1:] if n else False
    last[bounds[bounds > 0] - 1] = True
    ends = np.flatnonzero(last & ~space) + 1
    at = np.searchsorted(starts, bounds)
    return starts, ends - starts, np.diff(at)


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(K2)
    return x ^ (x >> np.uint64(29))


def hashes(data, starts, lengths):
    """64-bit hashes of the words at (starts, lengths), eight bytes at a time for all words at once."""
    import numpy as np

    view = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    out = lengths.astype("u8") * np.uint64(K0) + np.uint64(K1)
    live, at, left = None, starts, lengths
    while len(at):
        x, short = view[at], np.flatnonzero(left < 8)
        x[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype("u8"))) - np.uint64(1)
        h = ((out if live is None else out[live]) ^ x) * np.uint64(K1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(K2)
        h ^= h >> np.uint64(29)
        if live is None:
            out = h
        else:
            out[live] = h
        more = np.flatnonzero(left > 8)
        live, at, left = more if live is None else live[more], at[more] + 8, left[more] - 8
    return out


def endings(data, starts, lengths):
    """Hashes of the last character of each word, and of its last two."""
    import numpy as np

    def back(p):
        for _ in range(3):
            p = np.where((p > starts) & ((data[p] & 0xC0) == 0x80), p - 1, p)
        return p

    end = starts + lengths
    one = back(end - 1)
    two = np.where(one > starts, back(np.maximum(one - 1, starts)), one)
    return tuple(_mixed(hashes(data, p, end - p)) for p in (one, two))
