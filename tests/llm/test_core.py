"""Brute-force versions of the operators, on small tables with the awkward cases."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from bornoflow.llm import byte_bpe, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "clash", -1) for i, t in rows], SCHEMA)


def awkward(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["a", "Bé", "the", "x" * 30, "of,", "ß", "日本", "no.", "b\x1cc", "e", "F", "g"]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 12, 13, 14, 40, 200]))) for _ in range(n // 2)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n // 2, n):
        t = r.choice(base).split(" ")
        if t and r.random() < 0.6:
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(t)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (None, base[4]), (3, base[3]), (3, base[8]), (n + 3, "w " * 5000)]


def test_substring_dedup(spark):
    rows = awkward()
    first: dict = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = {q for k in range(len(w) - 12) if (d := first.get(tuple(w[k : k + 13]))) is not None and (i is None or d < i) for q in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    for words in (4_000_000, 100):
        got = [tuple(x) for x in substring_dedup.dedup(table(spark, rows).repartition(3), block_words=words).drop("spans").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.dedup(table(spark, [])).count() == 0


def test_packing():
    import numpy as np

    for seed in range(20):
        r = np.random.default_rng(seed)
        x = np.sort(r.integers(0, 2 ** r.integers(1, 64), r.integers(0, 500), dtype="u8"))
        assert (substring_dedup._unpack(substring_dedup._pack(x)) == x).all()


def brute_fingerprint(text):
    import xxhash

    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [8192, 4])
def test_simhash(spark, chunk):
    rows = awkward(2)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)
    got = simhash.near_duplicates(table(spark, rows), chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices(radius):
    import numpy as np

    r = np.random.default_rng(radius)
    fp = r.integers(0, 2**64, 500, dtype="u8")
    for k in range(250):
        fp[250 + k] = fp[k] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)))
    group = np.sort(r.integers(0, 4, 500))
    fp = fp[r.permutation(500)]
    got = {(int(a), int(b)) for i, j in simhash.sliced_links(fp, group, radius) for a, b in zip(i, j)}
    assert got == {(i, j) for j in range(500) for i in range(j) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}


def test_byte_bpe(spark):
    pytest.importorskip("public_tokenizers")
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["  a  b\n\n c", "x  y 　", "it's  'll we'RE", "\x1c\x1d a\x85b", "1234567 89", " ", "\n", "日本語 テキスト", "😀 é é", "a" * 3000, "tail   "]
    r = random.Random(3)
    odd += ["".join(r.choice("ab '\n\t .1é日s") for _ in range(r.randrange(60))) for _ in range(200)]
    rows = awkward() + [(1000 + i, t) for i, t in enumerate(odd)] + [(5000, " " * 100_000 + "x" + "\n" * 5000)]
    got = byte_bpe.round_trip(table(spark, rows), path, P.PATTERN).collect()
    import regex

    want = []
    for i, t in rows:
        t = t or ""
        ids = plain.encode_ordinary(t) if len(t) < 50_000 else [k for m in regex.finditer(P.PATTERN, t) for k in plain.encode_ordinary(m[0])]
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.round_trip(table(spark, []), path, P.PATTERN).count() == 0
