import random
import struct
import zlib

import pytest

from bornoflow.llm import line_dedup, mixing, simple8b, token_store

from .test_core import WORDS, awkward, table


def edit1(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark):
    r = random.Random(5)
    vocab = "a b c d e f G h".split()
    lines = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 5, 6, 6, 7, 12]))) for _ in range(60)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randrange(6)):
            w = r.choice(lines).split(" ")
            if r.random() < 0.4:
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                w.insert(r.randrange(len(w)), r.choice(vocab))
            own.append(r.choice([" ", "  "]).join(w))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "z y x w v " * 4000), (104, "z y x w v " * 3999 + "z y x w q"), (None, "only here with no id at all")]
    seen, want = [], []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0, 0))
            continue
        kept = []
        for line in t.split("\n"):
            w = [x.lower() for x in WORDS.findall(line)]
            if not w or not any(w == s or (len(w) >= 5 and len(s) >= 5 and edit1(w, s)) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        want.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    got = line_dedup.dedup(table(spark, rows).repartition(3)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    twice = line_dedup.dedup(table(spark, [(1, "a b"), (1, "a b"), (2, "a b")])).select("doc_id", "text").collect()
    assert sorted(map(tuple, twice)) == [(1, "a b"), (1, "a b"), (2, "")]
    assert line_dedup.dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_simple8b(block):
    import numpy as np

    r = np.random.default_rng(block)
    for n in (0, 1, 5, 4096, 4097, 20000):
        for top in (1, 2, 2**16, 2**63):
            v = r.integers(0, top, n, dtype="u8")
            if n > 100:
                v[r.integers(0, n, 20)] = 2**64 - 1
                v[40:90] = 0
            words, offsets = simple8b.encode(v, block)
            assert (simple8b.decode(words, n, block) == v).all()
            for k in range(0, len(offsets), 7):
                m = min(block, n - k * block)
                assert (simple8b.decode(words[int(offsets[k]) :], m, block) == v[k * block : k * block + m]).all()


def test_token_store(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers as P
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = ["It's the énd of it'll.", "a.̸b ≮ =", "ÀÉ ß Σας ΣΑΣ", "x9y 12.34 U.S.A.", "日本 語。", "wow!!! (no) a,b;c|", "<|endoftext|> Å K"]
    rows = awkward(7) + [(2000 + i, t) for i, t in enumerate(odd)]
    docs = table(spark, rows).repartition(3)
    files = token_store.write(docs, f"file://{tmp_path}/ids", path, 2, file_ids=500, block=64)
    got = token_store.read(files, f"file://{tmp_path}/ids").withColumn("crc", F.crc32("ids")).drop("ids").collect()
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, start = [], 0
    for i, t in order:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_store.store(spark, table(spark, []), path, 2).count() == 0


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randrange(40)), None, r.choice(["a", "a", "a", "b", "c", "é", None]), 0, "x", 1) for i in range(300)]
    rows += [(900, None, None, "d", 0, "x", 1), (901, "", None, "d", 0, "x", 1), (None, "q q", None, "a", 0, "x", 1), (5, "q q q", None, "b", 0, "x", 1)]
    from .test_core import SCHEMA

    docs = spark.createDataFrame(rows, SCHEMA)
    for boundary in ("cut", "whole"):
        got = mixing.mix(docs.repartition(4), boundary=boundary).collect()
        again = mixing.mix(docs.repartition(2), boundary=boundary).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
        sizes, taken, goal = {}, {}, {}
        for x in got:
            assert 0 <= x.taken <= 2 * x.size
            sizes[x.source] = sizes.get(x.source, 0) + x.size
            taken[x.source] = taken.get(x.source, 0) + x.taken
            goal[x.source] = x.target
        sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
        total, open_, want = 1.5 * sum(sizes.values()), set(sources), {}
        while open_:
            level = (total - sum(want.values())) / sum(weight[s] for s in open_)
            above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
            want |= {s: 2.0 * sizes[s] for s in above} if above else {s: weight[s] * level for s in open_}
            open_ = open_ - above if above else set()
        for s in sources:
            assert abs(goal[s] - want[s]) < 1e-6
            assert abs(taken[s] - want[s]) <= (0.5001 if boundary == "cut" else 40)
    assert mixing.mix(table(spark, [])).count() == 0
