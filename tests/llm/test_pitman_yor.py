import math
import random
import zlib

import numpy as np

from bornoflow.llm import pitman_yor as py

from .test_core import WORDS, awkward, table


def corpus():
    r = random.Random(12)
    langs = [["uno", "dos", "tres", "cuatro"] + [f"{w}o" for w in "abcdefgh"], ["one", "two", "three"] + [f"{w}ing" for w in "abcdefgh"]]
    rows = [(i, " ".join(r.choices(v := r.choice(langs), [1 / (k + 1) for k in range(len(v))], k=r.randrange(1, 60)))) for i in range(300)]
    return rows + [(i + 1000 if i is not None else None, t) for i, t in awkward()]


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def test_counts_base_and_gain(spark):
    rows = corpus()
    tokens = [(i, [*map(lower, WORDS.findall(t or "")), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count: dict = {}
    for i, w in tokens:
        for x in w if not held(i) else []:
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    got = py.score(table(spark, rows).repartition(3), block_words=300).collect()
    want = sorted(((i, held(i), len(w), sum(x in count for x in w), n) for i, w in tokens), key=str)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in got), key=str) == want
    bases = sorted(sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w) for _, w in tokens)
    assert np.allclose(sorted(x.base_score for x in got), bases, rtol=1e-9)
    mine = [x for x in got if x.held_out and x.doc_id < 1000]
    assert len(mine) > 20 and sum(x.score for x in mine) > 0.97 * sum(x.base_score for x in mine) and all(x.score < 0 for x in got)
    assert py.score(table(spark, [])).count() == 0
    none = py.score(table(spark, [(2, "a b")] if held(2) else [(next(i for i in range(99) if held(i)), "a b")])).collect()
    assert none[0].train_tokens == 0 and none[0].n_known == 0 and none[0].score == 0.0


def test_score_against_brute_force(spark):
    """Every pair's probability from restaurants that are counted by hand from the kept seatings; those of a context add up to one; the texts' scores are the sums."""
    rows = corpus()
    model = py.train(py._rows(table(spark, rows).repartition(3), False), block_words=300)
    met: dict = {}
    for x in model.met.collect():
        met.setdefault(x.part, []).append((x.span, x.payload))
    words, per_sample, buckets = [], [], {}
    for part, answers in met.items():
        b = buckets[part] = py.Bucket(py._get(model.folder, f"bucket-{part}"))
        words += [(part, k) for k in range(b.words)]
    known = {w: 0 for w in words}
    for part, b in buckets.items():
        for w, n in zip(b.word.tolist(), b.n.tolist()):
            known[part, w] += n
    v = sum(n > 0 for n in known.values())
    assert v == model.vocabulary and sum(known.values()) == model.tokens
    for step, r in enumerate(model.restaurants, py.BURN_IN + 1):
        level: list = [{} for _ in range(4)]  # (word, restaurant) -> [customers, tables], from the root down
        for part, b in buckets.items():
            s = b.seating(py._get(model.folder, f"seats-{step}-{part}"))
            for word, place, n, t in ((s.word, s.context, s.n, s.t3), (s.word2, s.class2, s.c2, s.t2), (s.word1, s.class1, s.c1, s.t1), (range(b.words), [0] * b.words, s.c0, s.t0)):
                d = level[{id(s.n): 3, id(s.c2): 2, id(s.c1): 1, id(s.c0): 0}[id(n)]]
                for w, c, n1, t1 in zip(word, place, n, t):
                    assert (n1 > 0) == (t1 > 0) and t1 <= n1
                    d[(part, int(w)), int(c)] = [int(n1), int(t1)]
        total: list = [{} for _ in range(4)]
        for d, t in zip(level, total):
            for (_, c), (n1, t1) in d.items():
                x = t.setdefault(c, [0, 0])
                x[0] += n1
                x[1] += t1
        for k, up in ((3, py.fine), (2, py.coarse), (1, lambda c: 0)):  # tables are the parent's customers
            got: dict = {}
            for (w, c), (_, t1) in level[k].items():
                got[w, up(c)] = got.get((w, up(c)), 0) + t1
            assert {x: n for x, n in got.items() if n} == {x: n for x, (n, _) in level[k - 1].items() if n}

        def chance(w, c, r=r, level=level, total=total):
            p = 1 / (v + 1)
            for k, place in enumerate((0, py.coarse(py.fine(c)), py.fine(c), c)):
                n, t = level[k].get((w, place), (0, 0))
                all_n, all_t = total[k].get(place, (0, 0))
                p = (n - r.discounts[k] * t + (py.STRENGTH + r.discounts[k] * all_t) * p) / (py.STRENGTH + all_n)
            return p

        per_sample.append(chance)
    for part, b in buckets.items():
        pdf = {"span": [s for s, _ in met[part]], "payload": [x for _, x in met[part]]}
        got = py.predicted(b, part, model.folder, model.restaurants, model.vocabulary, py._met(b, pdf, False)[0])
        want = [np.mean([f((part, w), c) for f in per_sample]) for w, c in zip(b.word.tolist(), b.pair.tolist())]
        assert np.allclose(got, want, rtol=1e-12)
    for c in {py.START, *(int(x) for b in buckets.values() for x in b.pair[:5])}:
        for f in per_sample:
            assert abs(sum(f(w, c) for w, n in known.items() if n) + f("unknown", c) - 1) < 1e-9
    data, bounds = py.word_hash.texts([__import__("pyarrow").array([lower(t or "") for _, t in rows])])
    starts, lengths, counts = py.word_hash.split(data, bounds)
    hashed, at, want = py.word_hash.hashes(data, starts, lengths).tolist(), 0, []
    place = {}
    for part in buckets:
        for k, h in enumerate(py._named(py._get(model.folder, f"bucket-{part}"), "words")[0].tolist()):
            place[h] = (part, k)
    context = {(w, p): int(c) for part, b in buckets.items() for w, p, c in zip([(part, x) for x in b.word.tolist()], range(len(b.word)), b.pair)}
    follows: dict = {}
    for (w, _), c in context.items():
        follows.setdefault(c & ((1 << py.HASH_BITS) - 1), {})[w] = c
    for (i, _), m in zip(rows, counts.tolist()):
        total_log, before = 0.0, None
        for h in [*hashed[at : at + m], py.END]:
            c = py.START if before is None else follows[before >> (64 - py.HASH_BITS)][place[h]]
            total_log += math.log10(np.mean([f(place[h], c) for f in per_sample]))
            before = h
        at += m
        want.append((i, total_log))
    got = sorted(((x.doc_id, x.score) for x in py.score(table(spark, rows).repartition(3), block_words=300).collect()), key=lambda x: (x[0] is None, x))
    assert len(got) == len(want) and all(i == j and abs(x - y) < 1e-6 for (i, x), (j, y) in zip(got, sorted(want, key=lambda x: (x[0] is None, x))))


def test_words_of_batches():
    """The vectorised splitter against the pattern, and equal hashes for equal words only."""
    import pyarrow as pa

    rows = [t for _, t in awkward()] + ["a\x0bb\x0cc\r\nd", " ", "x", "x" * 5000 + " y", "\u3000 \x1c a\xa0b", "abcdefgh abcdefghi abcdefg", "日本語 日本 本語"]
    for parts in ([pa.array(rows)], [pa.array(rows[:7]), pa.array(rows)[7:20], pa.array([], pa.string()), pa.array(rows[20:])]):
        data, bounds = py.word_hash.texts(parts)
        starts, lengths, counts = py.word_hash.split(data, bounds)
        want = [WORDS.findall(t or "") for t in rows]
        assert counts.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert [data[s : s + n].tobytes().decode() for s, n in zip(starts, lengths)] == flat
        h = py.word_hash.hashes(data, starts, lengths).tolist()
        one, two = (x.tolist() for x in py.word_hash.endings(data, starts, lengths))
        for keys, values in ((flat, h), ([x[-1:] for x in flat], one), ([x[-2:] for x in flat], two)):
            assert len(set(zip(keys, values))) == len(set(keys)) == len(set(values))


def test_seating_matches_the_process():
    """The chosen numbers of tables follow the exact distribution, worked out by dynamic programming."""
    for n, a, d, small, draws, bound in ((6, 0.8, 0.6, 16, 1, 0.01), (6, 0.8, 0.6, 0, 60, 0.01), (6, 0.8, 0.6, 0, py.DRAWS, 0.06), (16, 5.0, 0.3, 16, 1, 0.01), (30, 0.5, 0.7, 16, 300, 0.03)):
        exact = {1: 1.0}
        for s in range(1, n):
            step: dict = {}
            for t, w in exact.items():
                step[t + 1] = step.get(t + 1, 0) + w * a
                step[t] = step.get(t, 0) + w * (s - d * t)
            exact = step
        total = sum(exact.values())
        drawn = py.seat(np.full(50_000, n), np.full(50_000, a), d, np.random.default_rng(0), draws, small)
        assert all(abs((drawn == t).mean() - w / total) < bound for t, w in exact.items()), (n, small, draws)


def test_the_word_before_counts(spark):
    """Two words before with the same ending: only which of them it was tells the next word."""
    r = random.Random(3)
    rows = [(i, " ".join(" ".join(r.choice([("stablexy", "left"), ("marblexy", "right")])) for _ in range(40))) for i in range(200)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    got = {x.doc_id: x for x in py.score(table(spark, rows)).collect()}
    per_word = [got[i].score / got[i].n_tokens for i in held]
    assert len(held) > 10 and min(per_word) > -0.22, min(per_word)  # half of the words are certain; a coin is 0.301


def test_large_dishes_match_the_process():
    for n, a, d in ((100, 5.0, 0.7), (1000, 50.0, 0.7), (5000, 500.0, 0.8), (5000, 1e-4, 0.5), (600, 0.3, 0.3), (2000, 2.0, 0.95), (2000, 0.05, 0.1)):
        w = np.full(n + 2, -np.inf)
        w[1] = 0
        for s in range(1, n):
            w[1 : s + 2] = np.logaddexp(w[1 : s + 2] + np.log(np.maximum(s - d * np.arange(1, s + 2), 1e-300)), w[: s + 1] + math.log(a))
        p = np.exp(w - w.max())
        p /= p.sum()
        t = np.arange(len(p))
        mean, sd = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        drawn = py.seat(np.full(5_000, n), np.full(5_000, a), d, np.random.default_rng(0))
        assert abs(drawn.mean() - mean) < 0.06 * sd + 0.01 and abs(drawn.std() - sd) < 0.06 * sd + 0.01, (n, a, d, mean, sd, drawn.mean(), drawn.std())
