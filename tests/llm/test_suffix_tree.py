import collections
import functools
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import suffix_tree as op

from .conftest import ODD


def corpus(n=300, seed=1):
    """Every second word follows from the one before it."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            a = rng.choice(["alpha", "beta", "gamma", "Delta"])
            words += [a, {"alpha": "one", "beta": "two", "gamma": "three", "Delta": "four"}[a]]
            if rng.random() < 0.02:
                words.append(f"rare{rng.randrange(10**6)}")
        rows.append((i, "  ".join(words)))
    return rows


def brute_base(rows):
    token = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, t in rows if not held(d) for w in token(t))
    total, kinds = sum(c.values()), len(c)
    return [(d, held(d), len(token(t)), sum(c[w] > 0 for w in token(t)), total, pytest.approx(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in token(t)))) for d, t in rows]


def fields(frame):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in frame.collect()]


def brute_scores(rows, depth, divergence):
    """The tree's score of each text, by counts of tuples."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    docs = [(d, [0, *(w.decode() for w in (t or "").encode().lower().split()), 1]) for d, t in rows]
    grams = collections.Counter(tuple(x[i - k : i + 1]) for d, x in docs if not held(d) for i in range(len(x)) for k in range(min(i, depth) + 1))
    n = sum(len(x) - 1 for d, x in docs if not held(d))
    v = sum(len(g) == 1 and g != (0,) for g in grams)
    left = lambda total: 0.3 + 0.7 / (total + 1)

    def chain(x, i, out):
        p = [(grams[(x[i],)] + 1 - out) / (n + v + 1 - out)]
        for k in range(1, min(i, depth) + 1):
            total = grams[tuple(x[i - k : i])] - out
            own = (grams[tuple(x[i - k : i + 1])] - out) / total if total > 0 else 0
            p.append((1 - left(total)) * own + left(total) * p[-1] if total >= 0 else p[-1])
        return p

    gains = collections.Counter()
    for d, x in docs:
        if not held(d):
            for i in range(1, len(x)):
                p = chain(x, i, 1)
                for k in range(1, len(p)):
                    gains[tuple(x[i - k : i])] += math.log10(p[k] / p[k - 1])
    retained = lambda c: grams[c] >= 2 and round(gains[c] * 1000) / 1000 >= divergence * grams[c]
    most = {}
    for g, m in grams.items():
        most[g[:-1]] = max(most.get(g[:-1], 0), m)

    @functools.cache
    def state(c):
        return not c or state(c[1:]) and (not c[1:] or grams[c[1:]] > most[c[1:]]) and retained(c)

    out = []
    for d, x in docs:
        whole = 0
        for i in range(1, len(x)):
            p, k = chain(x, i, 0), 0
            while k + 1 < len(p) and state(tuple(x[i - k - 1 : i])):
                k += 1
            whole += math.log10(p[k])
        out.append((d, whole))
    return out


def test_base_equals_brute_force_and_the_tree_beats_it(docs):
    rows = [(i + 100, t) for i, t in corpus()] + [x for x in ODD if x[1] is None or len(x[1]) < 100]
    got = op.score(docs(rows))
    key = lambda x: (str(x[0]), x[2])
    assert sorted(fields(got), key=key) == sorted(brute_base(rows), key=key)
    long_ = [r for r in got.collect() if r.held_out and r.n_tokens > 20]
    assert long_ and all(r.score > r.base_score for r in long_)


@pytest.mark.parametrize("bucket", [300, 1e6])
@pytest.mark.parametrize("depth", [0, 1, 2])
def test_scores_equal_brute_force(docs, depth, bucket):
    """However the documents fall into buckets."""
    rows = [(i, t) for i, t in corpus(80, seed=2)] + [(200, None), (201, "")]
    got = {r.doc_id: r.score for r in op.score(docs(rows).repartition(3), depth=depth, divergence=0.02, bucket=bucket).collect()}
    assert got == {d: pytest.approx(x) for d, x in brute_scores(rows, depth, 0.02)}


def test_totals_move_once_and_gains_come_back_as_bits(docs, monkeypatch):
    """What came back is read where it lies, not dealt again at each later step; of gains it is told whether they are enough."""
    plans, real = [], op.added

    def spy(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame, name)

    monkeypatch.setattr(op, "added", spy)
    score = op.score(docs(corpus(80, seed=2)).repartition(3), bucket=300)
    plans.append(score._jdf.queryExecution().executedPlan().toString())
    # the exchanges of a step: what is sent by shards, what comes back by buckets; scoring has none
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2, 2, 0]
    keys, gains, totals = np.array([3, 9], np.uint64), np.array([40, 5]), np.array([5, 2])
    row = lambda n: op._rows(n, keys, gains, totals, shards=1).to_batches()
    got = {b.column(0)[0].as_py(): op._unpacked(b.column(2)[0].as_py()).tolist() for b in op._summed(0.01)(iter(row(1) + row(2))) if b.column(0)[0].as_py() > 0}
    assert got == {1: [1, 0], 2: [1, 0]}


def test_the_tree_grows_with_the_corpus(docs):
    """A context that occurs twice is learned at any size: a passage of new words is likelier where another document repeats it."""
    rng = random.Random(4)
    fill = corpus(200, seed=5)
    train = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 7 != 2][:20]
    passage = lambda: " ".join(f"new{rng.randrange(10**9)}" for _ in range(40))
    texts = [passage() for _ in train]
    twice = [passage() for _ in train[:10]]
    rows = fill + list(zip(train, [*twice, *texts[10:]])) + [(d + 5000, t) for d, t in zip(train, twice)]
    got = {r.doc_id: r.score / r.n_tokens for r in op.score(docs(rows), held_out=op.F.lit(False)).collect()}
    assert min(got[d] for d in train[:10]) > max(got[d] for d in train[10:])


def test_defined_cases(docs):
    assert op.score(docs([])).count() == 0
    only_held = [(d, "x y") for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    got = op.score(docs(only_held)).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0) for r in got)
    long_ = op.score(docs([(1, "word " * 40_000), (2, None), (3, "w" * 3_000_000)])).collect()
    assert sorted(r.n_tokens for r in long_) == [1, 2, 40_001]
