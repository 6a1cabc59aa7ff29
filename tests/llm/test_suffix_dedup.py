import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import suffix_array as sa
from lodestone.llm import suffix_dedup as op

from .conftest import ODD


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.booleans())
def test_suffix_array_and_common_prefixes(symbols, many):
    # many: an alphabet that leaves the string to its digits as soon as it has names
    s = [*(x * 400 + i % 7 if many else x for i, x in enumerate(symbols)), 0]
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert sa.suffix_array(np.array(s)).tolist() == want
    if many:
        return
    plcp = sa.common_prefixes(np.array(s, np.uint8), np.array(want), 16)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert plcp[b] == min(n, 16)


def test_suffix_array_of_a_long_text_recurses_to_the_end():
    """A megabyte of text with long repeats: names are many, and are sorted by induction at every level."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(20_000)]
    passage = " ".join(rng.choices(words, k=20_000))
    text = np.frombuffer((passage + " ".join(rng.choices(words, k=60_000)) + passage + "a" * 500).encode(), np.uint8)
    levels, real = [], sa.induce

    def counted(s, k, *rest):
        levels.append((len(s), k))
        return real(s, k, *rest)

    sa.induce = counted
    try:
        order = sa.suffix_array(np.concatenate((text.astype(np.int32), [0])))[1:]
    finally:
        sa.induce = real
    assert len(levels) > 6 and all(16 * k < n or n < 5000 for n, k in levels if n > 64 * 64)
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    # each suffix is greater than the one before it: at the first byte that differs
    body, a, b = text.tobytes(), order[:-1], order[1:]
    for i in rng.sample(range(len(a)), 3000):
        assert body[a[i] :] < body[b[i] :]


def brute(rows, w=100):
    seen, out = set(), []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if b[i : i + w] in seen:
                gone[i : i + w] = b"\1" * w
            seen.add(b[i : i + w])
        out.append((d, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    parts = ["ab", "c", "xyz", "aaaa", "  ", "é", "\n"]
    pool = ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(10)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p))
            text += rng.choice([p, p[a:], p[:a], "a" * rng.randint(0, 300), "xy" * 99, "".join(rng.choices(parts, k=30))])
        rows.append((i, text))
    return rows


def test_against_brute_force(docs, monkeypatch):
    rows = random_rows(1)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.spans) for r in op.remove_repeats(docs(rows).repartition(3)).collect()}
    for d, want in brute(rows):
        kept, n, spans = got[d]
        body = dict(rows)[d].encode()
        assert kept == want and n == len(body)
        assert b"".join(body[a:b] for a, b in zip([0, *(x.end for x in spans)], [*(x.start for x in spans), n])) == kept


def test_blocks_cut_long_documents(docs, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 500)
    rows = random_rows(2, 30) + [(1000, "q" * 3000), (1001, "".join(random.Random(7).choices("abcdef", k=4000)) * 2)]
    pieces = list(op._pieces([_Batch(rows)], 100))
    windows = sum(max(0, len(b) - 99) for _, _, _, bodies in pieces for b in bodies)
    assert windows == sum(max(0, len(t.encode()) - 99) for _, t in rows)


class _Batch:
    def __init__(self, rows):
        self.columns = [[d for d, _ in rows], [0] * len(rows), [t.encode() for _, t in rows]]

    def column(self, i):
        return type("C", (), {"to_pylist": lambda _, x=self.columns[i]: x})()


def test_defined_cases(docs):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [*ODD, (7, long), (7, long), (None, long), (8, long)]
    got = sorted(((r.doc_id, r.n_bytes, len(r.kept), len(r.spans)) for r in op.remove_repeats(docs(rows)).collect()), key=str)
    period = len("word " * 30_000)
    want = [(None, 0, 0, 0), (None, 5, 5, 0), (None, 300, 0, 1), (1, 0, 0, 0), (2, 4, 4, 0), (3, 1, 1, 0), (4, 8, 8, 0), (4, 8, 8, 0), (5, period, 5, 1), (6, 0, 0, 0), (7, 300, 300, 0), (7, 300, 300, 0), (8, 300, 0, 1)]
    assert got == sorted(want, key=str)
    assert op.remove_repeats(docs([])).count() == 0


def test_many_rows_that_share_an_id_or_have_none(docs):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [text(150) for _ in range(200)]
    for shared in (None, 7):
        rows = [(shared, f"{text(rng.randint(20, 90))}{passages[i % 200] if i % 10 == 0 else text(110)}{text(20)}{i}") for i in range(4000)]
        got = {bytes(r.kept) for r in op.remove_repeats(docs(rows).repartition(3)).collect()}
        # rows that share an id rank by their text's digest
        ranked = [(r.doc_id, r.text) for r in docs(rows).orderBy(F.xxhash64("text")).collect()]
        want = brute(ranked)
        assert sum(len(k) < len(t.encode()) for (_, k), (_, t) in zip(want, ranked)) == 380
        assert got == {k for _, k in want}
